"""Queries on metadata, settings, texts of results and aligned frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import numeric as n
from ..operators import compare, library, metadata, present
from . import roles
from .roles import r6


def probe_json(spark, d):
    """Probe documents made of the parts' numbers, read back: a picture, up to two tracks, odd values."""
    p = roles.table(spark, d, "part").select(F.col("p_partkey").alias("k"), "p_size", "p_retailprice")
    k = F.col("k")
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("string")
    stream = lambda kind, rate, channels, kbps, flag, picture: F.struct(
        F.lit(kind).alias("codec_type"), text(k % 9).alias("index"), text(rate).alias("sample_rate"), text(channels).alias("channels"), kbps.alias("bit_rate"),
        F.create_map(F.lit("default"), flag.cast("int"), F.lit("attached_pic"), picture.cast("int")).alias("disposition"),
    )
    no = F.lit(False)
    video = F.when(k % 4 == 0, stream("video", F.lit(0), F.lit(0), none, no, k % 8 == 0))
    one = F.when(k % 11 != 0, stream("audio", F.when(k % 5 == 0, 0).otherwise(44100), k % 3 + 1, F.when(k % 2 == 0, text(F.col("p_size") * 1000)).otherwise(F.lit("N/A")), k % 6 == 0, no))
    two = F.when(k % 3 == 0, stream("audio", F.lit(48000), k % 7 + 1, none, k % 9 == 0, no))
    form = F.struct(F.lit("mov").alias("format_name"), text(F.col("p_size") * 7777).alias("size"), F.when(k % 13 == 0, F.lit("nan")).otherwise(text(F.col("p_retailprice"))).alias("duration"), text(F.col("p_size") * 2000).alias("bit_rate"))
    document = F.when(k % 97 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.array_compact(F.array(video, one, two)).alias("streams"), form.alias("format"))))
    rows = p.select("k", metadata.probe(document).alias("m"))
    first = metadata.default_track(F.col("m.audio"))
    taken = F.filter("m.audio", lambda s: s["audio_index"] == first)
    only = (F.size("m.audio") == 1) & ~F.col("m.has_video") & ~F.col("m.has_picture")
    tier, rate = metadata.bit_rate(F.get(taken, F.lit(0))["bit_rate"], F.col("m.bit_rate"), only, F.lit(None).cast("long"))
    return rows.select("k", F.size("m.audio").cast("long").alias("tracks"), "m.error", "m.has_video", "m.has_picture", "m.duration", first.alias("track"), F.when(F.size("m.audio") > 0, tier).alias("tier"), F.when(F.size("m.audio") > 0, rate).alias("rate"))


def default_stream(spark, d):
    """For each customer the first order that is marked default, else the one with the most channels."""
    o = roles.table(spark, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderstatus") == "F").alias("flag"), (F.col("o_orderkey") % 6 + 1).alias("channels"))
    return metadata.default_stream(o, "o_custkey", "o_orderkey", F.col("flag"), F.col("channels"))


def bitrate_three_tier(spark, d):
    """Orders as files, their lines as packets: the stated rate, the file's if it is alone, else packets around the middle."""
    o = roles.table(spark, d, "orders").groupBy("o_orderkey").agg(F.max("o_custkey").alias("c"))
    files = o.select("o_orderkey", (F.col("c") % 120).cast("double").alias("duration"), F.when(F.col("o_orderkey") % 3 == 0, F.col("c")).alias("stated"), (F.col("c") * 2).alias("container"), (F.col("o_orderkey") % 3 == 1).alias("only"))
    packets = roles.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), ((F.col("l_linenumber") * 7 + F.col("l_partkey")) % 120).cast("double").alias("at"), F.floor("l_extendedprice").alias("size"), F.when(F.col("l_linenumber") > 1, F.col("l_quantity") / 64).alias("span"))
    j = files.join(metadata.sampled_rate(packets, files, "o_orderkey"), "o_orderkey", "left")
    tier, rate = metadata.bit_rate(F.col("stated"), F.col("container"), F.col("only"), F.col("sampled"))
    return j.select("o_orderkey", tier.alias("tier"), rate.alias("rate"))


def variable_rates(spark, d):
    """Lines as frame headers of their supplier's stream."""
    kbps = F.element_at(F.array(F.lit(96), F.lit(128), F.lit(160)), (F.col("l_quantity").cast("int") % 3 + 1).cast("int"))
    li = roles.table(spark, d, "lineitem").where("l_linenumber > 0").select(F.col("l_orderkey").alias("k"), kbps.alias("kbps"))
    v = metadata.variable_rate(li, "k", "kbps")
    seconds = metadata.frames_duration(F.when(F.col("k") % 4 == 0, F.col("k")), F.lit(1152), F.when(F.col("k") % 8 == 0, 0).otherwise(44100), F.col("k") * 1000, F.col("average_kbps"))
    return v.select("k", "is_vbr", n.r6(F.col("average_kbps")).alias("average_kbps"), n.r6(seconds).alias("seconds"))


def container_ratios(spark, d):
    """Compression ratios, Ogg durations and block maps, with unknown denominators."""
    p = roles.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("s"))
    k, s = F.col("k"), F.col("s")
    ratio = metadata.compression_ratio(s * 1000, k % 3000, F.lit(100), k * 10 % 7000, k % 3, F.lit(16))
    blocks = metadata.has_block(F.when(k % 2 == 0, F.array(F.lit("STREAMINFO"), F.lit("PICTURE"))).otherwise(F.array(F.lit("STREAMINFO"))), ["STREAMINFO", "PICTURE", "CUESHEET"])
    seconds = metadata.granule_duration(F.when(k % 5 != 0, k * 48), (k % 4) * 16000, k % 7 == 0)
    return p.select("k", n.r6(ratio).alias("ratio"), n.r6(seconds).alias("seconds"), F.array_join(F.transform(F.array_sort(F.map_keys(blocks)), lambda b: F.concat(b, F.lit("="), F.try_element_at(blocks, b).cast("string"))), " ").alias("blocks"))


def scan_choices(spark, d):
    """How many entries of a scan each choice shows, and the headlines of those shown as suspicious."""
    docs = roles.table(spark, d, "documents").select("doc_id", "n_chars")
    bucket = F.element_at(F.array(*map(F.lit, ("consistent_lossy", "undetermined", "error", "consistent_lossless"))), (F.col("doc_id") % 4 + 1).cast("int"))
    choice = F.explode(F.array(*map(F.lit, ("all", "suspicious", "undetermined", "errors", "lossless"))))
    some = lambda name, rule: F.when(rule, F.array(F.concat(F.lit(name + " "), F.col("doc_id") % 3), F.lit("more"))).otherwise(F.array().cast("array<string>"))
    head = present.entry_headline(F.when(F.col("doc_id") % 4 == 2, "unreadable").otherwise(""), some("cutoff", F.col("doc_id") % 3 == 0), some("full band", F.col("doc_id") % 5 == 0), some("note", F.col("doc_id") % 2 == 0))
    rows = docs.select("doc_id", bucket.alias("bucket"), head.alias("headline"), choice.alias("choice"))
    return rows.where(present.visible(F.col("bucket"), F.col("choice"))).groupBy("choice", "headline").agg(F.count("*").alias("entries"), F.count_if(present.suspicious(F.col("bucket"))).alias("suspicious"))


def encoder_settings(spark, d):
    """Jobs of the parts against the codec dimension: what is wrong with them, else what their file is called."""
    p = roles.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.element_at(F.array(*(F.lit(c[0]) for c in present.CODECS)), (F.col("p_partkey") % 13 + 1).cast("int")).alias("codec"))
    mode = F.element_at(F.array(*map(F.lit, ("bitrate", "quality", "lossless"))), (F.col("k") % 3 + 1).cast("int"))
    p = p.select("*", mode.alias("mode"), F.when(F.col("k") % 5 != 0, F.lit(128)).alias("kbps"), (F.col("k") % 14 - 2).cast("int").alias("quality"))
    j = p.join(F.broadcast(present.codecs(spark)), "codec")
    error = present.settings_error(F.col("mode"), F.col("kbps"), F.col("quality"), F.col("modes"), F.col("low"), F.col("high"))
    return j.select("k", error.alias("error"), F.when(error.isNull(), present.settings_label(F.col("codec"), F.col("mode"), F.col("kbps"), F.col("quality"), F.col("mark"))).alias("label"))


def ladder_rates(spark, d):
    """The rates of the codec that each document stands for, on the ladder or spread over its own, and how many documents and characters each codec has."""
    codec = F.get(F.array(*map(F.lit, _RATED)), (F.col("doc_id") % len(_RATED)).cast("int"))
    files = roles.table(spark, d, "documents").groupBy(codec.alias("codec")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))
    c = present.codecs(spark).where(F.size("rates") > 0)
    return files.join(F.broadcast(c), "codec").select("codec", F.array_join(present.ladder_rates(F.col("rates")), " ").alias("rates"), "files", "chars")


def result_texts(spark, d):
    """Levels, bands and delays of orders as a reader sees them."""
    o = roles.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    k = F.col("k")
    level = F.when(k % 11 == 0, F.lit(float("inf"))).when(k % 13 == 0, F.lit(float("-inf"))).when(k % 17 != 0, (k % 1000) / 8.0)
    hz = F.element_at(F.array(*(F.lit(float(x)) for x in (20, 50, 999, 1000, 1500, 4000, 16000, 21800))), (k % 7 + 1).cast("int"))
    above = F.element_at(F.array(*(F.lit(float(x)) for x in (50, 999, 1000, 1500, 4000, 16000, 21800))), (k % 7 + 1).cast("int"))
    samples = F.when(k % 19 != 0, (k % 4001 - 2000) / 4.0)
    return o.select("k", present.db_text(level).alias("level"), present.band_label(hz, above).alias("band"), present.delay_text(samples, F.lit(44100)).alias("delay"))


def excerpt_starts(spark, d):
    """Where a second excerpt of a pair may start, and the part of the test that the reference covers."""
    o = roles.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    k = F.col("k")
    ref, test, delay = (k % 50).cast("double"), (k % 37).cast("double"), (k % 21 - 10) / 2.0
    lo, hi = present.overlap_span(delay * 100, (k % 5 - 2) * 1e-4, ref * 100, test * 100)
    return o.select("k", n.r6(present.random_start(ref, test, delay, F.lit(8.0), (k % 10) / 10.0)).alias("start_s"), lo.alias("first"), hi.alias("last"))


def class_calibration(spark, d):
    """How text lengths fall out by quality label, and how many a threshold would take."""
    rows = roles.table(spark, d, "labels").join(roles.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("quality").cast("long").alias("quality"), F.col("n_chars").cast("double").alias("n_chars"))
    return present.calibration(rows, "quality", "n_chars", F.col("n_chars") > 1000)


def offset_frame_join(spark, d):
    """Frames of a copy that is 37 samples late and half as loud, against the reference at the same place, in blocks of 256."""
    s = roles.series(spark, d).select(F.lit(0).cast("long").alias("track"), (F.col("pos") - F.lit(0)).alias("pos"), "x")
    first = s.agg(F.min("pos").alias("first"))
    s = s.join(F.broadcast(first), F.lit(True)).select("track", (F.col("pos") - F.col("first")).alias("pos"), "x")
    zeros = spark.range(37).select(F.lit(0).cast("long").alias("track"), F.col("id").alias("pos"), F.lit(0.0).alias("x"))
    later = s.select("track", (F.col("pos") + 37).alias("pos"), (0.5 * F.col("x")).alias("x")).unionByName(zeros)
    model = spark.createDataFrame([(0, 0.0, 37.0)], "track long, slope double, intercept double")
    c = compare.cross_spectrum(compare.blocks(s, 256), compare.blocks(later, 256), model, size=256, fft=64, hop=32, windowed=False)
    return c.select("bin", "frames", n.r6(n.db10(F.col("saa"))).alias("ref_db"), n.r6(n.db10(F.col("sbb"))).alias("test_db"), n.r6(F.col("sab_re") / F.col("saa")).alias("gain"))


def pair_arrays(spark, d):
    """Reference and test arrays of unequal lengths: cut to the shorter, their channel mean, its scale and whether all is finite."""
    e = roles.frames(spark, d).select("vec_id", F.slice("a", 1, (F.col("vec_id") % 60 + 1).cast("int")).alias("a"), F.slice("b", 1, (F.col("vec_id") % 47 + 5).cast("int")).alias("b"))
    size = F.least(F.size("a"), F.size("b"))
    e = e.select("vec_id", size.alias("size"), F.zip_with(F.slice("a", 1, size), F.slice("b", 1, size), lambda x, y: (x + y) / 2).alias("m"))
    finite = F.forall("m", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    power = F.aggregate("m", F.lit(0.0), lambda s, x: s + x * x)
    window = F.aggregate(F.sequence(F.lit(0), F.col("size") - 1), F.lit(0.0), lambda s, i: s + F.pow(n.hann(i, F.col("size")), 2))
    scale = F.when((F.col("size") > 1) & (window > 0), 4 / (F.col("size") * window))
    return e.select("vec_id", F.col("size").cast("long").alias("size"), finite.alias("finite"), (power == 0).alias("silent"), n.r6(power).alias("power"), n.r6(scale).alias("scale"))


def file_regions(spark, d):
    """What is read of files of very different sizes."""
    p = roles.table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * F.col("p_partkey") * 997).alias("size"))
    r = p.select("k", "size", metadata.regions(F.col("size"), 1 << 20, 1 << 16).alias("r"))
    return r.select("k", "r.sampled", F.posexplode("r.parts").alias("part", "x")).select("k", "sampled", F.col("part").cast("long").alias("part"), "x.start", "x.length")


def verified_excerpts(spark, d):
    """Places of excerpts of documents as recordings, and the first with enough active frames."""
    f = roles.table(spark, d, "documents").select("doc_id", (F.col("n_chars") / 10.0).alias("duration"))
    e = f.select("doc_id", F.posexplode(library.verify_starts(F.col("duration"))).alias("ord", "start")).select("doc_id", F.col("ord").cast("long").alias("ord"), "start", ((F.col("doc_id") * 7 + F.col("ord") * 13) % 60).alias("frames"))
    return library.first_usable(e, "doc_id", "ord", "frames").select("doc_id", "ord", n.r6(F.col("start")).alias("start"), "frames", "tried")


def pcm_checks(spark, d):
    """Texts as samples against a stated MD5 that is theirs, another's, or none."""
    t = roles.table(spark, d, "documents").select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("pcm"))
    stated = F.when(F.col("doc_id") % 5 == 0, F.repeat(F.lit("0"), F.lit(32))).when(F.col("doc_id") % 3 == 0, F.md5(F.lit("x").cast("binary"))).otherwise(F.upper(F.md5("pcm")))
    return t.select("doc_id", metadata.pcm_matches(F.col("pcm"), stated, F.when(F.col("doc_id") % 7 == 0, 20).otherwise(16)).alias("matches"))


def scalar_formulas(spark, d):
    """Levels, frame sizes and auditory scales of the parts' numbers."""
    p = roles.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("x"))
    return p.select("k", n.r6(n.db20(F.when(F.col("k") % 5 == 0, F.lit(0.0)).otherwise(F.col("x") / 1000))).alias("db"), n.next_power_of_two(F.col("k")).alias("size"), n.r6(n.erb_bandwidth(F.col("x"))).alias("erb_hz"), n.r6(n.erb_number(F.col("x"))).alias("erb"))


def scan_order(spark, d):
    """Entries of each source by their seconds, those without any last."""
    e = roles.table(spark, d, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 4 != 0, F.col("n_chars") / 10.0).alias("seconds"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.asc_nulls_last("seconds"), "doc_id"))
    return e.select("source", "doc_id", "seconds", place.cast("long").alias("place"))


QUERIES = {f.__name__: f for f in (probe_json, default_stream, bitrate_three_tier, variable_rates, container_ratios, scan_choices, encoder_settings, ladder_rates, result_texts, excerpt_starts, class_calibration, offset_frame_join, pair_arrays, file_regions, verified_excerpts, pcm_checks, scalar_formulas, scan_order)}

_RATED = [c for c, rates, *_ in present.CODECS if rates]
_CODECS_SQL = "codecs AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{c}', {('[' + ', '.join(map(str, r)) + ']') if r else '[]::INT[]'}, {'NULL' if lo is None else lo}, {'NULL' if hi is None else hi}, {'NULL' if m is None else repr(m)})" for c, r, lo, hi, m in present.CODECS
) + ") v(codec, rates, low, high, mark))"
_HZ = lambda x: f"(CASE WHEN {x} < 1000 THEN printf('%.0f Hz', {x}) ELSE regexp_replace(printf('%.1f', {x} / 1000), '\\.0$', '') || ' kHz' END)"

SQL = {
    "probe_json": """
        WITH p AS (SELECT p_partkey AS k, p_size AS s, p_retailprice AS r FROM part),
        a AS (SELECT *, k % 97 = 0 AS broken, k % 11 <> 0 AS has1, k % 11 <> 0 AND k % 5 <> 0 AS ok1, k % 3 = 0 AS ok2,
                     CASE WHEN k % 11 <> 0 THEN 1 ELSE 0 END AS ord2 FROM p),
        b AS (SELECT *, CASE WHEN broken THEN 0 ELSE ok1::INT + ok2::INT END AS tracks FROM a),
        t AS (SELECT *, CASE WHEN tracks = 0 THEN NULL WHEN tracks = 1 THEN CASE WHEN ok1 THEN 0 ELSE ord2 END
                         WHEN k % 6 = 0 THEN 0 WHEN k % 9 = 0 THEN ord2 WHEN k % 7 + 1 > k % 3 + 1 THEN ord2 ELSE 0 END AS track FROM b),
        u AS (SELECT *, CASE WHEN tracks > 0 AND ok1 AND track = 0 AND k % 2 = 0 THEN s * 1000 END AS stated, CASE WHEN tracks = 1 AND k % 4 <> 0 THEN s * 2000 END AS whole FROM t)
        SELECT k, tracks::BIGINT AS tracks, CASE WHEN broken THEN 'unreadable' WHEN tracks > 0 THEN NULL WHEN has1 THEN 'undecodable' ELSE 'no_audio' END AS error,
               NOT broken AND k % 4 = 0 AND k % 8 <> 0 AS has_video, NOT broken AND k % 8 = 0 AS has_picture, CASE WHEN broken OR k % 13 = 0 THEN NULL ELSE r END AS duration, track::BIGINT AS track,
               CASE WHEN tracks > 0 THEN CASE WHEN stated IS NOT NULL THEN 'stated' WHEN whole IS NOT NULL THEN 'container' ELSE 'unknown' END END AS tier, coalesce(stated, whole)::BIGINT AS rate
        FROM u""",
    "default_stream": "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'F') DESC, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE -(o_orderkey % 6 + 1) END, o_orderkey) AS r FROM orders) WHERE r = 1",
    "bitrate_three_tier": """
        WITH o AS (SELECT o_orderkey, max(o_custkey) AS c FROM orders GROUP BY 1),
        w AS (SELECT *, (c % 120)::DOUBLE AS d, greatest(0, c % 120 / 2.0::DOUBLE - 15) AS start FROM o),
        x AS (SELECT *, CASE WHEN d > 1 AND least(30, d - start) > 1 THEN least(30, d - start) END AS len FROM w),
        s AS (SELECT o_orderkey, sum(floor(l_extendedprice)) AS bytes, coalesce(sum(CASE WHEN l_linenumber > 1 THEN l_quantity / 64 END), 0) AS span, max(len) AS len
              FROM x JOIN lineitem ON l_orderkey = o_orderkey WHERE (l_linenumber * 7 + l_partkey) % 120 >= start AND (l_linenumber * 7 + l_partkey) % 120 < start + len GROUP BY 1),
        r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND c > 0 THEN c END AS stated, CASE WHEN o_orderkey % 3 = 1 AND c > 0 THEN c * 2 END AS whole, CASE WHEN bytes > 0 THEN trunc(bytes * 8 / CASE WHEN span > 0.5 THEN span ELSE s.len END)::BIGINT END AS sampled
              FROM x LEFT JOIN s USING (o_orderkey))
        SELECT o_orderkey, CASE WHEN stated IS NOT NULL THEN 'stated' WHEN whole IS NOT NULL THEN 'container' WHEN sampled IS NOT NULL THEN 'sampled' ELSE 'unknown' END AS tier, coalesce(stated, whole, sampled) AS rate FROM r""",
    "variable_rates": f"""
        WITH v AS (SELECT l_orderkey AS k, count(DISTINCT [96, 128, 160][l_quantity::INT % 3 + 1]) > 1 AS is_vbr, avg([96, 128, 160][l_quantity::INT % 3 + 1]) AS a FROM lineitem GROUP BY 1)
        SELECT k, is_vbr, {r6("a")} AS average_kbps, {r6("CASE WHEN k % 4 = 0 AND k % 8 <> 0 AND k > 0 THEN k * 1152 / 44100.0::DOUBLE ELSE k * 1000 * 8 / (a * 1000) END")} AS seconds FROM v""",
    "container_ratios": f"""
        WITH p AS (SELECT p_partkey AS k, p_size::BIGINT AS s FROM part), a AS (SELECT *, greatest(0, s * 1000 - k % 3000 - 100) AS audio, (k * 10 % 7000) * (k % 3) * 16 // 8 AS raw FROM p)
        SELECT k, {r6("CASE WHEN audio > 0 AND raw > 0 THEN audio::DOUBLE / raw END")} AS ratio, {r6("CASE WHEN k % 5 <> 0 AND k % 4 > 0 AND k % 7 <> 0 THEN k * 48.0::DOUBLE / (k % 4 * 16000) END")} AS seconds,
               'CUESHEET=false PICTURE=' || (k % 2 = 0)::VARCHAR || ' STREAMINFO=true' AS blocks FROM a""",
    "scan_choices": """
        WITH e AS (SELECT doc_id, doc_id % 4 AS b, CASE WHEN doc_id % 4 = 2 THEN 'unreadable' WHEN doc_id % 3 = 0 THEN 'cutoff ' || doc_id % 3 WHEN doc_id % 5 = 0 THEN 'full band ' || doc_id % 3 WHEN doc_id % 2 = 0 THEN 'note ' || doc_id % 3 ELSE '' END AS headline FROM documents),
        c AS (SELECT * FROM (VALUES ('all', -1), ('suspicious', 0), ('undetermined', 1), ('errors', 2), ('lossless', 3)) v(choice, want))
        SELECT choice, headline, count(*) AS entries, count(*) FILTER (b = 0) AS suspicious FROM e JOIN c ON want = -1 OR want = b GROUP BY 1, 2""",
    "encoder_settings": f"""
        WITH {_CODECS_SQL}, l AS (SELECT list(codec ORDER BY rowid) AS names FROM (SELECT codec, row_number() OVER () AS rowid FROM codecs)),
        p AS (SELECT p_partkey AS k, [{", ".join(repr(c[0]) for c in present.CODECS)}][p_partkey % 13 + 1] AS codec, ['bitrate', 'quality', 'lossless'][p_partkey % 3 + 1] AS mode, CASE WHEN p_partkey % 5 <> 0 THEN 128 END AS kbps, (p_partkey % 14 - 2)::INT AS q FROM part),
        e AS (SELECT k, p.codec, mode, kbps, q, mark, CASE WHEN (mode = 'lossless') <> (len(rates) = 0) OR mode = 'quality' AND mark IS NULL THEN 'mode' WHEN mode = 'bitrate' AND kbps IS NULL THEN 'bitrate'
                     WHEN mode = 'quality' AND NOT coalesce(q BETWEEN low AND high, false) THEN 'quality' END AS error FROM p JOIN codecs USING (codec))
        SELECT k, error, CASE WHEN error IS NULL THEN codec || CASE mode WHEN 'bitrate' THEN kbps || 'k' WHEN 'quality' THEN mark || q ELSE '' END END AS label FROM e""",
    "ladder_rates": f"""
        WITH {_CODECS_SQL}, c AS (SELECT codec, rates, list_filter([96, 128, 160, 192, 256], lambda k: list_contains(rates, k)) AS common FROM codecs WHERE len(rates) > 0)
        SELECT codec, array_to_string(CASE WHEN len(common) >= 3 THEN common WHEN len(rates) <= 5 THEN rates ELSE list_transform([0, 1, 2, 3, 4], lambda i: rates[round_even(i * (len(rates) - 1) / 4.0, 0)::INT + 1]) END, ' ') AS rates, count(*) AS files, sum(n_chars)::BIGINT AS chars
        FROM documents JOIN c ON codec = [{", ".join(f"'{c}'" for c in _RATED)}][doc_id % {len(_RATED)} + 1] GROUP BY codec, rates, common""",
    "result_texts": f"""
        WITH o AS (SELECT o_orderkey AS k, [20.0, 50, 999, 1000, 1500, 4000, 16000, 21800]::DOUBLE[] AS hz, CASE WHEN o_orderkey % 19 <> 0 THEN (o_orderkey % 4001 - 2000) / 4.0::DOUBLE END AS s FROM orders),
        t AS (SELECT k, s, {_HZ("hz[k % 7 + 1]")} AS lo, {_HZ("hz[k % 7 + 2]")} AS hi FROM o)
        SELECT k, CASE WHEN k % 11 = 0 THEN '> 150 dB' WHEN k % 13 = 0 THEN '< -150 dB' WHEN k % 17 = 0 THEN '–' ELSE printf('%.1f', floor((k % 1000) / 8.0::DOUBLE * 10 + 0.5) / 10) || ' dB' END AS level,
               CASE WHEN lo LIKE '% kHz' AND hi LIKE '% kHz' THEN left(lo, -4) ELSE lo END || '–' || hi AS band,
               CASE WHEN s IS NULL THEN '–' WHEN abs(s) < 0.5 THEN printf('in sync (%.2f samples)', abs(s)) ELSE printf('%.3f ms %s (', abs(s) / 44100 * 1000, CASE WHEN s >= 0 THEN 'later' ELSE 'earlier' END) || printf('%.1f', floor(abs(s) * 10 + 0.5) / 10) || ' samples)' END AS delay
        FROM t""",
    "excerpt_starts": f"""
        WITH o AS (SELECT o_orderkey AS k, (o_orderkey % 50)::DOUBLE AS r, (o_orderkey % 37)::DOUBLE AS t, (o_orderkey % 21 - 10) / 2.0::DOUBLE AS d, (o_orderkey % 5 - 2) * 1e-4::DOUBLE AS s FROM orders),
        b AS (SELECT *, greatest(0, -d) + 0.5 AS lo, least(r, t - d) - 0.5 - 8 AS hi, greatest(0.0::DOUBLE, d * 100) AS a, least(t * 100, (r * 100 + d * 100) / (1 - s)) AS z FROM o)
        SELECT k, {r6("CASE WHEN hi >= lo THEN lo + (k % 10) / 10.0::DOUBLE * (hi - lo) END")} AS start_s, trunc(a + 0.02::DOUBLE * (z - a))::BIGINT AS first, trunc(z - 0.02::DOUBLE * (z - a))::BIGINT AS last FROM b""",
    "class_calibration": "SELECT quality::BIGINT AS quality, min(n_chars)::DOUBLE AS least, median(n_chars)::DOUBLE AS median, max(n_chars)::DOUBLE AS most, count(*) AS rows, count(*) FILTER (n_chars > 1000) AS decided FROM labels JOIN documents USING (doc_id) GROUP BY 1",
    "offset_frame_join": f"""
        WITH s AS (SELECT event_id - min(event_id) OVER () AS pos, value AS x FROM events), m AS (SELECT max(pos) + 38 AS n FROM s),
        f AS (SELECT t, i, x AS a, 0.5::DOUBLE * x AS b FROM (SELECT unnest(range(2, (n - 64) // 32 + 1)) AS t FROM m), (SELECT unnest(range(64)) AS i), s WHERE pos = t * 32 + i - 37),
        z AS (SELECT t, k AS bin, sum(a * cos(2 * pi() * k * i / 64)) AS are, -sum(a * sin(2 * pi() * k * i / 64)) AS aim, sum(b * cos(2 * pi() * k * i / 64)) AS bre, -sum(b * sin(2 * pi() * k * i / 64)) AS bim FROM f, (SELECT unnest(range(33)) AS k) GROUP BY t, k)
        SELECT bin, count(*) AS frames, {r6("10 * log10(sum(are * are + aim * aim))")} AS ref_db, {r6("10 * log10(sum(bre * bre + bim * bim))")} AS test_db, {r6("sum(are * bre + aim * bim) / sum(are * are + aim * aim)")} AS gain FROM z GROUP BY bin""",
    "pair_arrays": f"""
        WITH f AS (SELECT vec_id, embedding, least(vec_id % 60 + 1, vec_id % 47 + 5) AS n FROM embeddings),
        x AS (SELECT vec_id, n, i, (embedding[i + 1]::DOUBLE + (0.8::DOUBLE * embedding[i + 1]::DOUBLE + 0.01::DOUBLE * (((vec_id * 31 + i * 17) % 23) - 11))) / 2 AS m, 0.5 - 0.5 * cos(2 * pi() * i / n) AS w FROM f, (SELECT unnest(range(64)) AS i) WHERE i < n),
        g AS (SELECT vec_id, n, sum(m * m) AS power, sum(w * w) AS ww FROM x GROUP BY ALL)
        SELECT vec_id, n AS size, true AS finite, power = 0 AS silent, {r6("power")} AS power, {r6("CASE WHEN n > 1 AND ww > 0 THEN 4 / (n * ww) END")} AS scale FROM g""",
    "file_regions": """
        WITH p AS (SELECT p_partkey AS k, p_partkey * p_partkey * 997 AS size FROM part), r AS (SELECT *, least(65536, greatest(1, size // 5)) AS len FROM p)
        SELECT k, size > 1048576 AS sampled, i AS part, CASE WHEN size > 1048576 THEN (size - len) * i // 4 ELSE 0 END AS start, CASE WHEN size > 1048576 THEN len ELSE size END AS length
        FROM r, (SELECT unnest(range(5)) AS i) WHERE i = 0 OR size > 1048576""",
    "verified_excerpts": f"""
        WITH f AS (SELECT doc_id, n_chars / 10.0::DOUBLE AS d FROM documents), e AS (SELECT doc_id, i AS ord, CASE WHEN 0.95 * d - 30 <= 0.05 * d THEN 0 ELSE 0.05 * d + list_extract([0.5, 0.25, 0.75, 0.0, 1.0]::DOUBLE[], i + 1) * (0.95 * d - 30 - 0.05 * d) END AS start,
                     (doc_id * 7 + i * 13) % 60 AS frames, d FROM f, (SELECT unnest(range(5)) AS i) WHERE i = 0 OR 0.95 * d - 30 > 0.05 * d)
        SELECT doc_id, ord, {r6("start")} AS start, frames, tried FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS tried,
               row_number() OVER (PARTITION BY doc_id ORDER BY (frames >= 40) DESC, CASE WHEN frames >= 40 THEN 0 ELSE -frames END, ord) AS r FROM e) WHERE r = 1""",
    "pcm_checks": "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 5 <> 0 THEN doc_id % 3 <> 0 END AS matches FROM documents",
    "scalar_formulas": f"""SELECT p_partkey AS k, {r6("CASE WHEN p_partkey % 5 = 0 THEN -300.0::DOUBLE ELSE greatest(-300, 20 * log10(p_retailprice / 1000)) END")} AS db,
        CASE WHEN p_partkey <= 1 THEN 1 ELSE pow(2, ceil(log2(p_partkey - 0.5::DOUBLE)))::BIGINT END AS size, {r6("24.7 * (4.37::DOUBLE * p_retailprice / 1000 + 1)")} AS erb_hz, {r6("21.4 * log10(4.37::DOUBLE * p_retailprice / 1000 + 1)")} AS erb FROM part""",
    "scan_order": "SELECT source, doc_id, CASE WHEN doc_id % 4 <> 0 THEN n_chars / 10.0::DOUBLE END AS seconds, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN doc_id % 4 <> 0 THEN n_chars / 10.0::DOUBLE END ASC NULLS LAST, doc_id) AS place FROM documents",
}

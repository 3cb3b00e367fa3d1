"""Queries on trials, the library, ladders, texts, bytes and small dimensions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bits, privacy
from ..functions import numeric as n
from ..operators import library, metadata, trials
from ..sources import sinks
from . import roles
from .roles import r6

_RULES = "r1"


def _trials(spark, d):
    e = roles.table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    x, a = F.col("event_id") % 2, F.round(F.col("value") * 100).cast("long") % 2
    return e.select(F.col("user_id").alias("session"), F.row_number().over(w).cast("long").alias("trial"), (x == a).alias("correct"), (F.get_json_object("props", "$.k").cast("long") % 4).alias("switches"))


_TRIALS = """t AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS trial, event_id % 2 = round(value * 100)::BIGINT % 2 AS correct,
        json_extract(props, '$.k')::BIGINT % 4 AS switches FROM events)"""
_COUNTS = f"{_TRIALS}, c AS (SELECT session, count(*) AS n, count(*) FILTER (correct) AS k FROM t GROUP BY session)"


def abx_counts_flags(spark, d):
    t = _trials(spark, d)
    g = t.groupBy("session").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.sum("switches").alias("switches"), F.count_if(F.col("switches") == 0).alias("unheard"))
    return g.withColumn("rushed", F.col("unheard") * 2 > F.col("n"))


def abx_binomial_power(spark, d):
    """For the trials of each session and kind, a hundred at most: the least significant score, its chance, the power at 3 in 4, and whether it was reached."""
    null, alt = trials.binomial_tails(spark, 100), trials.binomial_tails(spark, 100, 0.75).withColumnRenamed("tail", "power")
    least = null.where("tail < 0.05").groupBy("n").agg(F.min("k").alias("k"))
    dim = least.join(null, ["n", "k"]).join(alt, ["n", "k"])
    e = roles.table(spark, d, "events")
    held = e.groupBy(F.col("user_id").alias("session"), F.col("event_type").alias("kind")).agg(F.least(F.count("*"), F.lit(100)).alias("n"), F.count_if(F.col("value") < 60).alias("correct"))
    rows = held.join(F.broadcast(dim), "n", "left")
    return rows.select("session", "kind", "n", F.col("k").alias("least_correct"), n.r6(F.col("tail")).alias("p"), n.r6(F.col("power")).alias("power"), (F.col("correct") >= F.col("k")).alias("reached"))


def abx_wilson_sidak(spark, d):
    g = _trials(spark, d).groupBy("session").agg(F.count("*").alias("n"), F.count_if("correct").alias("k"))
    low, high = n.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return g.select("session", "n", "k", n.r6(low).alias("low"), n.r6(high).alias("high"), n.r6(n.sidak(0.05, F.col("session") % 5)).alias("alpha"))


def abx_sprt(spark, d):
    s = trials.sequential(_trials(spark, d), key="session", order="trial", correct="correct")
    return s.select("session", "decision", "at", n.r6(F.col("llr")).alias("llr"))


def abx_verdict(spark, d):
    g = _trials(spark, d).where("trial <= 16").groupBy("session").agg(F.count("*").alias("n"), F.count_if("correct").alias("k"))
    p = g.join(F.broadcast(trials.binomial_tails(spark, 16)), ["n", "k"])
    low, _ = n.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    alpha = n.sidak(0.05, F.lit(1) + F.col("session") % 3)
    said = F.when(F.col("n") < 16, "none").when(F.col("tail") < alpha, "shown").when(low <= 0.5, "inconclusive").otherwise("not_shown")
    return p.select("session", "n", F.col("k").alias("correct"), n.r6(F.when(F.col("n") >= 16, F.col("tail"))).alias("p"), said.alias("verdict"))


def _files(spark, d):
    docs = roles.table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") * 1000).alias("mtime_ns"), F.lit(_RULES).alias("rules"), F.col("lang").alias("codec"), "source")


def _cache(spark, d):
    f = _files(spark, d).where("path % 3 <> 0")
    return f.withColumn("mtime_ns", F.when(F.col("path") % 7 == 0, F.col("mtime_ns") - 1).otherwise(F.col("mtime_ns")))


def cache_hits_misses(spark, d):
    hits, misses = library.split_by_cache(_files(spark, d), _cache(spark, d))
    return hits.select("path", F.lit("hit").alias("outcome")).unionByName(misses.select("path", F.lit("scan").alias("outcome")))


def cache_upsert_latest(spark, d):
    old = _cache(spark, d).select("path", "mtime_ns", F.lit(0).cast("long").alias("seen"))
    new = _files(spark, d).where("path % 2 = 0").select("path", "mtime_ns", F.lit(1).cast("long").alias("seen"))
    return library.upsert(old, new)


def _staged(spark, d):
    labels = roles.table(spark, d, "labels").select(F.col("doc_id").alias("path"), "quality", "toxic")
    f = _files(spark, d).join(labels, "path", "left")
    first = F.when(F.col("quality").isNull(), "undetermined").when(F.col("quality") == 1, "lossless").otherwise("lossy")
    second = F.when(F.col("size") > 2000, "lossless").when(F.col("size") > 500, "lossy").otherwise("undetermined")
    return library.staged(f, first, second, F.col("codec") != "de", F.col("size") < 30)


def staged_scan(spark, d):
    return _staged(spark, d).select("path", "bucket", "stage")


def bucket_summary(spark, d):
    g = _staged(spark, d).groupBy("bucket").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if(F.col("stage") == 2).alias("deep"))
    return g.withColumn("share", n.r6(F.col("files") / F.sum("files").over(Window.partitionBy(F.lit(1)))))


def csv_projection(spark, d):
    f = _staged(spark, d)
    rows = f.select(F.concat(F.lit("/music/"), F.col("codec"), F.lit("/"), F.col("path"), F.lit(".flac")).alias("path"), "bucket", F.when(F.col("quality").isNotNull(), F.col("size") * 3.5 + 0.25).alias("cutoff_hz"), "stage", F.when(F.col("path") % 3 == 0, F.concat(F.lit("cutoff, "), F.col("codec"))).alias("reason"), F.when(F.col("path") % 4 != 0, F.col("size") / 8).alias("seconds"))
    return sinks.csv_rows(rows)


_STAGED = f"""f AS (SELECT doc_id AS path, n_chars AS size, doc_id * 1000 AS mtime_ns, '{_RULES}' AS rules, lang AS codec, source FROM documents),
k AS (SELECT path, size, mtime_ns - (path % 7 = 0)::INT AS mtime_ns, rules FROM f WHERE path % 3 <> 0),
g AS (SELECT f.*, quality, toxic, CASE WHEN quality IS NULL THEN 'undetermined' WHEN quality = 1 THEN 'lossless' ELSE 'lossy' END AS one,
      CASE WHEN size > 2000 THEN 'lossless' WHEN size > 500 THEN 'lossy' ELSE 'undetermined' END AS two FROM f LEFT JOIN labels ON path = doc_id),
b AS (SELECT *, CASE WHEN size < 30 THEN 'error' WHEN codec = 'de' THEN 'lossy format' WHEN one <> 'undetermined' THEN one ELSE two END AS bucket,
      (CASE WHEN size < 30 OR codec = 'de' THEN 0 WHEN one <> 'undetermined' THEN 1 ELSE 2 END)::BIGINT AS stage FROM g)"""


def ladder_place(spark, d):
    """Each vector's first six values as a ladder, and all others as tests on it."""
    e = roles.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    rung = F.element_at(F.array(*[F.lit(x) for x in (64, 96, 128, 192, 256, 320)]), (F.col("k") + 1).cast("int")).cast("long")
    rungs = e.select("vec_id", F.posexplode(F.slice("v", 1, 6)).alias("k", "x")).select("vec_id", rung.alias("kbps"), (F.col("x") * 40 + F.col("k") * 6.0).alias("value"))
    tests = e.select("vec_id", F.posexplode("v").alias("k", "x")).where("k >= 6").select("vec_id", F.col("k").cast("long").alias("k"), (F.col("x") * 80 + 15).alias("test"))
    p = library.place(rungs, tests, "vec_id")
    return p.select("vec_id", "k", n.r6(F.col("test")).alias("test"), "position", n.r6(F.col("kbps")).alias("kbps"), "lower_kbps", "upper_kbps", "monotonic")


def combine_floors(spark, d):
    p = roles.table(spark, d, "part").select("p_partkey", F.col("p_retailprice") / 20, F.col("p_size") + 30.0, F.lit(96.0)).toDF("p_partkey", "a", "b", "c")
    return p.select("p_partkey", n.r6(n.combined_floor([F.col("a"), F.col("b"), F.col("c")])).alias("floor_db"))


def cutoff_label(spark, d):
    """Prices as cutoff frequencies in kHz against known encoder cutoffs; the first within 0.6 wins."""
    p = roles.table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") % 10 + 13).alias("khz"))
    label = None
    for khz, name in ((16.5, "128k"), (18.5, "160k"), (20.0, "256k")):
        near = F.abs(F.col("khz") - khz) <= 0.6
        label = F.when(near, name) if label is None else label.when(near, name)
    return p.select("p_partkey", n.r6(F.col("khz")).alias("khz"), label.alias("label"))


def mid_side(spark, d):
    rows = roles.table(spark, d, "lineitem").select("l_shipdate", F.col("l_quantity").alias("l"), (F.col("l_extendedprice") / 1000).alias("r"))
    g = rows.select("l_shipdate", ((F.col("l") + F.col("r")) / 2).alias("mid"), ((F.col("l") - F.col("r")) / 2).alias("side")).groupBy("l_shipdate")
    out = g.agg(F.sum(F.col("mid") ** 2).alias("m"), F.sum(F.col("side") ** 2).alias("s"), F.count("*").alias("samples"))
    side = F.when(F.col("s") > 1e-6 * F.col("m"), 10 * F.log10(F.col("s") / F.col("m")))
    return out.select(F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("day_s"), "samples", n.r6(F.sqrt(F.col("m") / F.col("samples"))).alias("mid_rms"), n.r6(side).alias("side_db"))


def channel_map(spark, d):
    """Two channels against a copy that has them swapped for returned lines: which way round they correlate."""
    rows = roles.table(spark, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("l"), (F.col("l_tax") * 100 + F.col("l_quantity") / 10).alias("r"))
    swapped = F.col("l_returnflag") == "R"
    rows = rows.select("*", F.when(swapped, F.col("r")).otherwise(F.col("l")).alias("tl"), (F.when(swapped, F.col("l")).otherwise(F.col("r")) + F.col("l") / 20).alias("tr"))
    together = lambda a, b, c, e: F.abs(F.corr(a, b)) + F.abs(F.corr(c, e))
    c = rows.groupBy("l_returnflag").agg(together("l", "tl", "r", "tr").alias("straight"), together("l", "tr", "r", "tl").alias("crossed"))
    return c.select("l_returnflag", n.r6(F.col("straight")).alias("straight"), n.r6(F.col("crossed")).alias("crossed"), (F.col("crossed") > F.col("straight") + 1e-9).alias("swap"))


_SECRETS, _NAMES = [r"C:\Users\maria\Music", "  ", "ab"], ["maria"]
_INJECT = [r"C:\Users\maria\Music\Track 01.flac", r"see D:\Secret Folder\x.flac now", r"\\share\dir\maria\y", "https://host/maria.txt", "mariachi", "E:/only/dir/"]


def _injected(spark, d):
    docs = roles.table(spark, d, "documents")
    path = F.element_at(F.array(*map(F.lit, _INJECT)), (F.col("doc_id") % len(_INJECT) + 1).cast("int"))
    return docs.select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(' "'), path, F.lit('" end')).alias("text"))


def privacy_scrub(spark, d):
    clean = _injected(spark, d).select("doc_id", privacy.scrub(F.col("text"), _SECRETS, _NAMES).alias("text"))
    return clean.select("doc_id", F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("md5"))


def privacy_audit(spark, d):
    found = privacy.audit(F.col("text"), _SECRETS, _NAMES)
    return _injected(spark, d).select("doc_id", F.size(found).cast("long").alias("leaks"), F.size(privacy.audit(privacy.scrub(F.col("text"), _SECRETS, _NAMES), _SECRETS, _NAMES)).cast("long").alias("left"))


def content_id(spark, d):
    return roles.table(spark, d, "documents").select("doc_id", privacy.content_id(F.col("text").cast("binary"), 64).alias("content_id"))


def basename(spark, d):
    return roles.table(spark, d, "pages").select("page_id", privacy.basename(F.col("url")).alias("name"))


def packet_reassembly(spark, d):
    """Events of a user as lacing values: a value below 255 ends a packet, and the last one may be unfinished."""
    k = F.get_json_object("props", "$.k").cast("long")
    segments = roles.table(spark, d, "events").select("user_id", "event_id", F.when(k < 40, 255).otherwise(k).cast("long").alias("v"))
    return metadata.reassembled(segments, "user_id", "event_id", "v")


def toc_histogram(spark, d):
    """Packets by kind; every fifth second byte is missing, and packets that can't be decoded are a kind of their own."""
    second = F.when(F.col("event_id") % 5 != 0, F.col("event_id") * 37 % 256)
    e = roles.table(spark, d, "events").select((F.get_json_object("props", "$.k").cast("long") * 5 % 256).alias("byte"), second.alias("second"), "event_id")
    t = e.select("event_id", bits.toc(F.col("byte"), F.col("second")).alias("t")).select("event_id", "t.*")
    return t.groupBy("mode", "frame_ms", "stereo").agg(F.count("*").alias("packets"), F.sum("frames").alias("frames"), n.r6(F.sum(F.col("frames") * F.col("frame_ms"))).alias("ms"), F.min("event_id").alias("first_seen"))


def synchsafe_and_bitunpack(spark, d):
    o = roles.table(spark, d, "orders").select("o_orderkey")
    k = F.col("o_orderkey") * 977 % (1 << 28)
    safe = bits.to_synchsafe(k)
    return o.select("o_orderkey", bits.synchsafe(*safe).alias("value"), F.concat_ws(".", *safe).alias("coded"), bits.bits(k, 12, 16).alias("field")).distinct()


def rate_choice(spark, d):
    """The smallest allowed rate not below the source's, else the largest."""
    rates = [8000, 12000, 16000, 24000, 48000]
    p = roles.table(spark, d, "part").select("p_partkey", (F.col("p_size") * 1000).cast("long").alias("source"))
    fits = F.array_min(F.filter(F.array(*(F.lit(r).cast("long") for r in rates)), lambda r: r >= F.col("source")))
    return p.select("p_partkey", "source", F.coalesce(fits, F.lit(max(rates)).cast("long")).alias("rate"))


def codec_availability(spark, d):
    """Languages as codecs: which of a fixed list the tables offer, with a reason for each that is missing."""
    wanted = spark.createDataFrame([(c,) for c in ("en", "de", "fr", "es", "it", "pt")], "codec string")
    have = roles.table(spark, d, "documents").groupBy(F.col("lang").alias("codec")).agg(F.count("*").alias("files"))
    j = wanted.join(F.broadcast(have), "codec", "left")
    return j.select("codec", F.coalesce("files", F.lit(0)).cast("long").alias("files"), F.when(F.col("files").isNull(), F.concat(F.lit("no encoder for "), F.col("codec"))).alias("reason"))


def missing_required(spark, d):
    wanted = spark.createDataFrame([(c,) for c in ("view", "purchase", "login", "decode", "encode")], "name string")
    return wanted.exceptAll(roles.table(spark, d, "events").select(F.col("event_type").alias("name")).distinct())


def localise_messages(spark, d):
    """Message keys looked up in a partial dictionary, falling back to the key."""
    words = spark.createDataFrame([("user", "en", "User"), ("user", "de", "Nutzer"), ("assistant", "en", "Assistant")], "role string, lang string, label string")
    m = roles.table(spark, d, "conversations").select("conv_id", "turn", "role", F.element_at(F.array(F.lit("de"), F.lit("en"), F.lit("fr")), (F.col("conv_id") % 3 + 1).cast("int")).alias("lang"))
    own, english = words.withColumnRenamed("label", "own"), words.where("lang = 'en'").select("role", F.col("label").alias("en"))
    return m.join(F.broadcast(own), ["role", "lang"], "left").join(F.broadcast(english), "role", "left").select("conv_id", "turn", "lang", F.coalesce("own", "en", "role").alias("label"))


def excerpt_candidates(spark, d):
    f = roles.table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 11 != 0, F.col("n_chars") / 10.0).alias("duration"))
    return f.select("doc_id", F.posexplode(library.excerpt_starts(F.col("duration"), 30.0)).alias("ord", "start")).select("doc_id", F.col("ord").cast("long").alias("ord"), n.r6(F.col("start")).alias("start_s"))


QUERIES = {f.__name__: f for f in (abx_counts_flags, abx_binomial_power, abx_wilson_sidak, abx_sprt, abx_verdict, cache_hits_misses, cache_upsert_latest, staged_scan, bucket_summary, csv_projection, ladder_place, combine_floors, cutoff_label, mid_side, channel_map, privacy_scrub, privacy_audit, content_id, basename, packet_reassembly, toc_histogram, synchsafe_and_bitunpack, rate_choice, codec_availability, missing_required, localise_messages, excerpt_candidates)}

_Z = n.WILSON_Z
_LOW = f"greatest(0.0, (k / n::DOUBLE + {_Z * _Z!r} / (2 * n) - {_Z} * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + {_Z * _Z!r} / (4.0 * n * n))) / (1 + {_Z * _Z!r} / n))"
_HIGH = _LOW.replace("greatest(0.0", "least(1.0").replace(f"- {_Z} * sqrt", f"+ {_Z} * sqrt")
_TAIL = """lf AS (SELECT n, sum(ln(greatest(n, 1)::DOUBLE)) OVER (ORDER BY n) AS lf FROM (SELECT unnest(range({most} + 1)) AS n)),
tm AS (SELECT a.n, b.n AS k, exp(a.lf - b.lf - c.lf + b.n * ln(0.5) + (a.n - b.n) * ln(0.5)) AS t0, exp(a.lf - b.lf - c.lf + b.n * ln(0.75) + (a.n - b.n) * ln(0.25)) AS t1 FROM lf a JOIN lf b ON b.n <= a.n JOIN lf c ON c.n = a.n - b.n),
tl AS (SELECT n, k, sum(t0) OVER (PARTITION BY n ORDER BY k DESC) AS tail, sum(t1) OVER (PARTITION BY n ORDER BY k DESC) AS power FROM tm)"""
_UP, _LO, _R, _W = n.wald_bounds()
_INJ = "inj AS (SELECT doc_id, coalesce(text, '') || ' \"' || [" + ", ".join("'" + x.replace("'", "''") + "'" for x in _INJECT) + "][doc_id % 6 + 1] || '\" end' AS text, coalesce(text, '') AS head FROM documents)"

SQL = {
    "abx_counts_flags": f"""WITH {_TRIALS} SELECT session, count(*) AS n, count(*) FILTER (correct) AS correct, sum(switches)::BIGINT AS switches, count(*) FILTER (switches = 0) AS unheard,
        count(*) FILTER (switches = 0) * 2 > count(*) AS rushed FROM t GROUP BY session""",
    "abx_binomial_power": f"""WITH {_TAIL.format(most=100)}, dm AS (SELECT * FROM tl WHERE tail < 0.05 QUALIFY row_number() OVER (PARTITION BY n ORDER BY k) = 1),
        h AS (SELECT user_id AS session, event_type AS kind, least(count(*), 100) AS n, count(*) FILTER (value < 60) AS correct FROM events GROUP BY ALL)
        SELECT session, kind, n, k AS least_correct, {r6('tail')} AS p, {r6('power')} AS power, correct >= k AS reached FROM h LEFT JOIN dm USING (n)""",
    "abx_wilson_sidak": f"WITH {_COUNTS} SELECT session, n, k, {r6(_LOW)} AS low, {r6(_HIGH)} AS high, {r6('CASE WHEN session % 5 <= 1 THEN 0.05 ELSE 1 - pow(0.95::DOUBLE, 1.0::DOUBLE / (session % 5)) END')} AS alpha FROM c",
    "abx_sprt": f"""WITH {_TRIALS}, l AS (SELECT session, trial, sum(CASE WHEN correct THEN {_R!r}::DOUBLE ELSE {_W!r}::DOUBLE END) OVER (PARTITION BY session ORDER BY trial) AS llr FROM t WHERE trial <= 50 ORDER BY session, trial),
        s AS (SELECT *, CASE WHEN llr >= {_UP!r} THEN 'shown' WHEN llr <= {_LO!r} THEN 'not_shown' WHEN trial = 50 THEN 'inconclusive' END AS said FROM l),
        g AS (SELECT session, max(trial) AS n, min(trial) FILTER (said IS NOT NULL) AS at_ FROM s GROUP BY session)
        SELECT g.session, coalesce(said, 'open') AS decision, coalesce(at_, n) AS at, {r6("llr")} AS llr FROM g LEFT JOIN s ON s.session = g.session AND s.trial = g.at_""",
    "abx_verdict": f"""WITH {_TRIALS}, c AS (SELECT session, count(*) AS n, count(*) FILTER (correct) AS k FROM t WHERE trial <= 16 GROUP BY session), {_TAIL.format(most=16)},
        v AS (SELECT session, c.n, c.k, tail, {_LOW.replace("k /", "c.k /").replace("n::", "c.n::").replace("/ n", "/ c.n").replace("* n", "* c.n")} AS low, CASE WHEN session % 3 = 0 THEN 0.05 ELSE 1 - pow(0.95::DOUBLE, 1.0::DOUBLE / (1 + session % 3)) END AS alpha FROM c JOIN tl ON c.n = tl.n AND c.k = tl.k)
        SELECT session, n, k AS correct, {r6("CASE WHEN n >= 16 THEN tail END")} AS p, CASE WHEN n < 16 THEN 'none' WHEN tail < alpha THEN 'shown' WHEN low <= 0.5 THEN 'inconclusive' ELSE 'not_shown' END AS verdict FROM v""",
    "cache_hits_misses": f"WITH {_STAGED} SELECT f.path, CASE WHEN k.path IS NULL THEN 'scan' ELSE 'hit' END AS outcome FROM f LEFT JOIN k USING (path, size, mtime_ns, rules)",
    "cache_upsert_latest": f"WITH {_STAGED}, u AS (SELECT path, mtime_ns, 0::BIGINT AS seen FROM k UNION ALL SELECT path, mtime_ns, 1::BIGINT FROM f WHERE path % 2 = 0) SELECT path, arg_max(mtime_ns, seen) AS mtime_ns, max(seen) AS seen FROM u GROUP BY path",
    "staged_scan": f"WITH {_STAGED} SELECT path, bucket, stage FROM b",
    "bucket_summary": f"WITH {_STAGED} SELECT bucket, count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (stage = 2) AS deep, {r6('count(*) / sum(count(*)) OVER ()')} AS share FROM b GROUP BY bucket",
    "csv_projection": f"""WITH {_STAGED} SELECT path || '.flac' AS file, bucket AS verdict, CASE WHEN quality IS NULL THEN '' ELSE printf('%.2f', floor((size * 3.5::DOUBLE + 0.25) / 1000 * 100 + 0.5) / 100) END AS cutoff_khz, stage,
        CASE WHEN path % 3 = 0 THEN 'cutoff, ' || codec ELSE '' END AS reason, CASE WHEN path % 4 <> 0 THEN printf('%.2f', floor(size / 8.0::DOUBLE * 100 + 0.5) / 100) ELSE '' END AS seconds FROM b""",
    "ladder_place": f"""WITH e AS (SELECT vec_id, embedding AS v FROM embeddings),
        r AS (SELECT vec_id, [64, 96, 128, 192, 256, 320][k + 1]::BIGINT AS kbps, v[k + 1]::DOUBLE * 40 + k * 6.0::DOUBLE AS value FROM e, (SELECT unnest(range(6)) AS k)),
        a AS (SELECT *, max(value) OVER (PARTITION BY vec_id ORDER BY kbps) AS axis, value > lag(value) OVER (PARTITION BY vec_id ORDER BY kbps) AS rises FROM r),
        i AS (SELECT *, lead(axis) OVER (PARTITION BY vec_id ORDER BY kbps) AS nx, lead(kbps) OVER (PARTITION BY vec_id ORDER BY kbps) AS nk FROM a),
        m AS (SELECT vec_id, max(value) AS top, min(value) AS bottom, bool_and(rises) AS monotonic, arg_max(kbps, value) AS tk, arg_min(kbps, value) AS bk FROM a GROUP BY vec_id),
        x AS (SELECT vec_id, k, v[k + 1]::DOUBLE * 80 + 15 AS test FROM e, (SELECT unnest(range(6, 64)) AS k)),
        t AS (SELECT x.*, m.* EXCLUDE (vec_id), CASE WHEN test >= top THEN 'above' WHEN test <= bottom THEN 'below' ELSE 'within' END AS position FROM x JOIN m USING (vec_id))
        SELECT t.vec_id, k, {r6("test")} AS test, position, {r6("pow(2.0, log2(kbps) + (test - axis) / (nx - axis) * (log2(nk) - log2(kbps)))")} AS kbps,
               CASE position WHEN 'within' THEN kbps WHEN 'above' THEN tk END AS lower_kbps, CASE position WHEN 'within' THEN nk WHEN 'below' THEN bk END AS upper_kbps, monotonic
        FROM t LEFT JOIN i ON i.vec_id = t.vec_id AND position = 'within' AND nx > axis AND test >= axis AND test < nx""",
    "combine_floors": f"SELECT p_partkey, {r6('-10 * log10(pow(10.0, -(p_retailprice / 20) / 10) + pow(10.0, -(p_size + 30.0::DOUBLE) / 10) + pow(10.0, -96.0::DOUBLE / 10))')} AS floor_db FROM part",
    "cutoff_label": f"WITH p AS (SELECT p_partkey, p_retailprice % 10 + 13 AS khz FROM part) SELECT p_partkey, {r6('khz')} AS khz, CASE WHEN abs(khz - 16.5) <= 0.6 THEN '128k' WHEN abs(khz - 18.5) <= 0.6 THEN '160k' WHEN abs(khz - 20.0) <= 0.6 THEN '256k' END AS label FROM p",
    "mid_side": f"""WITH s AS (SELECT l_shipdate, count(*) AS samples, sum(pow((l_quantity + l_extendedprice / 1000) / 2, 2)) AS m, sum(pow((l_quantity - l_extendedprice / 1000) / 2, 2)) AS s FROM lineitem GROUP BY l_shipdate)
        SELECT epoch(l_shipdate)::BIGINT AS day_s, samples, {r6("sqrt(m / samples)")} AS mid_rms, {r6("CASE WHEN s > 1e-6 * m THEN 10 * log10(s / m) END")} AS side_db FROM s""",
    "channel_map": f"""WITH s AS (SELECT l_returnflag, l_quantity AS l, l_tax * 100 + l_quantity / 10 AS r FROM lineitem), t AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN r ELSE l END AS tl, CASE WHEN l_returnflag = 'R' THEN l ELSE r END + l / 20 AS tr FROM s),
        c AS (SELECT l_returnflag, abs(corr(l, tl)) + abs(corr(r, tr)) AS straight, abs(corr(l, tr)) + abs(corr(r, tl)) AS crossed FROM t GROUP BY 1)
        SELECT l_returnflag, {r6("straight")} AS straight, {r6("crossed")} AS crossed, crossed > straight + 1e-9 AS swap FROM c""",
    "privacy_scrub": f"""WITH {_INJ}, c AS (SELECT doc_id, regexp_replace(head, '(^|[^A-Za-z0-9])maria($|[^A-Za-z0-9])', '\\1<REDACTED>\\2', 'gi') || ' "' || ['<REDACTED>\\Track 01.flac', 'see x.flac now', '<PATH><REDACTED>\\y', 'https://host/<REDACTED>.txt', 'mariachi', 'dir'][doc_id % 6 + 1] || '" end' AS text FROM inj)
        SELECT doc_id, length(text) AS n, md5(text) AS md5 FROM c""",
    "privacy_audit": rf"""WITH {_INJ} SELECT doc_id, contains(text, 'C:\Users\maria\Music')::BIGINT + len(regexp_extract_all(text, '(?i)[\\/]maria(?:[\\/\s"''<>|]|$)')) + len(regexp_extract_all(text, '(?:^|[^A-Za-z])[A-Za-z]:[\\/]|\\\\')) AS leaks, 0::BIGINT AS left FROM inj""",
    "content_id": "SELECT doc_id, left(sha256(encode(octet_length(encode(text))::VARCHAR) || b[1:64] || CASE WHEN octet_length(encode(text)) > 128 THEN b[-64:] ELSE ''::BLOB END), 16) AS content_id FROM (SELECT doc_id, text, encode(text) AS b FROM documents)",
    "basename": "SELECT page_id, string_split_regex(url, '[/\\\\]')[-1] AS name FROM pages",
    "packet_reassembly": """WITH s AS (SELECT user_id, event_id, CASE WHEN json_extract(props, '$.k')::BIGINT < 40 THEN 255 ELSE json_extract(props, '$.k')::BIGINT END AS v FROM events),
        p AS (SELECT *, coalesce(sum((v < 255)::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS packet FROM s)
        SELECT user_id, packet, sum(v)::BIGINT AS bytes, count(*) AS segments, bool_or(v < 255) AS complete FROM p GROUP BY 1, 2""",
    "toc_histogram": f"""WITH e AS (SELECT event_id, json_extract(props, '$.k')::BIGINT * 5 % 256 AS b FROM events),
        g AS (SELECT event_id, b, nullif(CASE b & 3 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE CASE WHEN event_id % 5 <> 0 THEN (event_id * 37 % 256) & 63 END END, 0) AS frames FROM e),
        c AS (SELECT event_id, frames, CASE WHEN frames > 0 THEN b >> 3 END AS c, CASE WHEN frames > 0 THEN (b >> 2) & 1 = 1 END AS stereo FROM g),
        t AS (SELECT *, CASE WHEN c IS NULL THEN NULL WHEN c < 12 THEN 'silk' WHEN c < 16 THEN 'hybrid' ELSE 'celt' END AS mode, (CASE WHEN c IS NULL THEN NULL WHEN c < 12 THEN [10.0, 20.0, 40.0, 60.0][c % 4 + 1] WHEN c < 16 THEN [10.0, 20.0][c % 2 + 1] ELSE [2.5, 5.0, 10.0, 20.0][c % 4 + 1] END)::DOUBLE AS frame_ms FROM c)
        SELECT mode, frame_ms, stereo, count(*) AS packets, sum(frames)::BIGINT AS frames, {r6("sum(frames * frame_ms)")} AS ms, min(event_id) AS first_seen FROM t GROUP BY mode, frame_ms, stereo""",
    "synchsafe_and_bitunpack": "WITH k AS (SELECT DISTINCT o_orderkey, o_orderkey * 977 % 268435456 AS k FROM orders) SELECT o_orderkey, k AS value, (k >> 21) || '.' || ((k >> 14) & 127) || '.' || ((k >> 7) & 127) || '.' || (k & 127) AS coded, (k >> 12) & 65535 AS field FROM k",
    "rate_choice": "SELECT p_partkey, p_size::BIGINT * 1000 AS source, coalesce(list_min(list_filter([8000, 12000, 16000, 24000, 48000]::BIGINT[], lambda r: r >= p_size::BIGINT * 1000)), 48000) AS rate FROM part",
    "codec_availability": "WITH w AS (SELECT unnest(['en', 'de', 'fr', 'es', 'it', 'pt']) AS codec), h AS (SELECT lang, count(*) AS c FROM documents GROUP BY lang) SELECT codec, coalesce(c, 0)::BIGINT AS files, CASE WHEN c IS NULL THEN 'no encoder for ' || codec END AS reason FROM w LEFT JOIN h ON codec = lang",
    "missing_required": "SELECT unnest(['view', 'purchase', 'login', 'decode', 'encode']) AS name EXCEPT SELECT event_type FROM events",
    "localise_messages": """WITH w AS (SELECT * FROM (VALUES ('user', 'en', 'User'), ('user', 'de', 'Nutzer'), ('assistant', 'en', 'Assistant')) v(role, lang, label)), m AS (SELECT conv_id, turn, role, ['de', 'en', 'fr'][conv_id % 3 + 1] AS lang FROM conversations)
        SELECT conv_id, turn, m.lang, coalesce(o.label, e.label, m.role) AS label FROM m LEFT JOIN w o ON o.role = m.role AND o.lang = m.lang LEFT JOIN w e ON e.role = m.role AND e.lang = 'en'""",
    "excerpt_candidates": f"""WITH f AS (SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN n_chars / 10.0::DOUBLE END AS d FROM documents)
        SELECT doc_id, o AS ord, CASE WHEN d IS NULL THEN NULL WHEN d <= 30 THEN 0.0 ELSE {r6("([0.5, 0.25, 0.75, 0.1, 0.9]::DOUBLE[])[o + 1] * (d - 30)")} END AS start_s FROM f, (SELECT unnest(range(5)) AS o) WHERE o = 0 OR d > 30""",
}

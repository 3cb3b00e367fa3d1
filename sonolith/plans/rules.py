"""Queries on decision rules, over role columns of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as n
from ..operators import rules
from . import roles
from .roles import r6

_VENDORS = ["reference libFLAC 1.3.2", "Lavf58.29.100", "Mutagen 1.45.1", "", "Custom 2"]
_CONTAINERS = ["mov,mp4,m4a", "flac", "ogg", "matroska, wav"]
_CODECS = ["pcm_s16le", "flac", "opus"]
_HELP = "  Supported sample rates: 48000 24000 16000 12000 8000\n  Supported channel layouts: mono stereo 5.1\n"


def _pick(values, index):
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def container_notes(spark, d):
    p = roles.table(spark, d, "part")
    v = _pick(_VENDORS, F.col("p_partkey") % 5)
    notes = rules.container_notes(v, F.col("p_partkey") % 3 != 0, F.col("p_size") * 20, F.when(F.col("p_partkey") % 7 != 0, (F.col("p_partkey") % 90 + 1) / 100))
    return p.select("p_partkey", rules.encoder_family(v).alias("family"), F.array_join(notes, "|").alias("notes"))


def seek_whitelist(spark, d):
    p = roles.table(spark, d, "part").select("p_partkey", _pick(_CONTAINERS, F.col("p_partkey") % 4).alias("container"), _pick(_CODECS, F.col("p_partkey") % 3).alias("codec"))
    return p.select("*", rules.seek_exact(F.col("container"), F.col("codec")).alias("exact"))


def encode_jobs(spark, d):
    """Jobs against the limits of an encoder's help text."""
    p = roles.table(spark, d, "part").select(
        "p_partkey", _pick(["libopus", "libvorbis", "libmp3"], F.col("p_partkey") % 3).alias("codec"), _pick(["stereo", "5.1(side)", "7.1(wide)"], F.col("p_size") % 3).alias("layout"),
        (F.col("p_size") % 9).cast("long").alias("channels"), _pick([8000, 44100, 48000, 96000], F.col("p_size") % 4).cast("long").alias("rate"), F.when(F.col("p_partkey") % 2 == 0, 128).alias("kbps"), F.lit(_HELP).alias("help"),
    )
    rates, most = rules.encoder_limits(F.col("help"))
    p = p.withColumn("rates", F.when(F.col("codec") != "libvorbis", rates)).withColumn("most", most)
    job = rules.prepared_job(F.col("codec"), F.col("layout"), F.col("channels"), F.col("rate"), F.col("kbps"), F.col("rates"), F.col("most"))
    return p.select("p_partkey", "most", job.alias("j")).select("p_partkey", "most", "j.error", "j.target_rate", "j.relabel")


def alignment_verdict(spark, d):
    o = roles.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 2500 - 1250).alias("ppm"), (F.col("o_totalprice") % 1000 / 1000).alias("rho"), (F.col("o_orderkey") % 6000).alias("overlap"), F.col("o_custkey").alias("k"))
    v = rules.alignment_verdict(F.when(F.col("k") % 17 == 0, "pal_up"), F.col("ppm"), F.col("k") % 13 == 0, F.col("rho"), F.col("k") % 5 == 0, F.col("k") % 11 == 0, F.col("rho") + 0.2, F.col("overlap"), F.col("k") % 7 != 0, F.col("k") % 3, F.col("rho"))
    return o.select("o_orderkey", v.alias("verdict")).distinct()


def result_headlines(spark, d):
    o = roles.table(spark, d, "orders")
    snr = F.when(F.col("o_orderkey") % 5 != 0, F.floor(F.col("o_totalprice") / 1000) / 4)
    h = rules.headline(_pick(["measured", "not_measured"], (F.col("o_orderkey") % 4 == 0).cast("int")), _pick(["aligned", "different_master", "unaligned"], F.col("o_custkey") % 3), snr, F.col("o_orderkey") % 2)
    return o.select("o_orderkey", h.alias("h")).select("o_orderkey", "h.*")


def lobe_ratio(spark, d):
    e = roles.frames(spark, d).select("vec_id", F.posexplode("a").alias("i", "x")).select("vec_id", F.col("i").cast("long").alias("i"), F.abs("x").alias("m"))
    return rules.lobe_ratio(e, "vec_id", "i", "m").select("vec_id", n.r6(F.col("ratio")).alias("ratio"))


def crossfade_render(spark, d):
    s = roles.series(spark, d)
    return s.select("pos", n.r6(rules.crossfade(F.col("x"), -F.col("x"), F.col("pos"), 400, 64)).alias("y"))


def drift_windows(spark, d):
    p = roles.table(spark, d, "part")
    return p.select("p_partkey", rules.window_length(F.lit(48_000), 0.5, (F.col("p_size") - 25).cast("double")).alias("frames"))


QUERIES = {f.__name__: f for f in (container_notes, seek_whitelist, encode_jobs, alignment_verdict, result_headlines, lobe_ratio, crossfade_render, drift_windows)}

_EXACT = "', '".join(f"{a}/{b}" for a, b in rules.SEEK_EXACT)
SQL = {
    "container_notes": f"""WITH v AS (SELECT p_partkey, p_size * 20 AS blk, {_VENDORS!r}[p_partkey % 5 + 1] AS v, p_partkey % 3 <> 0 AS md5, CASE WHEN p_partkey % 7 <> 0 THEN (p_partkey % 90 + 1) / 100 END AS ratio FROM part),
        f AS (SELECT *, CASE p_partkey % 5 WHEN 0 THEN 'reference libFLAC' WHEN 1 THEN 'ffmpeg' WHEN 4 THEN 'Custom 2' END AS family FROM v)
        SELECT p_partkey, family, array_to_string(list_filter([CASE WHEN p_partkey % 5 = 2 THEN 'vendor_rewritten' ELSE 'encoder ' || family END, CASE WHEN NOT md5 THEN 'no_md5' END,
               CASE WHEN blk < 256 THEN 'blocksize' ELSE 'ratio ' || format('{{:.2f}}', ratio) END], lambda x: x IS NOT NULL), '|') AS notes FROM f""",
    "seek_whitelist": f"""WITH p AS (SELECT p_partkey, {_CONTAINERS!r}[p_partkey % 4 + 1] AS container, {_CODECS!r}[p_partkey % 3 + 1] AS codec FROM part)
        SELECT *, len(list_filter(string_split(container, ','), lambda c: (trim(c) || '/' || codec) IN ('{_EXACT}'))) > 0 AS exact FROM p""",
    "encode_jobs": """WITH p AS (SELECT p_partkey, ['libopus', 'libvorbis', 'libmp3'][p_partkey % 3 + 1] AS codec, ['stereo', '5.1(side)', '7.1(wide)'][p_size % 3 + 1] AS layout, p_size % 9 AS channels, [8000, 44100, 48000, 96000][p_size % 4 + 1] AS rate, p_partkey % 2 = 0 AS kbps FROM part),
        e AS (SELECT *, CASE WHEN channels > 6 THEN 'too_many_channels' WHEN codec = 'libopus' AND layout = '7.1(wide)' THEN 'layout' END AS error,
              CASE WHEN codec = 'libvorbis' THEN CASE WHEN kbps AND rate > 48000 THEN [48000] END ELSE [48000, 24000, 16000, 12000, 8000] END AS rates FROM p)
        SELECT p_partkey, 6::BIGINT AS most, error, CASE WHEN error IS NULL AND rates IS NOT NULL AND NOT list_contains(rates, rate) THEN coalesce(list_min(list_filter(rates, lambda r: r >= rate)), list_max(rates)) END::BIGINT AS target_rate,
               CASE WHEN error IS NULL AND codec = 'libopus' AND layout = '5.1(side)' THEN '5.1' END AS relabel FROM e""",
    "alignment_verdict": """WITH o AS (SELECT o_orderkey, o_orderkey % 2500 - 1250 AS ppm, o_totalprice % 1000 / 1000 AS rho, o_orderkey % 6000 AS overlap, o_custkey AS k FROM orders)
        SELECT DISTINCT o_orderkey, CASE WHEN k % 17 = 0 OR abs(ppm) > 1000 THEN 'speed_mismatch' WHEN k % 13 = 0 THEN 'unaligned' WHEN rho < 0.7 AND k % 5 <> 0 THEN CASE WHEN k % 11 = 0 OR rho + 0.2 >= 0.7 THEN 'unaligned' ELSE 'different_recording' END
        WHEN overlap < 4096 THEN 'unaligned' WHEN k % 7 = 0 THEN 'channel_mismatch' WHEN k % 3 = 0 THEN 'unaligned' WHEN rho < 0.6 THEN 'different_master' ELSE 'aligned' END AS verdict FROM o""",
    "result_headlines": """WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN floor(o_totalprice / 1000) / 4 END AS snr, o_orderkey % 4 <> 0 AS measured, ['aligned', 'different_master', 'unaligned'][o_custkey % 3 + 1] AS verdict FROM orders)
        SELECT o_orderkey, CASE WHEN measured AND snr IS NULL THEN 'identical to the floor' WHEN measured THEN (floor(snr * 10 + 0.5) / 10)::DECIMAL(18, 1)::VARCHAR || ' dB' ELSE verdict END AS title,
               CASE WHEN NOT measured THEN 'bad' WHEN o_orderkey % 2 > 0 OR verdict = 'different_master' THEN 'warn' WHEN snr IS NULL THEN 'good' ELSE 'neutral' END AS tone FROM o""",
    "lobe_ratio": f"""WITH f AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t, embedding FROM embeddings), m AS (SELECT vec_id, i, abs(embedding[i + 1]::DOUBLE) AS m FROM f, (SELECT unnest(range(64)) AS i)),
        p AS (SELECT vec_id, max(m) AS pm, min(i) AS pi FROM m JOIN (SELECT vec_id, max(m) AS pm FROM m GROUP BY 1) x USING (vec_id) WHERE m = pm GROUP BY vec_id),
        c AS (SELECT vec_id, pm, m, (i - pi + 64 + 32) % 64 - 32 AS d FROM m JOIN p USING (vec_id)),
        u AS (SELECT *, (d > 0 AND m > lag(m) OVER (PARTITION BY vec_id ORDER BY d))::INT AS ur, (d < 0 AND m > lead(m) OVER (PARTITION BY vec_id ORDER BY d))::INT AS ul FROM c),
        o AS (SELECT *, coalesce(max(ur) OVER (PARTITION BY vec_id ORDER BY d ROWS UNBOUNDED PRECEDING), 0) + coalesce(max(ul) OVER (PARTITION BY vec_id ORDER BY d DESC ROWS UNBOUNDED PRECEDING), 0) AS gone FROM u)
        SELECT vec_id, {r6("coalesce(max(m) FILTER (gone > 0), 0) / max(pm)")} AS ratio FROM o GROUP BY vec_id""",
    "crossfade_render": f"SELECT event_id AS pos, {r6('value * (1 - least(1.0, greatest(0.0, (event_id - 399) / 64::DOUBLE))) + -value * least(1.0, greatest(0.0, (event_id - 399) / 64::DOUBLE))')} AS y FROM events",
    "drift_windows": "SELECT p_partkey, greatest(4096, CASE WHEN p_size <> 25 THEN least(24000, floor(0.1::DOUBLE / (abs(p_size - 25)::DOUBLE * 1e-6))) ELSE 24000 END)::BIGINT AS frames FROM part",
}

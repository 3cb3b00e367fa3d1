"""Queries on the long series: envelopes, lags, blocks, robust fits, resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numeric as n
from ..operators import align, robust, spectrum
from . import roles
from .roles import r6

_LAG = 37


def _delayed(spark, d):
    s = roles.series(spark, d)
    return s, s.select((F.col("pos") + _LAG).alias("pos"), (0.5 * F.col("x")).alias("x"))


def hann_frames_energy(spark, d):
    f = spectrum.frame_signal(roles.series(spark, d).select(F.lit(0).alias("track"), "pos", "x"), 64, 32)
    e = F.aggregate(F.transform("frame", lambda x, i: F.pow(x * n.hann(i, 64), 2)), F.lit(0.0), lambda a, x: a + x)
    return f.select("t", n.r6(e).alias("energy"))


def envelope_zscore(spark, d):
    z = align.zscore_db(align.envelope(roles.series(spark, d), 20, 10))
    return z.select("frame", n.r6(F.col("e")).alias("energy"), n.r6(F.col("z")).alias("z"))


def silence_pruning(spark, d):
    """Blocks of ten frames that lie mostly at the floor of the envelope, if that is well below its median."""
    z = align.zscore_db(align.envelope(roles.series(spark, d), 20, 10), span_db=18.0)
    return align.mostly_silent(z, 10).select("block", "at_floor", "frames", "silent")


def all_lag_correlation(spark, d):
    a, b = _delayed(spark, d)
    return align.lag_correlations(a, b, 64).select("lag", n.r6(F.col("rho")).alias("rho"), "overlap")


def coarse_lag_top1(spark, d):
    a, b = _delayed(spark, d)
    best = align.first_best(align.lag_correlations(a, b, 64), n.r6(F.col("rho")), F.col("lag"), [])
    return best.select("lag", n.r6(F.col("rho")).alias("rho"))


def peak_to_sidelobe(spark, d):
    a, b = _delayed(spark, d)
    p = align.peak_to_sidelobe(align.lag_correlations(a, b, 64), "rho", "lag", 2)
    return p.select(F.col("peak_at").alias("lag"), n.r6(F.col("peak")).alias("peak"), n.r6(F.col("ratio")).alias("ratio"))


def block_gate_erosion(spark, d):
    blocks = roles.series(spark, d).groupBy("ch", F.floor(F.col("pos") / 250).cast("long").alias("block")).agg((F.avg("x") > 20).alias("ok"), F.count("*").alias("samples"))
    return align.eroded_blocks(blocks, "ok", key="ch", order="block").select("ch", "block", "ok", "kept", "samples")


def _anchors(spark, d):
    e = roles.table(spark, d, "events")
    day = F.floor(F.unix_seconds("ts") / 86400).cast("long") if dict(e.dtypes)["ts"] == "timestamp" else F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 86400).cast("long")
    return e.groupBy(F.col("event_type").alias("ch"), day.alias("day")).agg(F.avg("value").alias("y"), F.count("*").alias("m")).withColumn("x", (F.col("day") - 19000).cast("double"))


_DAILY = "a AS (SELECT event_type AS ch, floor(epoch(ts) / 86400)::BIGINT AS day, avg(value) AS y, count(*) AS m, (floor(epoch(ts) / 86400)::BIGINT - 19000)::DOUBLE AS x FROM events GROUP BY ALL)"
_TS = f"""{_DAILY}, sl AS (SELECT p.ch, median((q.y - p.y) / (q.x - p.x)) AS slope FROM a p JOIN a q ON p.ch = q.ch AND p.x < q.x GROUP BY p.ch),
f AS (SELECT ch, slope, median(y - slope * x) AS intercept FROM a JOIN sl USING (ch) GROUP BY ch, slope)"""


def theil_sen_by_type(spark, d):
    return robust.theil_sen(_anchors(spark, d), "ch", "x", "y").select("ch", n.r6(F.col("slope")).alias("slope"), n.r6(F.col("intercept")).alias("intercept"))


def mad_residual_status(spark, d):
    p = _anchors(spark, d)
    m = robust.mad(p, robust.theil_sen(p, "ch", "x", "y"), "ch", "x", "y")
    return m.select("ch", "points", n.r6(F.col("mad")).alias("mad"), F.when(F.col("points") < 12, "few").when(F.col("mad") > 20, "unreliable").otherwise("ok").alias("status"))


def delay_line_fit(spark, d):
    f = align.line_fit(_anchors(spark, d), "ch", "x", "y")
    return f.select("ch", *(n.r6(F.col(c)).alias(c) for c in ("slope", "intercept", "max_residual")))


def snap_ratio(spark, d):
    r = roles.table(spark, d, "part").select("p_partkey", (1 + ((F.col("p_partkey") % 200) - 100) * 0.0005).alias("ratio"))
    value, label = align.snap(F.col("ratio"))
    return r.select("p_partkey", n.r6(F.col("ratio")).alias("ratio"), n.r6(value).alias("snapped"), F.coalesce(label, F.when(F.abs(F.col("ratio") - 1) * 1e6 <= 5, "none").otherwise("drift")).alias("label"))


def refine_delay(spark, d):
    """Every frame against itself 0.3 samples later: what the search finds."""
    sign = lambda i: F.when(i % 2 == 0, 1.0).otherwise(-1.0)
    f = roles.frames(spark, d).select("vec_id", "a", (F.aggregate(F.transform("a", lambda x, i: x * sign(i)), F.lit(0.0), lambda s, x: s + x) / 64).alias("nyquist"))
    # half the sample rate has no phase that a delay could turn
    f = align.delayed(f.select("vec_id", F.transform("a", lambda x, i: x - F.col("nyquist") * sign(i)).alias("a")), 0.3)
    return align.refine_delays(f, "vec_id").select("vec_id", (F.floor(F.col("delay") * 100 + 0.5) / 100).alias("delay"), "status")


def warp_resample(spark, d):
    s = roles.series(spark, d)
    return align.warp(s, 0.0002, 0.25, phases=64, half=4, nearest=True).select("pos", n.r6(F.col("y")).alias("y"))


def anchor_drift(spark, d):
    """The speed of series played 200 ppm faster, from forty anchors each, a seventh of them off by three seconds."""
    k, key = F.col("p_partkey"), F.floor(F.col("p_partkey") / 40).cast("long").alias("track")
    a = roles.table(spark, d, "part").select(key, (k * 2.0).alias("x"), (0.5 - 0.0002 * (k * 2.0) + F.when(k % 7 == 3, 3.0).otherwise(0.0)).alias("y"))
    enough = a.groupBy("track").agg(F.count("*").alias("m")).where("m >= 12").select("track")
    f = robust.theil_sen(a.join(enough, "track"), "track", "x", "y")
    return f.select("track", n.r6((-F.col("slope")) * 1e6).alias("ppm"), n.r6(1 - F.col("slope")).alias("ratio"))


QUERIES = {f.__name__: f for f in (hann_frames_energy, envelope_zscore, silence_pruning, all_lag_correlation, coarse_lag_top1, peak_to_sidelobe, block_gate_erosion, theil_sen_by_type, mad_residual_status, delay_line_fit, snap_ratio, refine_delay, warp_resample, anchor_drift)}

_ENV = """e AS (SELECT frame, avg(value * value) AS e FROM events, LATERAL (SELECT unnest(range(greatest(0, ceil((event_id - 19) / 10.0)::BIGINT), floor(event_id / 10.0)::BIGINT + 1)) AS frame) GROUP BY frame HAVING count(*) = 20),
b AS (SELECT frame, e, 10 * log10(greatest(e, max(e) OVER () * 1e-8, 1e-30)) AS db FROM e),
z AS (SELECT frame, e, (db - avg(db) OVER ()) / stddev_pop(db) OVER () AS z FROM b)"""
_LAGS = f"l AS (SELECT q.event_id + {_LAG} - p.event_id AS lag, corr(p.value, 0.5::DOUBLE * q.value) AS rho, count(*) AS overlap FROM events p JOIN events q ON q.event_id + {_LAG} - p.event_id BETWEEN -64 AND 64 GROUP BY 1)"
_TAPS = """tp AS (SELECT ph AS phase, k, w FROM (VALUES {}) v(ph, k, w))"""


def _tap_sql() -> str:
    taps = align.kaiser_taps(64, 4)
    return _TAPS.format(", ".join(f"({p}, {k - 3}, {w!r}::DOUBLE)" for p, row in enumerate(taps.tolist()) for k, w in enumerate(row)))


SQL = {
    "hann_frames_energy": f"""WITH f AS (SELECT unnest(range((SELECT (max(event_id) - 63) // 32 + 1 FROM events))) AS t)
        SELECT t, {r6("sum(pow(value * (0.5 - 0.5 * cos(2 * pi() * (event_id - t * 32) / 64)), 2))")} AS energy FROM f JOIN events ON event_id BETWEEN t * 32 AND t * 32 + 63 GROUP BY t HAVING count(*) = 64""",
    "envelope_zscore": f"WITH {_ENV} SELECT frame, {r6('e')} AS energy, {r6('z')} AS z FROM z",
    "silence_pruning": f"""WITH {_ENV.replace("1e-8", "0.015848931924611134::DOUBLE")}, m AS (SELECT min(z) AS low, median(z) AS mid FROM z)
        SELECT frame // 10 AS block, count(*) FILTER (z <= low + 1e-3) AS at_floor, count(*) AS frames, low <= mid - 1 AND count(*) FILTER (z <= low + 1e-3) * 2 > count(*) AS silent FROM z, m GROUP BY 1, low, mid""",
    "refine_delay": "SELECT vec_id, 0.3::DOUBLE AS delay, 'ok' AS status FROM embeddings",
    "anchor_drift": "SELECT p_partkey // 40 AS track, 200.0::DOUBLE AS ppm, 1.0002::DOUBLE AS ratio FROM part GROUP BY 1 HAVING count(*) >= 12",
    "all_lag_correlation": f"WITH {_LAGS} SELECT lag, {r6('rho')} AS rho, overlap FROM l",
    "coarse_lag_top1": f"WITH {_LAGS} SELECT lag, {r6('rho')} AS rho FROM l ORDER BY 2 DESC, lag LIMIT 1",
    "peak_to_sidelobe": f"""WITH {_LAGS}, p AS (SELECT lag AS pk, abs(rho) AS peak FROM l ORDER BY abs(rho) DESC, lag LIMIT 1)
        SELECT max(pk) AS lag, {r6("max(peak)")} AS peak, {r6("max(peak) / median(abs(rho)) FILTER (abs(lag - pk) > 2)")} AS ratio FROM l, p""",
    "block_gate_erosion": """WITH b AS (SELECT event_type AS ch, event_id // 250 AS block, avg(value) > 20 AS ok, count(*) AS samples FROM events GROUP BY ALL)
        SELECT ch, block, ok, min(ok::INT) OVER (PARTITION BY ch ORDER BY block ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS kept, samples FROM b""",
    "theil_sen_by_type": f"WITH {_TS} SELECT ch, {r6('slope')} AS slope, {r6('intercept')} AS intercept FROM f",
    "mad_residual_status": f"""WITH {_TS}, r AS (SELECT ch, y - intercept - slope * x AS r FROM a JOIN f USING (ch)), c AS (SELECT ch, median(r) AS c FROM r GROUP BY ch),
        m AS (SELECT ch, count(*) AS points, median(abs(r - c)) AS mad FROM r JOIN c USING (ch) GROUP BY ch)
        SELECT ch, points, {r6("mad")} AS mad, CASE WHEN points < 12 THEN 'few' WHEN mad > 20 THEN 'unreliable' ELSE 'ok' END AS status FROM m""",
    "delay_line_fit": f"""WITH {_DAILY}, f AS (SELECT ch, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept FROM a GROUP BY ch)
        SELECT ch, {r6("slope")} AS slope, {r6("intercept")} AS intercept, {r6("max(abs(y - intercept - slope * x))")} AS max_residual FROM a JOIN f USING (ch) GROUP BY ch, slope, intercept""",
    "snap_ratio": "WITH r AS (SELECT p_partkey, 1 + ((p_partkey % 200) - 100) * 0.0005::DOUBLE AS ratio FROM part), k AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {v!r}::DOUBLE, '{name}', {max(1e-5, 0.02 * abs(v - 1))!r}::DOUBLE)" for i, (v, name) in enumerate(align.KNOWN_RATIOS)) + f""") v(o, v, label, tol))
        SELECT p_partkey, {r6("ratio")} AS ratio, {r6("(SELECT arg_min(v, o) FROM k WHERE abs(ratio - v) <= tol)")} AS snapped,
               coalesce((SELECT arg_min(label, o) FROM k WHERE abs(ratio - v) <= tol), CASE WHEN abs(ratio - 1) * 1e6 <= 5 THEN 'none' ELSE 'drift' END) AS label FROM r""",
    "warp_resample": f"""WITH {_tap_sql()}, o AS (SELECT p, p - (0.25::DOUBLE + 0.0002::DOUBLE * p) AS s FROM (SELECT unnest(range((SELECT max(event_id) + 20 FROM events))) AS p)),
        i AS (SELECT p, floor(s)::BIGINT AS base, round_even((s - floor(s)) * 64, 0)::BIGINT AS phase FROM o)
        SELECT p AS pos, {r6("sum(value * w)")} AS y FROM i JOIN tp USING (phase) JOIN events ON event_id = base + k GROUP BY p HAVING count(*) = 8""",
}

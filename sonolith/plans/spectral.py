"""Queries on frames: cross-spectra, bands, evidence and auditory measures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numeric as n
from ..operators import psycho, spectrum
from ..operators.evidence import knee, spectral_verdict
from . import roles
from .roles import CROSS_SQL, FRAMES_SQL, RANKED_SQL, r6

#: Sample rate that the frames of 64 samples are taken to have.
RATE = 32_000
#: Report bands in Hz; fixed values.
BANDS_HZ = [(0, 500), (500, 1000), (1000, 2000), (2000, 4000), (4000, 8000), (8000, 12000), (12000, 16000)]


def _bin(hz: float) -> int:
    return min(32, max(0, round(hz * 64 / RATE)))


def bands(spark) -> DataFrame:
    rows = [(k, _bin(lo), _bin(hi)) for k, (lo, hi) in enumerate(BANDS_HZ) if _bin(hi) > _bin(lo)]
    return spark.createDataFrame(rows, "band long, lo long, hi long")


_BANDS_SQL = "bands AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {_bin(lo)}, {_bin(hi)})" for k, (lo, hi) in enumerate(BANDS_HZ) if _bin(hi) > _bin(lo)) + ") v(band, lo, hi))"
_STATS_SQL = f"""{CROSS_SQL}, {_BANDS_SQL},
g AS (SELECT track, CASE WHEN sum(saa) > 0 THEN sum(sab_re) / sum(saa) ELSE 0 END AS g FROM x GROUP BY track),
p AS (SELECT track, band, max(frames) AS k, sum(greatest(sbb - CASE WHEN saa > 0 THEN (sab_re * sab_re + sab_im * sab_im) / saa ELSE 0 END, 0)) AS raw,
             sum(sbb) AS total, sum(saa) AS saa, sum(sab_re) AS sab_re, max(g) AS g
      FROM x JOIN bands ON bin >= lo AND bin < hi JOIN g USING (track) GROUP BY track, band),
q AS (SELECT *, raw * k / (k - 1) AS incoherent, greatest(0, total - 2 * g * sab_re + g * g * saa) AS residual FROM p)"""


def _frames(spark, d):
    return spectrum.spectra(roles.frames(spark, d).select("track", "t", "a", "b"))


def _ranked(spark, d):
    return spectrum.spectra(roles.ranked_frames(spark, d).select("track", "t", "a", "b"))


def _erb(spark):
    return psycho.band_table(psycho.erb_bands(spark, RATE, 64), 33)


def _stats(spark, d, layout=None):
    cross = spectrum.cross_spectrum(_frames(spark, d))
    return spectrum.band_stats(cross, layout if layout is not None else bands(spark), spectrum.gain(cross))


def band_stats(spark, d):
    s = _stats(spark, d)
    return s.select("track", "band", F.col("k").alias("frames"), n.r6(n.ratio_db(F.col("coherent"), F.col("incoherent"))).alias("snr_db"), n.r6(n.ratio_db(F.col("total"), F.col("residual"))).alias("scalar_snr_db"), n.r6(F.col("coherent") / F.col("total")).alias("coherence"), n.r6(F.col("g")).alias("gain"))


def cross_spectrum_bins(spark, d):
    c = spectrum.cross_spectrum(_frames(spark, d))
    return c.select("track", "bin", "frames", *(n.r6(F.col(k)).alias(k) for k in ("saa", "sbb", "sab_re", "sab_im")))


def broadband_vs_bands(spark, d):
    wide = spark.createDataFrame([(-1, 0, 33)], "band long, lo long, hi long").unionByName(bands(spark))
    s = _stats(spark, d, wide)
    return s.select("track", F.when(F.col("band") < 0, "broadband").otherwise(F.concat(F.lit("band "), F.col("band"))).alias("scope"), n.r6(F.col("total")).alias("power"), n.r6(n.ratio_db(F.col("coherent"), F.col("incoherent"))).alias("snr_db"))


def pair_gain_polarity(spark, d):
    rows = roles.frames(spark, d).select("track", F.explode(F.arrays_zip("a", "b")).alias("z")).select("track", "z.a", "z.b")
    s = rows.groupBy("track").agg(F.sum(F.col("a") * F.col("b")).alias("ab"), F.sum(F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("b") * F.col("b")).alias("bb"), F.count("*").alias("m"))
    return s.select("track", n.r6(F.col("ab") / F.col("aa")).alias("gain"), n.r6(F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("correlation"), F.when(F.col("ab") < 0, -1).otherwise(1).cast("long").alias("polarity"), n.r6(F.sqrt(F.col("bb") / F.col("m"))).alias("rms"))


def _tones(spark, d):
    """(o_orderkey, hz, bin): a frequency for each order, some above half the sample rate."""
    hz = roles.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * 50.5 % 20_000).alias("hz"))
    return hz.withColumn("bin", F.least(F.greatest(F.bround(F.col("hz") * 64 / RATE), F.lit(0.0)), F.lit(32.0)).cast("long"))


def hz_to_bin_dim(spark, d):
    """How many orders' frequencies fall on each bin, and the range that these have."""
    return _tones(spark, d).groupBy("bin").agg(F.count("*").alias("tones"), n.r6(F.min("hz")).alias("lowest_hz"), n.r6(F.max("hz")).alias("highest_hz"))


def measurable_bands(spark, d):
    s = _stats(spark, d).withColumn("snr", n.ratio_db(F.col("coherent"), F.col("incoherent")))
    return s.groupBy("track").agg(F.count_if(F.col("snr").isNotNull() & (F.col("snr") > 10)).alias("measurable"), F.count("*").alias("bands"), n.r6(F.min("snr")).alias("worst_db"))


def phase_shifted(spark, d):
    z = spectrum.bins(_ranked(spark, d), ["track", "t"])
    re, im = spectrum.phase_shift(F.col("are"), F.col("aim"), F.col("bin"), 1.25, 64)
    return z.select("track", "t", "bin", n.r6(re).alias("re"), n.r6(im).alias("im"))


def ltas_knee(spark, d):
    k = knee(spectrum.bins(_frames(spark, d), ["track", "t"]).groupBy("track", "bin").agg(F.avg(F.col("are") ** 2 + F.col("aim") ** 2).alias("p")), shift=2)
    return k.select("track", "knee_bin", n.r6(F.col("drop_db")).alias("drop_db"))


def frame_cutoff_quartiles(spark, d):
    c = psycho.frame_cutoffs(_frames(spark, d), below_db=15.0)
    q = c.groupBy("track").agg(F.percentile("cutoff", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("frames"))
    return q.select("track", "frames", *(n.r6(F.col("q")[k]).alias(f"q{25 * (k + 1)}") for k in range(3)))


def verdicts(spark, d):
    z = spectrum.bins(_frames(spark, d), ["track", "t"])
    k = knee(z.groupBy("track", "bin").agg(F.avg(F.col("are") ** 2 + F.col("aim") ** 2).alias("p")), shift=2)
    q = psycho.frame_cutoffs(_frames(spark, d), below_db=15.0).groupBy("track").agg(F.percentile("cutoff", 0.5).alias("q50"), F.count("*").alias("frames"))
    rows = k.join(q, "track").select("track", "frames", (F.col("q50") * RATE / 64).alias("cutoff_hz"), (F.col("knee_bin") * RATE / 64.0).alias("knee_hz"), (-F.col("drop_db")).alias("drop_db"))
    v = spectral_verdict(rows, nyquist_hz=RATE / 2)
    return v.select("track", "bucket", F.array_join("reasons", ",").alias("reasons"), F.array_join("counter", ",").alias("counter"))


def erb_layout(spark, d):
    """The auditory bands, and how many orders' frequencies lie in each."""
    b = psycho.erb_bands(spark, RATE, 64)
    counts = _tones(spark, d).groupBy("bin").agg(F.count("*").alias("tones"))
    held = b.join(F.broadcast(counts), (F.col("bin") >= F.col("lo")) & (F.col("bin") < F.col("hi")), "left").groupBy("band", "lo", "hi", "centre_hz").agg(F.coalesce(F.sum("tones"), F.lit(0)).alias("tones"))
    return held.select("band", "lo", "hi", "tones", n.r6(F.col("centre_hz")).alias("centre_hz"), n.r6(n.bark(F.col("centre_hz"))).alias("centre_bark"))


def erb_band_energy(spark, d):
    e = psycho.band_energies(_frames(spark, d), _erb(spark))
    return e.groupBy("track", "band").agg(n.r6(F.avg("e")).alias("energy"))


def masking_threshold(spark, d):
    thr = psycho.thresholds(_frames(spark, d), _erb(spark))
    return thr.groupBy("track", "band").agg(n.r6(F.avg(n.db10(F.col("thr")))).alias("threshold_db"))


def sfm_tonality(spark, d):
    f = psycho.flatness(_ranked(spark, d))
    return f.select("track", "t", n.r6(F.col("sfm")).alias("sfm_db"), n.r6(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("sfm") / -60))).alias("tonality"))


def tonal_peaks(spark, d):
    return psycho.tonal_peaks(_ranked(spark, d)).select("track", "t", "peaks", n.r6(F.col("share")).alias("tonal_share"))


def _nmr(spark, d, frames=_frames):
    return psycho.noise_to_mask(frames(spark, d), _erb(spark), 0.8)


def nmr_per_frame(spark, d):
    f = psycho.nmr_frames(_nmr(spark, d, _ranked))
    return f.select("track", "t", n.r6(F.col("total_db")).alias("total_db"), n.r6(F.col("peak_db")).alias("peak_db"))


def nmr_histogram_quantile(spark, d):
    q = psycho.histogram_quantiles(psycho.nmr_frames(_nmr(spark, d)), "total_db", ["track"], [0.5, 0.95])
    return q.select("track", "frames", "q50", "q95", n.r6(F.col("largest")).alias("largest"), n.r6(F.col("above_zero")).alias("above_zero"))


def nmr_time_grid(spark, d):
    g = psycho.time_grid(_nmr(spark, d, _ranked), _erb(spark), 4)
    return g.select("track", "band", "col", n.r6(F.col("worst_db")).alias("worst_db"))


def critical_window(spark, d):
    g = psycho.time_grid(_nmr(spark, d, _ranked), _erb(spark), 4).groupBy("track", "col").agg(F.max("worst_db").alias("w"))
    w = Window.partitionBy("track").orderBy("col").rowsBetween(0, 2)
    m = g.select("track", "col", n.r6(F.when(F.count("w").over(w) == 3, F.avg("w").over(w))).alias("mean")).where("mean is not null")
    first = Window.partitionBy("track").orderBy(F.desc("mean"), "col")
    return m.withColumn("k", F.row_number().over(first)).where("k = 1").select("track", F.col("col").alias("start_col"), F.col("mean").alias("mean_db"))


def gcc_phat_lag(spark, d):
    """Each frame against itself delayed by 5 samples, circularly: whitened correlation by DFT."""
    f = roles.ranked_frames(spark, d).select("track", "t", "a", F.transform("a", lambda _, i: F.element_at("a", ((i + 64 - 5) % 64 + 1).cast("int"))).alias("b"))
    lags = psycho.phat_peaks(spectrum.spectra(f), 64)
    return lags.select("track", "t", "lag", n.r6(F.col("value")).alias("value"))


QUERIES = {f.__name__: f for f in (band_stats, cross_spectrum_bins, broadband_vs_bands, pair_gain_polarity, hz_to_bin_dim, measurable_bands, ltas_knee, frame_cutoff_quartiles, erb_layout, erb_band_energy, masking_threshold, sfm_tonality, tonal_peaks, nmr_per_frame, nmr_histogram_quantile, nmr_time_grid, critical_window, gcc_phat_lag)} | {"phase_shift": phase_shifted, "spectral_verdict": verdicts}

_RATIO = lambda a, b: f"CASE WHEN {a} > 0 AND {b} > 0 THEN 10 * log10({a} / {b}) END"
_FIRST, _LAST = (21.4 * math.log10(4.37 * hz / 1000 + 1) for hz in (20.0, RATE / 2))
_QUIET = "3.64 * pow(greatest({0}, 20.0) / 1000, -0.8) - 6.5 * exp(-0.6 * pow(greatest({0}, 20.0) / 1000 - 3.3, 2)) + 0.001 * pow(greatest({0}, 20.0) / 1000, 4)"
_ERB_SQL = f"""
ed AS (SELECT k AS band, (pow(10.0, (k + {_FIRST!r}::DOUBLE) / 21.4) - 1) / 4.37 * 1000 AS hz FROM (SELECT unnest(range({int(_LAST - _FIRST + 1e-9) + 1})) AS k)),
ei AS (SELECT band, least(round_even(hz / {RATE / 64}, 0), 33)::BIGINT AS lo, least(round_even(coalesce(lead(hz) OVER (ORDER BY band), {RATE / 2}) / {RATE / 64}, 0), 33)::BIGINT AS hi FROM ed),
el AS (SELECT band, lo, hi, (lo + hi - 1) / 2.0::DOUBLE * {RATE / 64}::DOUBLE AS centre_hz FROM ei WHERE hi > lo)"""
_TONES = f"tn AS (SELECT o_orderkey, hz, least(greatest(round_even(hz * 64 / {RATE}, 0), 0), 32)::BIGINT AS bin FROM (SELECT o_orderkey, (o_orderkey * 50.5::DOUBLE) % 20000 AS hz FROM orders))"
_BARK = "(13.0 * atan(0.00076 * {0}) + 3.5 * atan(pow({0} / 7500.0, 2)))"
_PEAK_SQL = """
pp AS (SELECT track, t, bin, greatest(are * are + aim * aim, 1e-30) AS p FROM sp),
pc AS (SELECT *, coalesce(lag(p, 4) OVER w IS NOT NULL AND lead(p, 4) OVER w IS NOT NULL AND p > lag(p, 1) OVER w AND p >= lead(p, 1) OVER w
        AND p > 5.011872336272722 * greatest(lag(p, 3) OVER w, lead(p, 3) OVER w, lag(p, 4) OVER w, lead(p, 4) OVER w), false) AS peak FROM pp WINDOW w AS (PARTITION BY track, t ORDER BY bin)),
pk AS (SELECT *, max(peak::INT) OVER (PARTITION BY track, t ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 1 AS near FROM pc)"""
_THR_SQL = f"""{_PEAK_SQL},
be AS (SELECT track, t, band, sum(p) AS e, sum(CASE WHEN near THEN p ELSE 0 END) / sum(p) AS alpha FROM pk JOIN el ON bin >= lo AND bin < hi GROUP BY track, t, band),
qu AS (SELECT band, pow(10.0, (min({_QUIET.format(f"(k * {RATE / 64}::DOUBLE)")}) - 96) / 10) AS ath FROM el, (SELECT unnest(range(33)) AS k) WHERE k >= lo AND k < hi GROUP BY band),
sw AS (SELECT i.band AS bi, j.band AS bj, {_BARK.format("i.centre_hz")} AS zi, pow(10, (15.81 + 7.5 * ({_BARK.format("i.centre_hz")} - {_BARK.format("j.centre_hz")} + 0.474)
        - 17.5 * sqrt(1 + pow({_BARK.format("i.centre_hz")} - {_BARK.format("j.centre_hz")} + 0.474, 2))) / 10) AS w FROM el i, el j),
sn AS (SELECT bi, bj, zi, w / sum(w) OVER (PARTITION BY bi) AS w FROM sw),
ss AS (SELECT track, t, bi AS band, sum(w * e) AS spread, max(zi) AS zi, sum(CASE WHEN bi = bj THEN alpha ELSE 0 END) AS alpha FROM be JOIN sn ON band = bj GROUP BY track, t, bi),
th AS (SELECT track, t, band, greatest(spread * pow(10.0, -(alpha * (14.5 + zi) + (1 - alpha) * 5.5) / 10), ath) AS thr FROM ss JOIN qu USING (band))"""
_NMR_SQL = f"""{FRAMES_SQL}, {_ERB_SQL}, {_THR_SQL},
nb AS (SELECT track, t, band, sum(pow(bre - 0.8::DOUBLE * are, 2) + pow(bim - 0.8::DOUBLE * aim, 2)) AS en FROM sp JOIN el ON bin >= lo AND bin < hi GROUP BY track, t, band),
nm AS (SELECT track, t, band, greatest(en, 1e-30) / thr AS ratio FROM nb JOIN th USING (track, t, band)),
nf AS (SELECT track, t, 10 * log10(avg(ratio)) AS total_db, 10 * log10(max(ratio)) AS peak_db FROM nm GROUP BY track, t)"""
_RANKED_NMR_SQL = _NMR_SQL.replace(FRAMES_SQL, RANKED_SQL)
_LTAS_SQL = f"""{FRAMES_SQL},
l AS (SELECT track, bin, 10 * log10(greatest(avg(are * are + aim * aim), 1e-30)) AS v FROM sp GROUP BY track, bin),
sm AS (SELECT track, bin, CASE WHEN count(*) OVER w = 5 THEN avg(v) OVER w END AS v FROM l WINDOW w AS (PARTITION BY track ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
dr AS (SELECT track, bin, floor((lead(v, 2) OVER (PARTITION BY track ORDER BY bin) - v) * 1e9 + 0.5) / 1e9 AS d FROM sm),
kn AS (SELECT track, bin + 1 AS knee_bin, d AS drop_db FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY d, bin) AS k FROM dr WHERE d IS NOT NULL) WHERE k = 1)"""
_CUT_SQL = """
fp AS (SELECT track, t, bin, 10 * log10(greatest(are * are + aim * aim, 1e-30)) AS v FROM sp),
fs AS (SELECT track, t, bin, CASE WHEN count(*) OVER w = 5 THEN avg(v) OVER w END AS v FROM fp WINDOW w AS (PARTITION BY track, t ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
fm AS (SELECT track, t, max(v) AS top FROM fs GROUP BY track, t),
fc AS (SELECT track, t, coalesce(max(CASE WHEN v > top - 15 THEN bin END), 0)::DOUBLE AS cutoff FROM fs JOIN fm USING (track, t) GROUP BY track, t)"""

SQL = {
    "band_stats": f"""WITH {_STATS_SQL} SELECT track, band, k AS frames, {r6(_RATIO("greatest(0, total - incoherent)", "incoherent"))} AS snr_db, {r6(_RATIO("total", "residual"))} AS scalar_snr_db,
        {r6("greatest(0, total - incoherent) / total")} AS coherence, {r6("g")} AS gain FROM q""",
    "cross_spectrum_bins": f"WITH {CROSS_SQL} SELECT track, bin, frames, {', '.join(f'{r6(c)} AS {c}' for c in ('saa', 'sbb', 'sab_re', 'sab_im'))} FROM x",
    "broadband_vs_bands": f"""WITH {_STATS_SQL.replace("bands AS (SELECT * FROM (VALUES", "bands AS (SELECT * FROM (VALUES (-1, 0, 33),")}
        SELECT track, CASE WHEN band < 0 THEN 'broadband' ELSE 'band ' || band END AS scope, {r6("total")} AS power, {r6(_RATIO("greatest(0, total - incoherent)", "incoherent"))} AS snr_db FROM q""",
    "pair_gain_polarity": f"""WITH {FRAMES_SQL}, k AS (SELECT track, sum(a * b) AS ab, sum(a * a) AS aa, sum(b * b) AS bb, count(*) AS m FROM s GROUP BY track)
        SELECT track, {r6("ab / aa")} AS gain, {r6("ab / sqrt(aa * bb)")} AS correlation, (CASE WHEN ab < 0 THEN -1 ELSE 1 END)::BIGINT AS polarity, {r6("sqrt(bb / m)")} AS rms FROM k""",
    "hz_to_bin_dim": f"WITH {_TONES} SELECT bin, count(*) AS tones, {r6('min(hz)')} AS lowest_hz, {r6('max(hz)')} AS highest_hz FROM tn GROUP BY bin",
    "measurable_bands": f"""WITH {_STATS_SQL}, z AS (SELECT track, {_RATIO("greatest(0, total - incoherent)", "incoherent")} AS snr FROM q)
        SELECT track, count(*) FILTER (snr IS NOT NULL AND snr > 10) AS measurable, count(*) AS bands, {r6("min(snr)")} AS worst_db FROM z GROUP BY track""",
    "phase_shift": f"""WITH {RANKED_SQL} SELECT track, t, bin, {r6("are * cos(2 * pi() * bin / 64 * 1.25) + aim * sin(2 * pi() * bin / 64 * 1.25)")} AS re,
        {r6("aim * cos(2 * pi() * bin / 64 * 1.25) - are * sin(2 * pi() * bin / 64 * 1.25)")} AS im FROM sp""",
    "ltas_knee": f"WITH {_LTAS_SQL} SELECT track, knee_bin, {r6('drop_db')} AS drop_db FROM kn",
    "frame_cutoff_quartiles": f"WITH {FRAMES_SQL}, {_CUT_SQL} SELECT track, count(*) AS frames, {', '.join(f'{r6(f'quantile_cont(cutoff, 0.{q})')} AS q{q}' for q in (25, 50, 75))} FROM fc GROUP BY track".replace("0.50)", "0.5)"),
    "spectral_verdict": f"""WITH {_LTAS_SQL}, {_CUT_SQL},
        ev AS (SELECT track, frames, q50 * {RATE} / 64 AS cutoff, knee_bin * {RATE} / 64.0 AS knee, -drop_db AS dd FROM kn JOIN (SELECT track, quantile_cont(cutoff, 0.5) AS q50, count(*) AS frames FROM fc GROUP BY track) USING (track)),
        fl AS (SELECT *, cutoff < 20750 AND cutoff < {0.95 * RATE / 2} AS low, dd > 18 AS wall, knee >= {0.95 * RATE / 2} AS near FROM ev),
        ru AS (SELECT track, list_filter([CASE WHEN frames >= 40 AND low THEN 'cutoff' END, CASE WHEN frames >= 40 AND wall AND NOT near AND (low OR knee < 20750) THEN 'brickwall' END], lambda x: x IS NOT NULL) AS reasons,
               list_filter([CASE WHEN frames >= 40 AND NOT low THEN 'full band' END, CASE WHEN frames >= 40 AND low AND NOT wall AND dd < 14 THEN 'gentle' END], lambda x: x IS NOT NULL) AS counter FROM fl)
        SELECT track, CASE WHEN len(reasons) > 0 AND len(counter) = 0 THEN 'lossy' WHEN len(reasons) = 0 AND len(counter) > 0 THEN 'lossless' ELSE 'undetermined' END AS bucket,
               array_to_string(reasons, ',') AS reasons, array_to_string(counter, ',') AS counter FROM ru""",
    "erb_layout": f"WITH {_ERB_SQL}, {_TONES} SELECT band, lo, hi, count(bin) AS tones, {r6('centre_hz')} AS centre_hz, {r6(_BARK.format('centre_hz'))} AS centre_bark FROM el LEFT JOIN tn ON bin >= lo AND bin < hi GROUP BY band, lo, hi, centre_hz",
    "erb_band_energy": f"WITH {FRAMES_SQL}, {_ERB_SQL}, {_THR_SQL} SELECT track, band, {r6('avg(e)')} AS energy FROM be GROUP BY track, band",
    "masking_threshold": f"WITH {FRAMES_SQL}, {_ERB_SQL}, {_THR_SQL} SELECT track, band, {r6('avg(10 * log10(greatest(thr, 1e-30)))')} AS threshold_db FROM th GROUP BY track, band",
    "sfm_tonality": f"""WITH {RANKED_SQL}, p AS (SELECT track, t, 10 * log10(exp(avg(ln(greatest(are * are + aim * aim, 1e-30)))) / avg(greatest(are * are + aim * aim, 1e-30))) AS sfm FROM sp GROUP BY track, t)
        SELECT track, t, {r6("sfm")} AS sfm_db, {r6("least(1.0, greatest(0.0, sfm / -60))")} AS tonality FROM p""",
    "tonal_peaks": f"""WITH {RANKED_SQL}, {_PEAK_SQL} SELECT track, t, count(*) FILTER (peak) AS peaks, {r6("sum(CASE WHEN near THEN p ELSE 0 END) / sum(p)")} AS tonal_share FROM pk GROUP BY track, t""",
    "nmr_per_frame": f"WITH {_RANKED_NMR_SQL} SELECT track, t, {r6('total_db')} AS total_db, {r6('peak_db')} AS peak_db FROM nf",
    "nmr_histogram_quantile": f"""WITH {_NMR_SQL},
        h AS (SELECT track, least(319, greatest(0, floor((total_db + 100) / 0.5)))::BIGINT AS b, count(*) AS c FROM nf GROUP BY 1, 2),
        cu AS (SELECT *, sum(c) OVER (PARTITION BY track ORDER BY b) AS upto, sum(c) OVER (PARTITION BY track) AS total FROM h),
        e AS (SELECT track, max(total_db) AS largest, avg((total_db > 0)::INT::DOUBLE) AS above FROM nf GROUP BY track)
        SELECT track, max(total)::BIGINT AS frames, min(CASE WHEN upto >= 0.5 * total THEN b END) * 0.5 - 99.75 AS q50, min(CASE WHEN upto >= 0.95 * total THEN b END) * 0.5 - 99.75 AS q95,
               {r6("max(largest)")} AS largest, {r6("max(above)")} AS above_zero FROM cu JOIN e USING (track) GROUP BY track""",
    "nmr_time_grid": f"WITH {_RANKED_NMR_SQL} SELECT track, band, t // 4 AS col, {r6('max(10 * log10(ratio))')} AS worst_db FROM nm GROUP BY ALL",
    "critical_window": f"""WITH {_RANKED_NMR_SQL}, g AS (SELECT track, t // 4 AS col, max(10 * log10(ratio)) AS w FROM nm GROUP BY ALL),
        m AS (SELECT track, col, CASE WHEN count(*) OVER o = 3 THEN {r6("avg(w) OVER o")} END AS mean FROM g WINDOW o AS (PARTITION BY track ORDER BY col ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
        SELECT track, col AS start_col, mean AS mean_db FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY mean DESC, col) AS k FROM m WHERE mean IS NOT NULL) WHERE k = 1""",
    "gcc_phat_lag": f"""WITH {RANKED_SQL.replace("0.8::DOUBLE * embedding[i + 1]::DOUBLE + 0.01::DOUBLE * (((vec_id * 31 + i * 17) % 23) - 11)", "embedding[(i + 59) % 64 + 1]::DOUBLE")},
        c AS (SELECT track, t, bin, (are * bre + aim * bim) AS re, (are * bim - aim * bre) AS im FROM sp),
        u AS (SELECT track, t, bin, CASE WHEN re * re + im * im > 1e-24 THEN re / sqrt(re * re + im * im) ELSE 0 END AS re, CASE WHEN re * re + im * im > 1e-24 THEN im / sqrt(re * re + im * im) ELSE 0 END AS im FROM c),
        v AS (SELECT track, t, lag, floor(sum((CASE WHEN bin IN (0, 32) THEN 1 ELSE 2 END) * (re * cos(2 * pi() * bin * lag / 64) - im * sin(2 * pi() * bin * lag / 64))) / 64 * 1e9 + 0.5) / 1e9 AS value FROM u, (SELECT unnest(range(-32, 32)) AS lag) GROUP BY ALL)
        SELECT track, t, lag, {r6("value")} AS value FROM (SELECT *, row_number() OVER (PARTITION BY track, t ORDER BY abs(value) DESC, lag) AS k FROM v) WHERE k = 1""",
}

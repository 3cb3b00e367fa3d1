"""Comparison chain on signals whose delay, drift, gain and noise are known."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sonolith.operators import align, chunks, compare, spectrum

RATE, SIZE, FFT, HOP = 8000, 16_384, 512, 256


def music(n, seed):
    """Band-limited noise under a slow, irregular envelope."""
    r = np.random.default_rng(seed)
    z = np.fft.rfft(r.normal(size=n))
    z[int(0.7 * len(z)) :] = 0
    t = np.arange(n) / RATE
    return np.fft.irfft(z, n) * (1 + 0.5 * sum(np.sin(2 * np.pi * f * t + p) for f, p in zip(r.uniform(0.2, 2, 3), r.uniform(0, 6, 3), strict=True)) / 3)


def resampled(x, at):
    """x at fractional positions by a long windowed sinc of its own."""
    k = np.arange(-63, 65)
    whole = np.floor(at).astype(int)
    taps = np.sinc(k - (at - whole)[:, None]) * np.kaiser(130, 12)[1:-1]
    index = whole[:, None] + k
    return np.where((index >= 0) & (index < len(x)), x[np.clip(index, 0, len(x) - 1)], 0).__mul__(taps).sum(1)


def table(spark, tracks):
    return spark.createDataFrame(pd.DataFrame([{"track": k, "block": i, "start": i * SIZE, "x": x[i * SIZE : (i + 1) * SIZE].tolist()} for k, x in tracks.items() for i in range(-(-len(x) // SIZE))]), "track string, block long, start long, x array<double>").cache()


@pytest.fixture(scope="module")
def pairs(spark):
    n = 20 * RATE
    a, b, c, d = (music(n, k) for k in range(4))
    noise = np.random.default_rng(9).normal(size=n)
    later = np.concatenate([np.zeros(2960), 0.5 * a])[:n]
    slow = resampled(b, np.arange(n - 2000) * (1 - 204.08e-6) - 12.25)  # test time is longer by 204 ppm, 12.25 samples late
    pal = resampled(c, np.arange(int(n / 25 * 24) - 400) * 25 / 24)
    ref = table(spark, {"later": a, "slow": b, "pal": c, "other": d, "noisy": d})
    test = table(spark, {"later": later, "slow": slow, "pal": pal, "other": music(n, 77), "noisy": -2 * (d + 0.1 * d.std() * noise)})
    return ref, test


@pytest.fixture(scope="module")
def estimates(spark, pairs):
    found = compare.anchors(*pairs, [1.0, 24 / 25, 25 / 24, 1.001, 1 / 1.001], size=SIZE, rate=RATE, coarse=spark.createDataFrame([("later", 0.37)], "track string, lag_s double"))
    return compare.drift(found).cache()


def test_drift(estimates):
    got = {r.track: r for r in estimates.collect()}
    assert got["later"].status == "none" and got["later"].offset_s == pytest.approx(0.37, abs=1e-4)
    assert got["slow"].status == "drift" and (got["slow"].speed - 1) * 1e6 == pytest.approx(204.1, abs=25)
    assert got["pal"].label in ("pal_up", "pal_down") and got["pal"].status == "drift"
    assert "other" not in got or got["other"].status == "unreliable"


def snr(cross):
    bands = cross.sparkSession.createDataFrame([(0, 4, 160)], "band long, lo long, hi long")
    s = spectrum.band_stats(cross, bands, spectrum.gain(cross, lo=4, hi=160))
    return {r.track: (r.g, 10 * np.log10(max(r.coherent, 1e-30) / max(r.incoherent, 1e-30))) for r in s.collect()}


def test_aligned_spectra(spark, pairs, estimates):
    ref, test = pairs
    model = compare.model_of(estimates, RATE).cache()
    better = compare.tracked(ref, test, model, size=SIZE, rate=RATE).cache()
    rounds = {r.track: r.rounds for r in better.collect()}
    again = {r.track: r for r in compare.tracked(ref, test, better, size=SIZE, rate=RATE).collect()}
    assert set(rounds) == set(again) and all(1 <= n <= 5 for n in rounds.values())
    # a model that is settled is left after the round that shows it
    assert all(again[r.track].rounds == 1 and abs(again[r.track].intercept - r.intercept) < 1e-4 for r in better.collect() if r.rounds < 5)
    slope, intercept = better.where("track = 'slow'").select("slope", "intercept").first()
    assert slope * 1e6 == pytest.approx(204.08, abs=0.3) and intercept == pytest.approx(12.25, abs=0.05)
    assert better.where("track = 'later'").first().intercept == pytest.approx(2960, abs=0.01)
    got = snr(compare.cross_spectrum(ref, test, better.where("track in ('later', 'slow', 'noisy')"), size=SIZE, fft=FFT, hop=HOP))
    untracked = spark.createDataFrame([("slow", 0.0, 12.0)], "track string, slope double, intercept double")
    raw = snr(compare.cross_spectrum(ref, test, untracked, size=SIZE, fft=FFT, hop=HOP))
    assert got["later"][0] == pytest.approx(0.5, abs=1e-3) and got["later"][1] > 60
    assert got["slow"][1] > 50 > 10 > raw["slow"][1]
    assert got["noisy"][0] == pytest.approx(-2, abs=0.01) and got["noisy"][1] == pytest.approx(20 - 10 * np.log10(0.7), abs=0.3)
    floor = snr(compare.measurement_floor(ref.where("track = 'slow'"), better.where("track = 'slow'"), size=SIZE, fft=FFT, hop=HOP))
    assert floor["slow"][1] > got["slow"][1] - 3


def test_block_size_does_not_matter(spark, pairs):
    """Blocks, halos and frames that cross them add up to one pass over the whole."""
    ref, test = (t.where("track = 'noisy'") for t in pairs)
    model = spark.createDataFrame([("noisy", 1e-4, 3.5)], "track string, slope double, intercept double")
    series = [t.select("track", F.posexplode("x").alias("k", "x"), "block").select("track", (F.col("block") * SIZE + F.col("k")).alias("pos"), "x").cache() for t in (ref, test)]
    sums = []
    for size in (4096, 32_768):
        cross = compare.cross_spectrum(*(compare.blocks(s, size) for s in series), model, size=size, fft=FFT, hop=HOP)
        sums.append(cross.orderBy("bin").toPandas())
    assert (sums[0].frames == sums[1].frames).all() and np.allclose(sums[0][["saa", "sbb", "sab_re", "sab_im"]], sums[1][["saa", "sbb", "sab_re", "sab_im"]])


def test_refined_delays():
    r = np.random.default_rng(3)
    x = np.fft.irfft(np.where(np.arange(257) < 200, np.fft.rfft(r.normal(size=(40, 512)), axis=1), 0), 512, axis=1)
    want = r.uniform(-0.9, 0.9, 40)
    y = np.stack([align.fractional_shift(a, d) for a, d in zip(x, want, strict=True)])
    delay, corr, sharp = align.refined(x, -0.3 * y)
    assert np.abs(delay - want).max() < 1e-3 and corr.max() < -0.999 and sharp.min() > 10
    assert np.isnan(align.refined(np.zeros((1, 64)), np.ones((1, 64)))[0][0])


def test_lags_of_several_tracks(spark):
    """All lags of two tracks in small blocks equal numpy's correlation over the overlap."""
    r = np.random.default_rng(2)
    x = {k: 5 + r.normal(size=700) for k in "ab"}
    y = {"a": np.roll(x["a"], 9)[9:] * -2, "b": r.normal(size=650)}
    rows = lambda s: spark.createDataFrame([(k, i, float(v)) for k, z in s.items() for i, v in enumerate(z)], "k string, pos long, x double")
    got = align.lag_correlations(rows(x), rows(y), 20, key="k", size=128).collect()
    assert len(got) == 82
    for g in got:
        a, b = x[g.k], y[g.k]
        t = np.arange(max(0, g.lag), min(len(b), len(a) + g.lag))
        assert g.overlap == len(t) and g.rho == pytest.approx(np.corrcoef(a[t - g.lag], b[t])[0, 1], abs=1e-9)


def test_warp_in_blocks(spark):
    x = music(4000, 5)
    s = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate(x)], "k string, pos long, x double")
    a, b = (align.warp(s, 3e-4, -7.25, key="k", size=size).orderBy("pos").toPandas() for size in (512, 1 << 16))
    assert (a.pos == b.pos).all() and np.allclose(a.y, b.y)
    at = a.pos.to_numpy() - (-7.25 + 3e-4 * a.pos.to_numpy())
    assert np.sqrt(np.mean((a.y - resampled(x, at))[100:-100] ** 2)) < 1e-3 * x.std()


def test_phase_slopes():
    r = np.random.default_rng(3)
    x = np.fft.irfft(np.where(np.arange(257) < 210, np.fft.rfft(r.normal(size=(20, 512)), axis=1), 0), 512, axis=1)
    want = r.uniform(-0.8, 0.8, 20)
    assert np.abs(align.phase_slopes(x, np.stack([align.fractional_shift(a, d) for a, d in zip(x, want, strict=True)])) - want).max() < 1e-6


def test_excerpt_pairs(spark, pairs):
    ref, test = pairs
    model = spark.createDataFrame([("later", 0.0, 2960.0, 0.5), ("noisy", 0.0, 0.0, -2.0), ("slow", 204.08e-6, 12.25, 1.0)], "track string, slope double, intercept double, gain double")
    starts = spark.createDataFrame([("later", 30_000), ("noisy", 40_000), ("slow", 16_000), ("later", 10)], "track string, start long")
    got = {(r.track, r.start): (np.array(r.a), np.array(r.b)) for r in compare.excerpt_pairs(ref, test, model, starts, size=SIZE, length=4000).collect()}
    assert set(got) == {("later", 30_000), ("noisy", 40_000), ("slow", 16_000)}
    for (track, _), (a, b) in got.items():
        assert max(np.abs(a).max(), np.abs(b).max()) <= 0.98 + 1e-9
        assert np.std(a - b) < (0.15 if track == "noisy" else 0.01) * np.std(a)


def test_a_gap_in_a_block_is_an_error(spark):
    rows = spark.range(100).where("id <> 37").selectExpr("'a' track", "id pos", "1.0 x")
    assert chunks.blocks(rows.where("pos > 37"), 16).count() == 5
    with pytest.raises(Exception, match="samples are missing"):
        chunks.blocks(rows, 16).collect()

"""Sample rates: against direct sums, in the pass and stop band, over any blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.operators import chunks, rates


def direct(x, up, down, taps):
    half, out = len(taps) // 2, np.zeros(-(-len(x) * up // down))
    for n in range(len(out)):
        for k, v in enumerate(x):
            m = n * down - k * up
            if abs(m) <= half:
                out[n] += taps[m + half] * v
    return out


def parts(spark, x, size, track="a"):
    return chunks.blocks(spark.createDataFrame([(track, k, float(v)) for k, v in enumerate(x)], "track string, pos long, x double"), size)


def whole(blocks):
    return np.concatenate([r.x for r in blocks.orderBy("block").collect()])


@pytest.mark.parametrize(("up", "down", "n", "size"), [(1, 6, 300, 40), (2, 3, 101, 33), (3, 2, 77, 50), (1, 1, 20, 7), (80, 441, 500, 16), (2, 12, 300, 1000)])
def test_equals_direct_sums(spark, up, down, n, size):
    x = np.random.default_rng(n).normal(size=n)
    got = rates.resampled(parts(spark, x, size), up, down, size, size + 3, slope=0.3)
    g = np.gcd(up, down)
    want = direct(x, up // g, down // g, rates.low_pass(up // g, down // g, 0.3))
    assert np.allclose(whole(got), want, atol=1e-11)
    assert [(r.block, r.start) for r in got.orderBy("block").collect()] == [(k, k * (size + 3)) for k in range(-(-len(want) // (size + 3)))]


@pytest.mark.parametrize(("up", "down"), [(1, 6), (80, 441), (160, 147)])
def test_pass_and_stop_band(up, down):
    """Under -100 dB from the lower Nyquist rate on, flat to 98 % of it."""
    taps = rates.low_pass(up, down)
    h = 20 * np.log10(np.maximum(np.abs(np.fft.rfft(taps / up, 1 << 22)), 1e-12))
    edge = len(h) / max(up, down)
    assert h[int(edge) + 1 :].max() < -100 and np.abs(h[: int(0.98 * edge)]).max() < 0.001


def test_a_tone_and_its_alias(spark):
    t = np.arange(48_000)
    x = np.sin(2 * np.pi * 1000 * t / 48_000) + np.sin(2 * np.pi * 5000 * t / 48_000)
    y = whole(rates.resampled(parts(spark, x, 8192), 1, 6, 8192, 2048))[1000:7000]
    want = np.sin(2 * np.pi * 1000 * np.arange(1000, 7000) / 8000)
    assert len(y) == 6000 and np.abs(y - want).max() < 1e-5


@pytest.mark.parametrize("size", [5, 16, 1000])
def test_envelope_of_blocks(spark, size):
    x = np.random.default_rng(1).normal(size=203)
    got = {r.frame: r.e for r in rates.envelope(parts(spark, x, size), 40, 16).collect()}
    assert got == {k: pytest.approx(float((x[k * 16 : k * 16 + 40] ** 2).mean())) for k in range((203 - 40) // 16 + 1)}
    assert rates.envelope(parts(spark, x[:39], size), 40, 16).count() == 0


def test_tracks_apart_and_wrong_rates(spark):
    both = parts(spark, [1.0] * 50, 16).unionByName(parts(spark, [-1.0] * 9, 16, "b"))
    got = rates.resampled(both, 1, 3, 16, slope=0.5)
    assert {r.track: r.n for r in got.groupBy("track").agg(F.sum(F.size("x")).alias("n")).collect()} == {"a": 17, "b": 3}
    with pytest.raises(ValueError, match="positive"):
        rates.resampled(both, 0, 1, 8)

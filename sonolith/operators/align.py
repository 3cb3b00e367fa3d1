"""Delay, drift and block decisions between a reference and a test signal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from .chunks import asked, blocks, frame, stretch
from .quantiles import medians

#: Taps on each side of a resampler, and the fractional positions that have taps of their own.
HALF, PHASES = 32, 1024
#: Known speed ratios and their labels, in order of preference; fixed values.
KNOWN_RATIOS = [(25 / 24, "pal_up"), (24 / 25, "pal_down"), (30 / 29.97, "ntsc_up"), (29.97 / 30, "ntsc_down"), (1.0001, "1_0001")]


def envelope(series: DataFrame, size: int, hop: int, *, key: str | None = None, pos: str = "pos", value: str = "x") -> DataFrame:
    """([key,] frame, e): mean square of `size` samples from frame * hop on, whole frames only.

    Each sample goes to the frames that hold it, so partial sums leave the map side.
    """
    last, first = F.floor(F.col(pos) / hop).cast("long"), F.greatest(F.lit(0).cast("long"), F.ceil((F.col(pos) - size + 1) / hop).cast("long"))
    keys = [] if key is None else [key]
    rows = series.select(*keys, (F.col(value) * F.col(value)).alias("p"), F.explode(F.sequence(first, last)).alias("frame"))
    return rows.groupBy(*keys, "frame").agg(F.avg("p").alias("e"), F.count("*").alias("m")).where(F.col("m") == size).drop("m")


def zscore_db(frames: DataFrame, value: str = "e", span_db: float = 80.0, key: str | None = None) -> DataFrame:
    """Adds z: dB held within `span_db` of the (key's) peak, less its mean, over its population deviation."""
    keys = [] if key is None else [key]
    joined = lambda rows, some: rows.join(F.broadcast(some), F.lit(True)) if not keys else rows.join(some, keys)
    db = 10 * F.log10(F.greatest(F.col(value), F.col("top") * 10 ** (-span_db / 10), F.lit(1e-30)))
    rows = joined(frames, frames.groupBy(*keys).agg(F.max(value).alias("top"))).withColumn("db", db)
    rows = joined(rows, rows.groupBy(*keys).agg(F.avg("db").alias("mean"), F.stddev_pop("db").alias("sd")))
    return rows.withColumn("z", F.when(F.col("sd") > 0, (F.col("db") - F.col("mean")) / F.when(F.col("sd") > 0, F.col("sd"))).otherwise(0.0)).drop("top", "mean", "sd")


def mostly_silent(frames: DataFrame, per: int, value: str = "z", most: float = 0.5) -> DataFrame:
    """(block, at_floor, frames, silent): runs of `per` frames of which more than `most` lie at the envelope's floor.

    Without a floor that is at least 1 below the median nothing is silent.
    """
    levels = frames.agg(F.min(value).alias("low")).join(F.broadcast(medians(frames, [], value, "mid")), F.lit(True))  # a row each
    rows = frames.join(F.broadcast(levels), F.lit(True)).groupBy(F.floor(F.col("frame") / per).cast("long").alias("block"))
    rows = rows.agg(F.count_if(F.col(value) <= F.col("low") + 1e-3).alias("at_floor"), F.count("*").alias("frames"), F.bool_and(F.col("low") <= F.col("mid") - 1).alias("deep"))
    return rows.select("block", "at_floor", "frames", (F.col("deep") & (F.col("at_floor") > most * F.col("frames"))).alias("silent"))


def _keyed(series: DataFrame, key: str | None, pos: str, value: str) -> DataFrame:
    return series.select((F.lit(0) if key is None else F.col(key)).alias("track"), F.col(pos).alias("pos"), F.col(value).alias("x"))


def lag_correlations(ref: DataFrame, test: DataFrame, most: int, *, key: str | None = None, pos: str = "pos", value: str = "x", size: int = 1 << 16) -> DataFrame:
    """([key,] lag, rho, overlap): Pearson correlation over the overlap at each lag up to `most`.

    test[t] = ref[t - lag]. A block of the test and the reference around it give all their lags
    at once, by transforms and running sums; a row a lag leaves each block, and those are added.
    """
    a, b = (blocks(_keyed(s, key, pos, value), size) for s in (ref, test))
    rows = b.select("track", F.col("block").alias("chunk"), (F.col("start") - most).alias("lo"), (F.col("start") + F.size("x") + most).alias("hi"))
    own = b.select("track", F.col("block").alias("chunk"), F.lit("test").alias("role"), "block", "start", "x")
    sides = asked(rows, a, "ref", size, "lo", "hi", ["track", "chunk"]).unionByName(own)
    names = ("n", "a", "b", "aa", "bb", "ab")

    def sums(k: tuple, group: pd.DataFrame) -> pd.DataFrame:
        base, x = stretch(group, "ref")
        first, y = stretch(group, "test")
        if not len(x) or not len(y):
            return frame({"track": [], "lag": [], **dict.fromkeys(names, [])})
        lags = np.arange(-most, most + 1)
        lo = np.clip(np.maximum(first, base + lags), first, first + len(y))  # the test's positions that have a partner
        hi = np.clip(np.minimum(first + len(y), base + len(x) + lags), lo, first + len(y))
        upto = lambda v: np.concatenate([[0.0], np.cumsum(v)])
        part = lambda v, at, to: upto(v)[np.clip(to, 0, len(v))] - upto(v)[np.clip(at, 0, len(v))]
        mx, my = x.mean(), y.mean()  # sums of what is left of a mean lose no digits to it
        u, w = x - mx, y - my
        n = 1 << (len(x) + len(y) - 1).bit_length()
        product = np.fft.irfft(np.conj(np.fft.rfft(u, n)) * np.fft.rfft(w, n), n)
        ab = product[(lags + base - first) % n]
        count = (hi - lo).astype(float)
        sa, sb = part(u, lo - lags - base, hi - lags - base), part(w, lo - first, hi - first)
        saa, sbb = part(u * u, lo - lags - base, hi - lags - base), part(w * w, lo - first, hi - first)
        ab = ab + mx * sb + my * sa + mx * my * count
        out = {"n": count, "a": sa + mx * count, "b": sb + my * count, "aa": saa + 2 * mx * sa + mx * mx * count, "bb": sbb + 2 * my * sb + my * my * count, "ab": ab}
        some = count > 0
        return frame({"track": [k[0]] * int(some.sum()), "lag": lags[some], **{c: v[some] for c, v in out.items()}})

    kind = a.schema["track"].dataType.simpleString()
    partial = sides.groupBy("track", "chunk").applyInPandas(sums, f"track {kind}, lag long, " + ", ".join(f"{c} double" for c in names))
    s = partial.groupBy("track", "lag").agg(*(F.sum(c).alias(c) for c in names))
    va, vb = F.col("aa") - F.col("a") * F.col("a") / F.col("n"), F.col("bb") - F.col("b") * F.col("b") / F.col("n")
    cov = F.col("ab") - F.col("a") * F.col("b") / F.col("n")
    rho = F.when((va > 0) & (vb > 0), cov / F.sqrt(F.when((va > 0) & (vb > 0), va * vb)))
    out = s.select("track", "lag", rho.alias("rho"), F.col("n").cast("long").alias("overlap"))
    return out.drop("track") if key is None else out.withColumnRenamed("track", key)


def first_best(rows: DataFrame, value: Column, order: Column, keys: list[str]) -> DataFrame:
    """The row of the largest value; of equals the one with the smallest order."""
    best = F.max(F.struct(value.alias("v"), (-order).alias("o"), F.struct("*").alias("row"))).alias("best")
    return rows.groupBy(*keys).agg(best).select("best.row.*")


def peak_to_sidelobe(rows: DataFrame, value: str, at: str, exclude: int) -> DataFrame:
    """(peak_at, peak, ratio): the largest magnitude over the median of those beyond `exclude`."""
    top = first_best(rows.withColumn("m", F.abs(value)), F.col("m"), F.col(at), []).select(F.col(at).alias("peak_at"), F.col("m").alias("peak"))
    side = rows.join(F.broadcast(top), F.lit(True)).groupBy("peak_at", "peak").agg(F.percentile(F.when(F.abs(F.col(at) - F.col("peak_at")) > exclude, F.abs(value)), 0.5).alias("median"))
    return side.select("peak_at", "peak", F.when(F.col("median") > 0, F.col("peak") / F.when(F.col("median") > 0, F.col("median"))).alias("ratio"))


def eroded_blocks(blocks: DataFrame, ok: str, *, key: str, order: str) -> DataFrame:
    """Adds kept: a block stays if it and both neighbours are aligned; edges and unknown ones count as aligned."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-1, 1)
    return blocks.withColumn("kept", F.min(F.coalesce(F.col(ok).cast("int"), F.lit(1))).over(w) == 1)


def line_fit(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, slope, intercept, max_residual) by least squares."""
    fit = points.groupBy(key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    worst = points.join(fit, key).groupBy(key).agg(F.max(F.abs(F.col(y) - F.col("intercept") - F.col("slope") * F.col(x))).alias("max_residual"))
    return fit.join(worst, key)


def snap(ratio: Column) -> tuple[Column, Column]:
    """(ratio, label) of the first known speed within the larger of 1e-5 and 2 % of its distance from 1."""
    value = label = None
    for known, name in KNOWN_RATIOS:
        near = F.abs(ratio - known) <= max(1e-5, 0.02 * abs(known - 1))
        value = F.when(near, known) if value is None else value.when(near, known)
        label = F.when(near, name) if label is None else label.when(near, name)
    return value, label


def fractional_shift(x: np.ndarray, delay: float) -> np.ndarray:
    """Circular delay by a phase ramp; positive is later."""
    if len(x) < 8:
        raise ValueError("a shift needs 8 samples at least")
    f = np.fft.rfftfreq(len(x))
    return np.fft.irfft(np.fft.rfft(x) * np.exp(-2j * np.pi * f * delay), len(x))


def refined(a: np.ndarray, b: np.ndarray, *, search: float = 1.0, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(delay, correlation, sharpness) of each row of b against the same row of a.

    The delay within +-search at which |<shift(a), b>| is largest: by a coarse grid, then by
    golden sections, for all rows at once over their spectra. NaN at the search's boundary and
    for silent rows. Sharpness is the residual half a sample off over the residual at the peak.
    """
    n = a.shape[1]
    weight = np.full(n // 2 + 1, 2.0)
    weight[0] = 1.0
    if n % 2 == 0:
        weight[-1] = 1.0
    cross = np.fft.rfft(a, axis=1) * np.conj(np.fft.rfft(b, axis=1)) * weight / n
    turn = -2j * np.pi * np.fft.rfftfreq(n)
    inner = lambda d: (cross * np.exp(turn * d[:, None])).real.sum(1)
    grid = np.linspace(-search, search, int(8 * search) + 1)
    coarse = np.abs(np.stack([inner(np.full(len(a), d)) for d in grid], 1))
    best, step = grid[coarse.argmax(1)], grid[1] - grid[0]
    lo, hi, phi = np.maximum(best - step, -search), np.minimum(best + step, search), (5**0.5 - 1) / 2
    c, d = hi - phi * (hi - lo), lo + phi * (hi - lo)
    fc, fd = np.abs(inner(c)), np.abs(inner(d))
    while (hi - lo).max(initial=0.0) > tolerance:
        left = fc > fd
        lo, hi = np.where(left, lo, c), np.where(left, d, hi)
        c, d = np.where(left, hi - phi * (hi - lo), d), np.where(left, c, lo + phi * (hi - lo))
        fc, fd = np.abs(inner(c)), np.abs(inner(d))
    delay = (lo + hi) / 2
    power_a, power_b = (a * a).sum(1), (b * b).sum(1)
    silent = (power_a <= 0) | (power_b <= 0)
    size = np.sqrt(np.where(silent, 1.0, power_a * power_b))
    residual = lambda d: power_b - inner(d) ** 2 / np.where(silent, 1.0, power_a)
    at_peak = np.maximum(residual(delay), 0.0)
    off = np.minimum(residual(delay - 0.5), residual(delay + 0.5))
    sharp = np.where(at_peak > 0, off / np.where(at_peak > 0, at_peak, 1.0), np.inf)
    r = inner(delay) / size
    return np.where(silent | (np.abs(delay) >= search - 10 * tolerance), np.nan, delay), np.where(silent, 0.0, r), sharp


def phase_slopes(a: np.ndarray, b: np.ndarray, band: tuple[float, float] = (0.02, 0.4)) -> np.ndarray:
    """The delay of each row of b against a by the slope of the unwrapped phase, weighted by amplitude; for small delays only."""
    n = a.shape[1]
    f = np.fft.rfftfreq(n)
    inside = (f >= band[0]) & (f <= band[1])
    cross = (np.fft.rfft(b, axis=1) * np.conj(np.fft.rfft(a, axis=1)))[:, inside]
    w, x, y = np.abs(cross), f[inside], np.unwrap(np.angle(cross), axis=1)
    total = np.maximum(w.sum(1), 1e-300)
    mx, my = (w * x).sum(1) / total, (w * y).sum(1) / total
    dx = x - mx[:, None]
    slope = (w * dx * (y - my[:, None])).sum(1) / np.maximum((w * dx * dx).sum(1), 1e-300)
    return -slope / (2 * np.pi)


def refine_delays(pairs: DataFrame, key: str) -> DataFrame:
    """(key, delay, correlation, sharpness, status) of rows (key, a, b) of equal lengths: sub-sample delay of b against a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.asarray(batch[c].flatten(), float).reshape(batch.num_rows, -1) for c in ("a", "b"))
                delay, r, sharp = refined(a, b)
                status = np.where(np.isnan(delay), "invalid", np.where(np.abs(r) >= 0.6, "ok", "weak"))
                yield pa.RecordBatch.from_arrays([batch[key], pa.array(delay, mask=np.isnan(delay)), pa.array(r), pa.array(sharp), pa.array(status.tolist())], [key, "delay", "correlation", "sharpness", "status"])

    return pairs.select(key, "a", "b").mapInArrow(run, f"{key} {pairs.schema[key].dataType.simpleString()}, delay double, correlation double, sharpness double, status string")


def delayed(frames: DataFrame, delay: float, column: str = "a") -> DataFrame:
    """`frames` with `b`: the arrays in `column`, circularly later by `delay` samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.asarray(batch[column].flatten(), float).reshape(batch.num_rows, -1)
                n = x.shape[1]
                y = np.fft.irfft(np.fft.rfft(x, axis=1) * np.exp(-2j * np.pi * np.fft.rfftfreq(n) * delay), n, axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(y.ravel()), n).cast(pa.list_(pa.float64()))], [*batch.schema.names, "b"])

    return frames.mapInArrow(run, StructType([*frames.schema.fields, StructField("b", ArrayType(DoubleType()))]))


def kaiser_taps(phases: int, half: int = 32, beta: float = 10.0) -> np.ndarray:
    """(phases + 1, 2 * half) taps of a Kaiser-windowed sinc for each fractional position."""
    frac = np.arange(phases + 1)[:, None] / phases
    t = np.arange(-half + 1, half + 1)[None, :] - frac
    return np.sinc(t) * np.i0(beta * np.sqrt(np.maximum(0, 1 - (t / half) ** 2))) / np.i0(beta)


def sampled(x: np.ndarray, base: int, at: np.ndarray, taps: np.ndarray, *, nearest: bool = False) -> np.ndarray:
    """Samples of x, whose first is at `base`, at fractional positions; NaN where taps are missing.

    Taps between two phases are read linearly, or those of the nearest phase are taken.
    """
    phases, half = taps.shape[0] - 1, taps.shape[1] // 2
    whole = np.floor(at).astype(np.int64)
    phase = (at - whole) * phases
    low = np.rint(phase).astype(np.int64) if nearest else np.minimum(phase.astype(np.int64), phases - 1)
    share = 0.0 * phase if nearest else phase - low
    high = np.minimum(low + 1, phases)
    first = whole - base - half + 1
    ok = (first >= 0) & (first + 2 * half <= len(x))
    out = np.full(len(at), np.nan)
    for part in np.array_split(np.flatnonzero(ok), max(1, len(at) // 8192)):
        near = x[first[part][:, None] + np.arange(2 * half)]
        y = np.einsum("ij,ij->i", near, taps[low[part]])
        out[part] = y if nearest else y + share[part] * (np.einsum("ij,ij->i", near, taps[high[part]]) - y)
    return out


def warp(series: DataFrame, slope: float, intercept: float, *, phases: int = PHASES, half: int = HALF, nearest: bool = False, key: str | None = None, pos: str = "pos", value: str = "x", size: int = 1 << 16) -> DataFrame:
    """([key,] pos, y): the series at positions p - (intercept + slope * p), by a windowed sinc.

    Blocks of the output ask for the blocks of samples around them. Outputs without all taps are left out.
    """
    taps = kaiser_taps(phases, half)
    parts = blocks(_keyed(series, key, pos, value), size)
    # the outputs that read a block lie around where it is moved to
    begin, end = F.col("start"), F.col("start") + F.size("x")
    reach = lambda p, by: F.floor((p + by + intercept) / (1 - slope) / size).cast("long")
    chunk = F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), reach(begin, -half - 1)), F.greatest(F.lit(0).cast("long"), reach(end, half + 1))))
    rows = parts.select("track", chunk.alias("chunk"), F.lit("ref").alias("role"), "block", "start", "x")

    def run(k: tuple, group: pd.DataFrame) -> pd.DataFrame:
        base, x = stretch(group, "ref")
        p = k[1] * size + np.arange(size)
        y = sampled(x, base, p - (intercept + slope * p), taps, nearest=nearest)
        ok = ~np.isnan(y)
        return frame({"track": [k[0]] * int(ok.sum()), "pos": p[ok], "y": y[ok]})

    kind = parts.schema["track"].dataType.simpleString()
    out = rows.groupBy("track", "chunk").applyInPandas(run, f"track {kind}, pos long, y double").withColumnRenamed("pos", pos)
    return out.drop("track") if key is None else out.withColumnRenamed("track", key)

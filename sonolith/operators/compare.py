"""Comparing tracks of any length: blocks of samples, drift between them, and their aligned spectra.

A track is rows (track, block, start, x) as `blocks` makes them. A chunk of work is
one block of the test, with a halo of its own and the blocks of the reference that it needs. These
come to it by an equi-join on the block number, so that memory depends on the block's size alone
and all tracks of a table are compared in one job. A delay model is rows (track, slope, intercept):
the test's sample T is the reference's at T - (intercept + slope * T).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import align, robust
from .chunks import asked as _asked
from .chunks import blocks, frame, lengths, stretch
from .shared import written

HALF, PHASES = align.HALF, align.PHASES
#: Anchors: seconds of a window, how much drift widens the search, the least correlation, and how many make an estimate; fixed values.
WINDOW_S, MAX_DRIFT, LEAST_R, MIN_ANCHORS = 0.25, 2e-3, 0.3, 12
#: Residuals and delays agree within these; fixed values.
MAX_RESIDUAL_MS, NEGLIGIBLE_PPM, MAX_AMBIGUITY, MIN_PERIODIC = 20.0, 5.0, 0.5, 5


def _chunks(ref: DataFrame, test: DataFrame, model: DataFrame, size: int, tail: int) -> DataFrame:
    """(track, chunk, slope, intercept, role, block, x): what each block of the test needs, `tail` samples beyond it included."""
    rows = test.select("track", F.col("block").alias("chunk")).join(model, "track")
    begin, end = F.col("chunk") * size, (F.col("chunk") + 1) * size + tail
    source = lambda p: p - (F.col("intercept") + F.col("slope") * p)
    rows = rows.select("*", begin.alias("lo"), end.alias("hi"), (F.floor(source(begin)) - HALF).cast("long").alias("ref_lo"), (F.ceil(source(end)) + HALF + 1).cast("long").alias("ref_hi"))
    keys = ["track", "chunk", "slope", "intercept"]
    return _asked(rows, test, "test", size, "lo", "hi", keys).unionByName(_asked(rows, ref, "ref", size, "ref_lo", "ref_hi", keys))


def warped(ref: DataFrame, like: DataFrame, model: DataFrame, size: int) -> DataFrame:
    """(track, block, start, x): the reference resampled to the test's time by the model; what it lacks is silence."""
    taps = align.kaiser_taps(PHASES, HALF)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        track, chunk, slope, intercept = key
        base, x = stretch(rows, "ref")
        _, own = stretch(rows[rows.block == chunk], "test")
        t = chunk * size + np.arange(len(own))
        y = align.sampled(x, base, t - (intercept + slope * t), taps)
        return frame({"track": [track], "block": [chunk], "start": [chunk * size], "x": [np.nan_to_num(y)]})

    kind = like.schema["track"].dataType.simpleString()
    return _chunks(ref, like, model, size, 0).groupBy("track", "chunk", "slope", "intercept").applyInPandas(run, f"track {kind}, block long, start long, x array<double>")


def cross_spectrum(ref: DataFrame, test: DataFrame, model: DataFrame, *, size: int, fft: int, hop: int, windowed: bool = True) -> DataFrame:
    """(track, bin, saa, sbb, sab_re, sab_im, frames) of the test's frames and the reference's at the same place.

    A frame belongs to the block where it starts (`hop` divides `size`, `fft` is no longer than
    that). Frames that either side does not wholly have are left out.
    """
    taps = align.kaiser_taps(PHASES, HALF)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(fft) / fft) if windowed else np.ones(fft)
    n = fft // 2 + 1

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        track, chunk, slope, intercept = key
        base, x = stretch(rows, "ref")
        first, b = stretch(rows, "test")
        none = frame({"track": [], "sums": []})
        if first != chunk * size or len(b) < fft:
            return none
        b = b[: size + fft - hop]
        t = first + np.arange(len(b))
        if slope == 0 and float(intercept).is_integer():
            at = t - int(intercept) - base
            a = np.where((at >= 0) & (at < len(x)), x[np.clip(at, 0, max(len(x) - 1, 0))], np.nan) if len(x) else np.full(len(b), np.nan)
        else:
            a = align.sampled(x, base, t - (intercept + slope * t), taps)
        cut = lambda v: np.lib.stride_tricks.sliding_window_view(v, fft)[::hop]
        fa, fb = cut(a), cut(b)
        good = ~np.isnan(fa).any(1)
        if not good.any():
            return none
        za, zb = (np.fft.rfft(f[good] * window, axis=1) for f in (fa, fb))
        cross = np.conj(za) * zb
        sums = np.concatenate([(np.abs(za) ** 2).sum(0), (np.abs(zb) ** 2).sum(0), cross.real.sum(0), cross.imag.sum(0), [good.sum()]])
        return frame({"track": [track], "sums": [sums]})

    kind = test.schema["track"].dataType.simpleString()
    partial = _chunks(ref, test, model, size, fft).groupBy("track", "chunk", "slope", "intercept").applyInPandas(run, f"track {kind}, sums array<double>")
    rows = partial.select("track", F.get("sums", F.lit(4 * n)).cast("long").alias("frames"), F.posexplode(F.arrays_zip(*(F.slice("sums", k * n + 1, n).alias(c) for k, c in enumerate(("saa", "sbb", "sab_re", "sab_im"))))).alias("bin", "z"))
    return rows.select("track", F.col("bin").cast("long").alias("bin"), "z.*", "frames").groupBy("track", "bin").agg(*(F.sum(c).alias(c) for c in ("saa", "sbb", "sab_re", "sab_im", "frames")))


def measurement_floor(ref: DataFrame, model: DataFrame, *, size: int, fft: int, hop: int) -> DataFrame:
    """The cross-spectrum of a track with itself, sent through the chain's resampler: what is incoherent in it is the chain's own."""
    return cross_spectrum(ref, warped(ref, ref, model, size), model, size=size, fft=fft, hop=hop)


def _phat(a: np.ndarray, b: np.ndarray) -> tuple[int, float, float]:
    """(lag, peak over the median elsewhere, ambiguity) of b against a, b[t] = a[t - lag]."""
    n = 1 << (len(a) + len(b) - 1).bit_length()
    cross = np.conj(np.fft.rfft(a, n)) * np.fft.rfft(b, n)
    size = np.abs(cross)
    least = 1e-3 * size.max() if size.size else 0.0
    white = np.abs(np.fft.irfft(np.where(size > least, cross / np.maximum(size, 1e-300), 0), n))
    plain = np.abs(np.fft.irfft(cross, n))
    top = int(white.argmax())
    median = float(np.median(white))
    return top - n if top > n // 2 else top, float(white[top] / median) if median > 0 else float("inf"), min(_side_lobe(white), _side_lobe(plain))


def _side_lobe(v: np.ndarray) -> float:
    """The largest value outside the peak's monotone lobe, over the peak."""
    v = np.roll(v, -int(v.argmax()))
    if v[0] <= 0:
        return 0.0
    right = int(np.argmax(np.diff(v) > 0)) + 1
    left = int(np.argmax(np.diff(v[::-1]) > 0)) + 1
    return float(v[right : len(v) - left].max(initial=0.0) / v[0])


def _correlation(a: np.ndarray, b: np.ndarray) -> float:
    size = float(np.linalg.norm(a) * np.linalg.norm(b))
    return float(a @ b) / size if size else 0.0


def anchors(ref: DataFrame, test: DataFrame, speeds: list[float], *, size: int, rate: int, count: int = 30, window_s: float = WINDOW_S, coarse: DataFrame | None = None, least: float = LEAST_R) -> DataFrame:
    """(track, speed, position_s, lag_s, r, psr, ambiguity): delays at `count` places of each track, under each speed.

    A speed is the test's time over the reference's; the test is read at that speed (linearly
    between samples) before it is searched for. The radius of the search grows with the position.
    Places whose correlation is below `least` in magnitude are left out. coarse: (track, lag_s).
    """
    n_window = int(window_s * rate)
    sizes = lengths(test).join(lengths(ref).withColumnRenamed("n", "n_ref"), "track")
    sizes = sizes.join(coarse, "track", "left") if coarse is not None else sizes.withColumn("lag_s", F.lit(0.0))
    rows = sizes.select("track", F.col("n").alias("n_test"), "n_ref", F.coalesce("lag_s", F.lit(0.0)).alias("lag_s"), F.explode(F.array(*map(F.lit, speeds))).alias("speed"), F.lit(count).alias("count"))
    room = F.floor(F.col("n_test") / F.col("speed")) - n_window - 1
    rows = rows.where((room > 0) & (F.col("n_ref") >= n_window)).select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("i"), room.alias("room"))
    start = F.floor(F.col("i") * F.col("room") / (count - 1)).cast("long")
    rows = rows.select("track", "speed", "i", "n_ref", start.alias("place"), "lag_s")
    radius = ((window_s + MAX_DRIFT * (F.col("place") + n_window / 2) / rate) * rate).cast("long")
    centre = F.col("place") - (F.col("lag_s") * rate).cast("long")
    rows = rows.select("*", F.greatest(F.lit(0), centre - radius).alias("ref_lo"), F.least(F.col("n_ref"), centre + n_window + radius).alias("ref_hi"))
    rows = rows.select("*", F.floor(F.col("place") * F.col("speed")).cast("long").alias("lo"), (F.ceil((F.col("place") + n_window) * F.col("speed")) + 1).cast("long").alias("hi"))
    keys = ["track", "speed", "i", "place", "ref_lo", "ref_hi"]
    sides = _asked(rows, test, "test", size, "lo", "hi", keys).unionByName(_asked(rows, ref, "ref", size, "ref_lo", "ref_hi", keys))

    def probe(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        track, speed, _, start, lo, hi = key
        out = {"track": [], "speed": [], "position_s": [], "lag_s": [], "r": [], "psr": [], "ambiguity": []}
        base, x = stretch(group, "ref")
        first, y = stretch(group, "test")
        a = x[max(0, lo - base) : hi - base]
        at = (start + np.arange(n_window)) * speed - first
        if len(a) >= n_window and len(y) and at[-1] <= len(y) - 1:
            b = np.interp(at, np.arange(len(y)), y)
            lag, psr, ambiguity = _phat(a, b)
            if 0 <= -lag <= len(a) - n_window:
                r = _correlation(a[-lag : n_window - lag], b)
                if abs(r) >= least:
                    for name, v in zip(out, (track, speed, (start + n_window / 2) / rate, (lag + start - lo) / rate, r, psr, ambiguity), strict=True):
                        out[name].append(v)
        return frame(out)

    kind = test.schema["track"].dataType.simpleString()
    return sides.groupBy(*keys).applyInPandas(probe, f"track {kind}, speed double, position_s double, lag_s double, r double, psr double, ambiguity double")


def drift(found: DataFrame) -> DataFrame:
    """(track, status, speed, label, slope, offset_s, anchors, residual_ms, periodic) of `anchors`.

    Of the speeds with enough anchors the one with the largest median correlation is taken; what
    drift is left under it comes from a robust line. A line that its anchors do not follow, and a
    signal that repeats itself, are unreliable. Speeds near a known one are taken as that.
    """
    found = written(found, "anchors")
    groups = found.groupBy("track", "speed").agg(F.count("*").alias("m"), F.percentile(F.abs("r"), 0.5).alias("score"), F.percentile("ambiguity", 0.5).alias("ambiguity"))
    periodic = groups.where((F.col("speed") == 1.0) & (F.col("m") >= MIN_PERIODIC) & (F.col("ambiguity") > MAX_AMBIGUITY)).select("track", F.lit(True).alias("periodic"))
    best = groups.where(F.col("m") >= MIN_ANCHORS).groupBy("track").agg(F.max_by(F.struct("speed", "m"), F.struct("score", -F.abs(F.col("speed") - 1))).alias("b")).select("track", "b.speed", F.col("b.m").alias("anchors"))
    points = found.join(best.select("track", "speed"), ["track", "speed"]).select("track", "position_s", "lag_s")
    line = robust.theil_sen(points, "track", "position_s", "lag_s")
    spread = robust.mad(points, line, "track", "position_s", "lag_s").select("track", (F.col("mad") * 1000).alias("residual_ms"))
    rows = found.select("track").distinct().join(best, "track", "left").join(line, "track", "left").join(spread, "track", "left").join(periodic, "track", "left")
    ratio = F.col("speed") / (1 - F.col("slope"))
    known, label = align.snap(ratio)
    bad = F.coalesce(F.col("periodic"), F.lit(False)) | F.col("speed").isNull() | (F.col("residual_ms") > MAX_RESIDUAL_MS)
    status = F.when(bad, "unreliable").when(known.isNull() & (F.abs(ratio - 1) * 1e6 <= NEGLIGIBLE_PPM), "none").otherwise("drift")
    out = rows.select("track", status.alias("status"), F.coalesce(known, ratio).alias("ratio"), label.alias("label"), F.col("intercept").alias("offset_s"), F.coalesce("anchors", F.lit(0)).cast("long").alias("anchors"), "residual_ms", F.coalesce("periodic", F.lit(False)).alias("periodic"))
    return out.withColumn("speed", F.when(F.col("status") == "drift", F.col("ratio")).otherwise(1.0)).drop("ratio")


def model_of(estimates: DataFrame, rate: int) -> DataFrame:
    """(track, slope, intercept) in samples of `drift`'s speeds and offsets."""
    return estimates.where("status <> 'unreliable'").select("track", (1 - 1 / F.col("speed")).alias("slope"), (F.col("offset_s") * rate).alias("intercept"))


def tracked(ref: DataFrame, test: DataFrame, model: DataFrame, *, size: int, rate: int, points: int = 9, window_s: float = 0.5, rounds: int = 5, settled: float = 1e-5) -> DataFrame:
    """(track, slope, intercept, rounds): the model after the delays that it leaves at `points` windows are fitted by a line, again and again.

    A track is done when a round changes its delay by no more than `settled` samples anywhere, or
    after `rounds` of them; tracks that are done are not read again. `rounds` of the result says how
    many changed a track. Windows whose delay is not certain are left out; a track with fewer than
    three of them keeps its model and is done.
    """
    taps, n_window = align.kaiser_taps(PHASES, HALF), int(window_s * rate)
    kind = test.schema["track"].dataType.simpleString()

    def residual(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        track, slope, intercept, _, start = key
        base, x = stretch(rows, "ref")
        first, y = stretch(rows, "test")
        b = y[start - first : start - first + n_window]
        t = start + np.arange(len(b))
        a = align.sampled(x, base, t - (intercept + slope * t), taps) if len(x) else np.full(len(b), np.nan)
        out = {"track": [], "at": [], "residual": []}
        if len(b) == n_window and not np.isnan(a).any():
            delay, r, _ = align.refined(a[None], b[None], search=4.0)
            if abs(r[0]) >= 0.6:
                out = {"track": [track], "at": [start + n_window / 2], "residual": [float(delay[0])]}
        return frame(out)

    n = lengths(test).withColumnRenamed("n", "n_test").join(lengths(ref).withColumnRenamed("n", "n_ref"), "track")
    model = written(model.select("track", "slope", "intercept", F.lit(0).alias("rounds"), F.lit(True).alias("open")), "delays")
    for _ in range(rounds):
        todo = model.where("open")
        if todo.isEmpty():
            break
        rows = todo.join(n, "track")
        lo = F.ceil(F.greatest(F.lit(0.0), (F.col("intercept") + HALF) / (1 - F.col("slope"))))
        hi = F.floor(F.least(F.col("n_test").cast("double"), (F.col("n_ref") - HALF - 2 + F.col("intercept")) / (1 - F.col("slope")))) - n_window
        rows = rows.select("track", "slope", "intercept", lo.alias("a"), hi.alias("z")).where("z > a")
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"))
        rows = rows.select("track", "slope", "intercept", "i", (F.col("a") + F.floor(F.col("i") * (F.col("z") - F.col("a")) / (points - 1))).cast("long").alias("place"))
        source = lambda p: p - (F.col("intercept") + F.col("slope") * p)
        rows = rows.select("*", F.col("place").alias("lo"), (F.col("place") + n_window).alias("hi"), (F.floor(source(F.col("place"))) - HALF).alias("ref_lo"), (F.ceil(source(F.col("place") + n_window)) + HALF + 1).alias("ref_hi"))
        keys = ["track", "slope", "intercept", "i", "place"]
        sides = _asked(rows, test, "test", size, "lo", "hi", keys).unionByName(_asked(rows, ref, "ref", size, "ref_lo", "ref_hi", keys))
        left = sides.groupBy(*keys).applyInPandas(residual, f"track {kind}, at double, residual double")
        fit = left.groupBy("track").agg(F.regr_slope("residual", "at").alias("ds"), F.regr_intercept("residual", "at").alias("di"), F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("m")).where("m >= 3").drop("m")
        change = F.greatest(*(F.abs(F.col("di") + F.col("ds") * F.col(c)) for c in ("first", "last")))
        model = model.join(fit, "track", "left").select(
            "track", (F.col("slope") + F.coalesce("ds", F.lit(0.0))).alias("slope"), (F.col("intercept") + F.coalesce("di", F.lit(0.0))).alias("intercept"),
            (F.col("rounds") + F.when(F.col("ds").isNotNull(), 1).otherwise(0)).alias("rounds"), (F.coalesce(change, F.lit(0.0)) > settled).alias("open"),
        )
        model = written(model, "delays")  # a row for each track
    return model.drop("open")


def excerpt_pairs(ref: DataFrame, test: DataFrame, model: DataFrame, starts: DataFrame, *, size: int, length: int, peak: float = 0.98) -> DataFrame:
    """(track, start, a, b): excerpts for listening, aligned, equally loud and of one polarity.

    model: (track, slope, intercept, gain); starts: (track, start), where the test's excerpt of
    `length` samples begins. The test is divided by its gain, and both are lowered together if
    either exceeds `peak`. Excerpts that either side does not wholly have are left out.
    """
    taps = align.kaiser_taps(PHASES, HALF)
    rows = model.join(starts.select("track", F.col("start").alias("place")), "track").where("gain <> 0")
    source = lambda p: p - (F.col("intercept") + F.col("slope") * p)
    rows = rows.select("*", F.col("place").alias("lo"), (F.col("place") + length).alias("hi"), (F.floor(source(F.col("place"))) - HALF).alias("ref_lo"), (F.ceil(source(F.col("place") + length)) + HALF + 1).alias("ref_hi"))
    keys = ["track", "slope", "intercept", "gain", "place"]
    sides = _asked(rows, test, "test", size, "lo", "hi", keys).unionByName(_asked(rows, ref, "ref", size, "ref_lo", "ref_hi", keys))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        track, slope, intercept, gain, place = key
        base, x = stretch(group, "ref")
        first, y = stretch(group, "test")
        t = place + np.arange(length)
        a = align.sampled(x, base, t - (intercept + slope * t), taps) if len(x) else np.full(length, np.nan)
        b = y[place - first : place - first + length] / gain
        if len(b) < length or np.isnan(a).any():
            return pd.DataFrame({"track": pd.Series([], dtype=object), "start": pd.Series([], dtype=np.int64), "a": pd.Series([], dtype=object), "b": pd.Series([], dtype=object)})
        scale = min(1.0, peak / max(np.abs(a).max(), np.abs(b).max(), 1e-30))
        return pd.DataFrame({"track": pd.Series([track], dtype=object), "start": [place], "a": [a * scale], "b": [b * scale]})

    kind = test.schema["track"].dataType.simpleString()
    return sides.groupBy(*keys).applyInPandas(run, f"track {kind}, start long, a array<double>, b array<double>")


def fan_out(frames: DataFrame, *sinks: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """One pass over what makes `frames`, into several aggregates."""
    frames = written(frames, "frames")
    return [sink(frames) for sink in sinks]

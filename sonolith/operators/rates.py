"""Other sample rates, and envelopes from them, block by block.

Each block of the outcome asks for the samples around its own place, filters them by transforms, one
for each phase of the ratio, and keeps every `down`-th value. Samples never become rows.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import asked, frame, lengths, stretch

#: The middle of the filter's slope, as a share of the lower of both Nyquist rates, and what it leaves beyond, in dB.
CUTOFF, STOP_DB = 0.99, 110.0


@cache
def low_pass(up: int, down: int, slope: float = 0.02, stop_db: float = STOP_DB) -> np.ndarray:
    """Taps of a windowed sinc at `up` times the rate, an odd number around 0; those of each phase add to 1.

    The slope from full to nothing takes the share `slope` of the lower Nyquist rate, around CUTOFF
    and ending at that rate if it is twice 1 - CUTOFF.
    """
    widest = max(up, down)
    half = math.ceil((stop_db - 7.95) / (2.285 * slope * math.pi / widest) / 2)
    at = np.arange(-half, half + 1)
    beta = 0.1102 * (stop_db - 8.7)
    taps = np.sinc(at * CUTOFF / widest) * np.kaiser(2 * half + 1, beta)
    for phase in range(up):
        mine = (at - phase) % up == 0
        taps[mine] /= taps[mine].sum()
    return taps


def converted(x: np.ndarray, first: int, begin: int, end: int, up: int, down: int, taps: np.ndarray) -> np.ndarray:
    """Values begin .. end - 1 at up / down times the rate, of samples that start at `first` and are 0 around."""
    half, out = len(taps) // 2, np.zeros(end - begin)
    places = np.arange(begin, end, dtype=np.int64) * down
    for phase in range(up):
        mine = np.flatnonzero(places % up == phase)
        if not len(mine):
            continue
        # y[n] = sum of taps[m] x[(n down - m) / up] over the m of the phase
        ms = np.arange(-half, half + 1)
        part = taps[(ms - phase) % up == 0]
        low = (int(ms[(ms - phase) % up == 0][0]) - phase) // up
        size = 1 << (len(x) + len(part) - 2).bit_length()
        full = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(part, size), size)
        at = (places[mine] - phase) // up - first - low
        inside = (at >= 0) & (at < len(x) + len(part) - 1)
        out[mine[inside]] = full[at[inside]]
    return out


def resampled(parts: DataFrame, up: int, down: int, size: int, out: int | None = None, slope: float = 0.02) -> DataFrame:
    """(track, block, start, x): the blocks (track, block, start, x) of `size` samples at up / down times their rate, in blocks of `out`.

    There are ceil(n up / down) samples for n, the first at the place of the first; before the first
    and after the last the signal counts as 0. A task holds a block of the outcome and what its
    samples and taps reach: about size * down / up + taps / up.
    """
    out = size if out is None else out
    if min(up, down, size, out) < 1:
        raise ValueError("rates and sizes are positive")
    up, down = up // math.gcd(up, down), down // math.gcd(up, down)
    taps = low_pass(up, down, slope)
    reach = len(taps) // 2
    total = lengths(parts).select("track", F.ceil(F.col("n") * up / down).cast("long").alias("m"))
    wanted = total.where("m > 0").select("track", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / out).cast("long"))).alias("to"))
    wanted = wanted.withColumns({"begin": F.col("to") * out, "end": F.least(F.col("m"), (F.col("to") + 1) * out)})
    wanted = wanted.withColumns({"lo": F.floor((F.col("begin") * down - reach) / up).cast("long"), "hi": F.ceil(((F.col("end") - 1) * down + reach) / up).cast("long") + 1})
    kind = parts.schema["track"].dataType.simpleString()

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        track, to, begin, end = key
        first, x = stretch(rows, "in")
        return frame({"track": [track], "block": [to], "start": [begin], "x": [converted(x, first, int(begin), int(end), up, down, taps)]})

    keys = ["track", "to", "begin", "end"]
    return asked(wanted, parts, "in", size, "lo", "hi", keys).groupBy(*keys).applyInPandas(one, f"track {kind}, block long, start long, x array<double>")


def envelope(parts: DataFrame, size: int, hop: int) -> DataFrame:
    """(track, frame, e): mean square of `size` samples from frame * hop on, whole frames only, straight from blocks.

    A block gives each frame that it touches one sum; those of the few blocks of a frame are added.
    """
    kind = parts.schema["track"].dataType.simpleString()

    def sums(batches):
        for batch in batches:
            for track, start, x in zip(batch.track, batch.start, batch.x, strict=True):
                upto = np.concatenate([[0.0], np.cumsum(np.asarray(x, float) ** 2)])
                frames = np.arange(max(0, -(-(start - size + 1) // hop)), (start + len(x) - 1) // hop + 1)
                a, b = np.clip(frames * hop - start, 0, len(x)), np.clip(frames * hop + size - start, 0, len(x))
                yield pd.DataFrame({"track": pd.Series([track] * len(frames), dtype=object), "frame": frames, "s": upto[b] - upto[a], "m": b - a})

    rows = parts.select("track", "start", "x").mapInPandas(sums, f"track {kind}, frame long, s double, m long")
    rows = rows.groupBy("track", "frame").agg(F.sum("s").alias("s"), F.sum("m").alias("m")).where(F.col("m") == size)
    return rows.select("track", "frame", (F.col("s") / size).alias("e"))

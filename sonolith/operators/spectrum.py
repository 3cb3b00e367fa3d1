"""Frames, spectra and mergeable cross-spectra.

A frame is a row (track, t, a, b) with two arrays of equal length: the reference and the test.
Spectra are computed in Arrow batches; sums over frames leave a task as one row a bin, so what
is shuffled does not grow with the number of frames.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame_signal(series: DataFrame, size: int, hop: int, *, key: str = "track", pos: str = "pos", value: str = "x") -> DataFrame:
    """(key, t, frame): frame t holds `size` samples from position t * hop on; short tails go.

    Each sample is sent to the frames that hold it, so a track may be of any length.
    """
    last = F.floor(F.col(pos) / hop).cast("long")
    first = F.greatest(F.lit(0), F.ceil((F.col(pos) - size + 1) / hop)).cast("long")
    rows = series.where(F.col(pos) >= 0).select(key, pos, value, F.explode(F.sequence(first, last)).alias("t"))
    frames = rows.groupBy(key, "t").agg(F.sort_array(F.collect_list(F.struct(pos, value))).alias("xs"))
    return frames.where(F.size("xs") == size).select(key, "t", F.transform("xs", lambda s: s[value]).alias("frame"))


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(rows, -1)


def spectra(frames: DataFrame, *, window: np.ndarray | None = None) -> DataFrame:
    """Adds are, aim, bre, bim: one-sided spectra of `a` and `b`. Frames have equal lengths."""
    kept = [f for f in frames.columns if f not in ("a", "b")]
    schema = ", ".join([f"`{f}` {frames.schema[f].dataType.simpleString()}" for f in kept] + [f"{f} array<double>" for f in ("are", "aim", "bre", "bim")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for c in ("a", "b"):
                x = _matrix(batch[c], batch.num_rows)
                z = np.fft.rfft(x if window is None else x * window, axis=1)
                out += [z.real, z.imag]
            arrays = [pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(z).ravel()), z.shape[1]).cast(pa.list_(pa.float64())) for z in out]
            yield pa.RecordBatch.from_arrays([*(batch[f] for f in kept), *arrays], [*kept, "are", "aim", "bre", "bim"])

    return frames.mapInArrow(run, schema)


def bins(frames: DataFrame, keys: list[str]) -> DataFrame:
    """One row a frame and bin: keys, bin, are, aim, bre, bim."""
    return frames.select(*keys, F.posexplode(F.arrays_zip("are", "aim", "bre", "bim")).alias("bin", "z")).select(*keys, F.col("bin").cast("long").alias("bin"), "z.*")


def cross_spectrum(frames: DataFrame, key: str = "track") -> DataFrame:
    """(key, bin, saa, sbb, sab_re, sab_im, frames), summed over the frames of `spectra`."""
    kind = frames.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            ar, ai, br, bi = (_matrix(batch[c], batch.num_rows) for c in ("are", "aim", "bre", "bim"))
            whole = np.stack([ar * ar + ai * ai, br * br + bi * bi, ar * br + ai * bi, ar * bi - ai * br, np.ones_like(ar)], axis=2)
            owner = np.array(batch[key].to_pylist(), dtype=object)
            for k in dict.fromkeys(owner.tolist()):
                part = whole[owner == k].sum(0)
                sums[k] = sums[k] + part if k in sums else part
        for k, s in sums.items():
            n = len(s)
            yield pa.RecordBatch.from_arrays([pa.array([k] * n, batch.schema.field(key).type), pa.array(np.arange(n)), *(pa.array(s[:, j]) for j in range(4)), pa.array(s[:, 4].astype(np.int64))], [key, "bin", "saa", "sbb", "sab_re", "sab_im", "frames"])

    partial = frames.select(key, "are", "aim", "bre", "bim").mapInArrow(run, f"{key} {kind}, bin long, saa double, sbb double, sab_re double, sab_im double, frames long")
    return merge(partial, key)


def merge(partial: DataFrame, key: str = "track") -> DataFrame:
    """Sum of cross-spectra of separate runs of frames."""
    return partial.groupBy(key, "bin").agg(*(F.sum(c).alias(c) for c in ("saa", "sbb", "sab_re", "sab_im", "frames")))


def gain(cross: DataFrame, key: str = "track", lo: int = 0, hi: int | None = None) -> DataFrame:
    """(key, gain): signed least-squares gain over bins lo .. hi - 1; 0 without power."""
    inside = F.col("bin") >= lo if hi is None else (F.col("bin") >= lo) & (F.col("bin") < hi)
    saa = F.sum("saa")
    return cross.where(inside).groupBy(key).agg(F.when(saa > 0, F.sum("sab_re") / saa).otherwise(0.0).alias("gain"))


def band_stats(cross: DataFrame, bands: DataFrame, gains: DataFrame, key: str = "track") -> DataFrame:
    """Coherent and incoherent power of each band (band, lo, hi): the bins lo .. hi - 1.

    A band of fewer than two frames has no estimate of its incoherent power: NULL.
    """
    inside = (F.col("bin") >= F.col("lo")) & (F.col("bin") < F.col("hi"))
    coherent = F.when(F.col("saa") > 0, (F.col("sab_re") ** 2 + F.col("sab_im") ** 2) / F.col("saa")).otherwise(0.0)
    rows = cross.join(F.broadcast(bands), inside).join(gains, key)
    per = rows.withColumn("raw", F.greatest(F.col("sbb") - coherent, F.lit(0.0))).groupBy(key, "band").agg(
        F.max("frames").alias("k"), F.sum("raw").alias("raw"), F.sum("sbb").alias("total"), F.sum("saa").alias("saa"), F.sum("sab_re").alias("sab_re"), F.first("gain").alias("g"),
    )
    k = F.col("k").cast("double")
    per = per.withColumn("incoherent", F.when(k >= 2, F.col("raw") * k / F.when(k >= 2, k - 1)))
    residual = F.greatest(F.lit(0.0), F.col("total") - 2 * F.col("g") * F.col("sab_re") + F.col("g") * F.col("g") * F.col("saa"))
    per = per.withColumn("residual", residual).withColumn("coherent", F.greatest(F.lit(0.0), F.col("total") - F.col("incoherent")))
    return per.withColumn("linear", F.greatest(F.lit(0.0), F.col("residual") - F.col("incoherent"))).drop("raw", "saa", "sab_re")


def phase_shift(re: Column, im: Column, k: Column, delay: float, size: int) -> tuple[Column, Column]:
    """A spectrum's value at bin k after a delay in samples."""
    angle = 2 * np.pi * k / size * delay
    return re * F.cos(angle) + im * F.sin(angle), im * F.cos(angle) - re * F.sin(angle)


def box_smooth(value: str, by: list[str], order: str, half: int) -> Column:
    """Mean over 2 * half + 1 neighbours, NULL at cropped edges."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)
    return F.when(F.count(value).over(w) == 2 * half + 1, F.avg(value).over(w))

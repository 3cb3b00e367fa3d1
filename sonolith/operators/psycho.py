"""Auditory bands, masking and noise-to-mask ratios.

A frame stays one row: bands, spreading, peaks and cutoffs are matrix steps over the spectra of
an Arrow batch, and what leaves a task is a number or a short array for each frame. Sums over
frames combine before they are shuffled by track and band.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import ERB_NUMBER, ERB_SLOPE, bark, db10, erb_to_hz, spreading_db, threshold_in_quiet
from .spectrum import _matrix

#: Offsets of the masking model and the level of a full-scale sine; fixed values.
TONAL_OFFSET_DB, NOISE_OFFSET_DB, FULL_SCALE_SPL_DB = 14.5, 5.5, 96.0
#: A peak stands this far above its third and fourth neighbours: 7 dB as a power ratio.
PEAK_RATIO = 5.011872336272722


def erb_bands(spark: SparkSession, rate: int, size: int, lo_hz: float = 20.0, hi_hz: float = 20_000.0) -> DataFrame:
    """(band, lo, hi, centre_hz, ath): bins lo .. hi - 1, one ERB wide; empty bands are left out.

    ath: the lowest threshold in quiet of the band's bins, as a power of a full-scale sine.
    """
    hi_hz, width = min(hi_hz, rate / 2), rate / size
    first, last = (ERB_NUMBER * math.log10(ERB_SLOPE * hz / 1000 + 1) for hz in (lo_hz, hi_hz))
    edges = spark.range(int(math.floor(last - first + 1e-9)) + 1).select(F.col("id").alias("band"), erb_to_hz(F.col("id") + F.lit(first)).alias("from_hz"))
    upper = F.coalesce(F.lead("from_hz").over(Window.orderBy("band")), F.lit(hi_hz))  # some forty rows
    number = lambda hz: F.least(F.greatest(F.bround(hz / width), F.lit(0.0)), F.lit(float(size // 2 + 1))).cast("long")
    bands = edges.select("band", number(F.col("from_hz")).alias("lo"), number(upper).alias("hi")).where("hi > lo")
    quiet = F.array_min(F.transform(F.sequence("lo", F.col("hi") - 1), lambda k: threshold_in_quiet(k * width)))
    return bands.withColumn("centre_hz", (F.col("lo") + F.col("hi") - 1) / 2.0 * width).withColumn("ath", F.pow(F.lit(10.0), (quiet - FULL_SCALE_SPL_DB) / 10))


@dataclass(frozen=True)
class BandTable:
    """Some forty bands: numbers, which bins are theirs (bins x bands), spreading weights, offsets of tones, thresholds in quiet."""

    band: np.ndarray
    member: np.ndarray
    spread: np.ndarray
    tonal_offset: np.ndarray
    ath: np.ndarray


def band_table(bands: DataFrame, n_bins: int) -> BandTable:
    """What tasks need of `erb_bands`; its size follows from the frame's, not from the data."""
    one = bands.select("band", "lo", "hi", "ath", bark(F.col("centre_hz")).alias("z"))
    rows = one.orderBy("band").collect()
    two = one.select(F.col("band").alias("bi"), F.col("z").alias("zi")).join(F.broadcast(one.select(F.col("band").alias("bj"), F.col("z").alias("zj"))), F.lit(True))
    weight = two.select(F.pow(F.lit(10.0), spreading_db(F.col("zi") - F.col("zj")) / 10).alias("w"), "bi", "bj").orderBy("bi", "bj").collect()
    spread = np.array([r.w for r in weight]).reshape(len(rows), len(rows))
    member = np.zeros((n_bins, len(rows)))
    for k, r in enumerate(rows):
        member[r.lo : r.hi, k] = 1.0
    z = np.array([r.z for r in rows])
    return BandTable(np.array([r.band for r in rows]), member, spread / spread.sum(1, keepdims=True), TONAL_OFFSET_DB + z, np.array([r.ath for r in rows]))


def per_frame(frames: DataFrame, made: Callable[..., dict[str, np.ndarray]], **types: str) -> DataFrame:
    """The columns of `frames` besides the spectra, and those that `made` gives for the matrices are, aim, bre, bim."""
    kept = [c for c in frames.columns if c not in ("are", "aim", "bre", "bim")]
    schema = ", ".join([f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in kept] + [f"{c} {kind}" for c, kind in types.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out = made(*(_matrix(batch[c], batch.num_rows) for c in ("are", "aim", "bre", "bim")))
            columns = []
            for name, kind in types.items():
                x = out[name]
                if x.ndim == 2:
                    columns.append(pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(x).ravel()), x.shape[1]).cast(pa.list_(pa.float64())))
                else:
                    columns.append(pa.array(x, {"double": pa.float64(), "long": pa.int64()}[kind]))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), *columns], [*kept, *types])

    return frames.mapInArrow(run, schema)


def _power(re: np.ndarray, im: np.ndarray) -> np.ndarray:
    return np.maximum(re * re + im * im, 1e-30)


def _peaks(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Local maxima well above their third and fourth neighbours, and what is within two bins of one."""
    peak = np.zeros(p.shape, bool)
    if p.shape[1] > 8:
        at = lambda k: p[:, 4 + k : p.shape[1] - 4 + k]
        far = np.maximum(np.maximum(at(-3), at(3)), np.maximum(at(-4), at(4)))
        peak[:, 4:-4] = (at(0) > at(-1)) & (at(0) >= at(1)) & (at(0) > PEAK_RATIO * far)
    near = peak.copy()
    for k in (1, 2):
        near[:, k:] |= peak[:, :-k]
        near[:, :-k] |= peak[:, k:]
    return peak, near


def _thresholds(p: np.ndarray, b: BandTable) -> np.ndarray:
    """Band energies are spread over neighbouring bands and lowered by an offset between that of
    noise and that of tones, by the share of energy in tonal peaks; not below the threshold in quiet."""
    energy = p @ b.member
    tonal = (p * _peaks(p)[1]) @ b.member / energy
    offset = tonal * b.tonal_offset + (1 - tonal) * NOISE_OFFSET_DB
    return np.maximum(energy @ b.spread.T * 10 ** (-offset / 10), b.ath)


def by_band(frames: DataFrame, bands: BandTable, value: str, name: str) -> DataFrame:
    """(track, t, band, name): a row for each band of a frame; empty bands have none."""
    numbers = F.array(*(F.lit(int(k)) for k in bands.band))
    rows = frames.select("track", "t", F.posexplode(value).alias("k", name))
    return rows.select("track", "t", F.get(numbers, F.col("k")).cast("long").alias("band"), name)


def band_energies(frames: DataFrame, bands: BandTable) -> DataFrame:
    """(track, t, band, e): the reference's power in each band."""
    made = per_frame(frames, lambda ar, ai, br, bi: {"v": (ar * ar + ai * ai) @ bands.member}, v="array<double>")
    return by_band(made, bands, "v", "e")


def thresholds(frames: DataFrame, bands: BandTable) -> DataFrame:
    """(track, t, band, thr): masking thresholds of the reference."""
    made = per_frame(frames, lambda ar, ai, br, bi: {"v": _thresholds(_power(ar, ai), bands)}, v="array<double>")
    return by_band(made, bands, "v", "thr")


def noise_to_mask(frames: DataFrame, bands: BandTable, gain: float) -> DataFrame:
    """(track, t, ratio): in each band, the power of test minus gain times reference over the threshold."""

    def made(ar: np.ndarray, ai: np.ndarray, br: np.ndarray, bi: np.ndarray) -> dict[str, np.ndarray]:
        noise = ((br - gain * ar) ** 2 + (bi - gain * ai) ** 2) @ bands.member
        return {"ratio": np.maximum(noise, 1e-30) / _thresholds(_power(ar, ai), bands)}

    return per_frame(frames, made, ratio="array<double>")


def nmr_frames(ratios: DataFrame) -> DataFrame:
    """(track, t, total_db, peak_db) of `noise_to_mask`."""
    mean = F.aggregate("ratio", F.lit(0.0), lambda a, x: a + x) / F.size("ratio")
    return ratios.select("track", "t", (10 * F.log10(mean)).alias("total_db"), (10 * F.log10(F.array_max("ratio"))).alias("peak_db"))


def histogram_quantiles(rows: DataFrame, value: str, keys: list[str], qs: list[float], lo: float = -100.0, step: float = 0.5, n_bins: int = 320) -> DataFrame:
    """Quantiles as centres of the first bin that reaches the share; also count, maximum, share above 0.

    Mergeable: only bin counts are shuffled, however many rows there are.
    """
    b = F.least(F.lit(n_bins - 1), F.greatest(F.lit(0), F.floor((F.col(value) - lo) / step))).cast("long")
    counted = rows.groupBy(*keys, b.alias("b")).agg(F.count("*").alias("c"), F.max(value).alias("m"), F.count_if(F.col(value) > 0).alias("pos"))
    w = Window.partitionBy(*keys)
    counted = counted.withColumn("upto", F.sum("c").over(w.orderBy("b"))).withColumn("n", F.sum("c").over(w))
    first = lambda q: (F.min(F.when(F.col("upto") >= q * F.col("n"), F.col("b"))) * step + lo + step / 2).alias(f"q{round(100 * q)}")
    return counted.groupBy(*keys).agg(F.max("n").alias("frames"), *map(first, qs), F.max("m").alias("largest"), (F.sum("pos") / F.max("n")).alias("above_zero"))


def time_grid(ratios: DataFrame, bands: BandTable, per: int) -> DataFrame:
    """(track, band, col, worst_db): the largest ratio of each `per` frames."""
    rows = by_band(ratios, bands, "ratio", "r")
    return rows.groupBy("track", "band", F.floor(F.col("t") / per).cast("long").alias("col")).agg(db10(F.max("r"), 1e-300).alias("worst_db"))


def frame_cutoffs(frames: DataFrame, *, below_db: float, half: int = 2) -> DataFrame:
    """(track, t, cutoff): the highest smoothed bin within `below_db` of the frame's top, else 0."""

    def made(ar: np.ndarray, ai: np.ndarray, br: np.ndarray, bi: np.ndarray) -> dict[str, np.ndarray]:
        level = 10 * np.log10(_power(ar, ai))
        smooth = np.lib.stride_tricks.sliding_window_view(level, 2 * half + 1, axis=1).mean(2)
        loud = smooth > smooth.max(1, keepdims=True) - below_db
        last = smooth.shape[1] - 1 - loud[:, ::-1].argmax(1) + half
        return {"cutoff": np.where(loud.any(1), last, 0).astype(float)}

    return per_frame(frames, made, cutoff="double")


def tonal_peaks(frames: DataFrame) -> DataFrame:
    """(track, t, peaks, share): how many tonal peaks a frame has, and the share of its power near them."""

    def made(ar: np.ndarray, ai: np.ndarray, br: np.ndarray, bi: np.ndarray) -> dict[str, np.ndarray]:
        p = _power(ar, ai)
        peak, near = _peaks(p)
        return {"peaks": peak.sum(1), "share": (p * near).sum(1) / p.sum(1)}

    return per_frame(frames, made, peaks="long", share="double")


def phat_peaks(frames: DataFrame, size: int) -> DataFrame:
    """(track, t, lag, value): the largest whitened cross-correlation in magnitude; the first lag wins ties."""

    def made(ar: np.ndarray, ai: np.ndarray, br: np.ndarray, bi: np.ndarray) -> dict[str, np.ndarray]:
        cross = (ar * br + ai * bi) + 1j * (ar * bi - ai * br)
        size_of = np.abs(cross)
        white = np.where(size_of > 1e-12, cross / np.where(size_of > 1e-12, size_of, 1.0), 0.0)
        values = np.roll(np.fft.irfft(white, size, axis=1), size // 2, axis=1)
        values = np.floor(values * 1e9 + 0.5) / 1e9
        best = np.abs(values).argmax(1)
        return {"lag": best - size // 2, "value": values[np.arange(len(best)), best]}

    return per_frame(frames, made, lag="long", value="double")


def flatness(frames: DataFrame) -> DataFrame:
    """(track, t, sfm): spectral flatness in dB, the geometric over the arithmetic mean of the powers."""

    def made(ar: np.ndarray, ai: np.ndarray, br: np.ndarray, bi: np.ndarray) -> dict[str, np.ndarray]:
        p = _power(ar, ai)
        return {"sfm": 10 * np.log10(np.exp(np.log(p).mean(1)) / p.mean(1))}

    return per_frame(frames, made, sfm="double")

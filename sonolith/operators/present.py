"""Results as text, choices among them, and the constraints on an encoder's settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import medians

DASH = "–"
#: Rates of the standard quality ladder in kbps; fixed values.
LADDER_KBPS = (96, 128, 160, 192, 256)
#: Codecs that a job may name: key, rates in kbps, range of the quality and how one is written; lossless ones have neither. Fixed values.
CODECS = [
    ("opus", [32, 48, 64, 80, 96, 112, 128, 160, 192, 256], None, None, None),
    ("aac", [96, 128, 160, 192, 256, 320], None, None, None),
    ("aac_mf", [96, 128, 160, 192], None, None, None),
    ("fdk_aac", [96, 128, 160, 192, 256], None, None, None),
    ("mp3", [96, 128, 160, 192, 224, 256, 320], 0, 9, "V"),
    ("vorbis", [96, 128, 160, 192, 256, 320], -1, 10, "q"),
    ("ac3", [192, 256, 320, 384, 448, 640], None, None, None),
    ("eac3", [96, 128, 192, 256, 384, 640], None, None, None),
    ("mp2", [128, 160, 192, 224, 256, 320, 384], None, None, None),
    ("wma", [64, 96, 128, 160, 192], None, None, None),
    ("flac", [], None, None, None),
    ("alac", [], None, None, None),
    ("wavpack", [], None, None, None),
]
_CODEC_SCHEMA = "codec string, rates array<int>, low int, high int, mark string"


def codecs(spark) -> DataFrame:
    """The codec dimension: codec, modes, rates, low, high, mark."""
    modes = F.when(F.size("rates") == 0, F.array(F.lit("lossless"))).otherwise(F.array_compact(F.array(F.lit("bitrate"), F.when(F.col("mark").isNotNull(), "quality"))))
    return spark.createDataFrame(CODECS, _CODEC_SCHEMA).withColumn("modes", modes)


def db_text(value: Column, digits: int = 1, unit: str = " dB") -> Column:
    """A level as text: a dash where it is unknown, a bound where it is infinite."""
    return (
        F.when(value.isNull() | F.isnan(value), DASH).when(value == float("inf"), "> 150" + unit).when(value == float("-inf"), "< -150" + unit)
        .otherwise(F.concat(F.format_string(f"%.{digits}f", value), F.lit(unit)))
    )


def frequency_text(hz: Column) -> Column:
    """Hz below 1 kHz, else kHz with at most one decimal."""
    khz = F.regexp_replace(F.format_string("%.1f", hz / 1000), r"\.?0*$", "")
    whole = F.when(hz / 1000 >= 9.95, F.regexp_replace(F.format_string("%.1f", hz / 1000), r"\.0$", "")).otherwise(khz)
    return F.when(hz < 1000, F.concat(F.format_string("%.0f", hz), F.lit(" Hz"))).otherwise(F.concat(whole, F.lit(" kHz")))


def band_label(lo_hz: Column, hi_hz: Column) -> Column:
    """Both ends of a band, with one unit where both are in kHz."""
    lo, hi = frequency_text(lo_hz), frequency_text(hi_hz)
    short = F.when(lo.endswith(" kHz") & hi.endswith(" kHz"), F.regexp_replace(lo, " kHz$", "")).otherwise(lo)
    return F.concat(short, F.lit(DASH), hi)


def delay_text(samples: Column, rate: Column) -> Column:
    """Which of two signals is later, by how much; half a sample is no direction."""
    size = F.abs(samples)
    said = F.when(samples >= 0, "later").otherwise("earlier")
    return F.when(samples.isNull(), DASH).when(size < 0.5, F.format_string("in sync (%.2f samples)", size)).otherwise(F.format_string("%.3f ms %s (%.1f samples)", size / rate * 1000, said, size))


def visible(bucket: Column, choice: Column) -> Column:
    """Whether a scan's bucket is among those of a choice."""
    shown = {"suspicious": "consistent_lossy", "undetermined": "undetermined", "errors": "error", "lossless": "consistent_lossless"}
    out = F.when(choice == "all", True)
    for name, want in shown.items():
        out = out.when(choice == name, bucket == want)
    return out


def suspicious(bucket: Column) -> Column:
    return bucket == "consistent_lossy"


def entry_headline(error: Column, reasons: Column, counter: Column, notes: Column) -> Column:
    """The first of an error, the reasons, the counter-evidence and the notes that there is."""
    return F.coalesce(F.nullif(error, F.lit("")), *(F.get(x, F.lit(0)) for x in (reasons, counter, notes)), F.lit(""))


def settings_error(mode: Column, kbps: Column, quality: Column, modes: Column, low: Column, high: Column) -> Column:
    """What is wrong with an encoder's settings, NULL if nothing."""
    inside = F.coalesce((quality >= low) & (quality <= high), F.lit(False))
    return F.when(~F.array_contains(modes, mode), "mode").when((mode == "bitrate") & kbps.isNull(), "bitrate").when((mode == "quality") & ~inside, "quality")


def settings_label(codec: Column, mode: Column, kbps: Column, quality: Column, mark: Column) -> Column:
    """A short name for a file: opus128k, mp3V2, flac."""
    return F.concat(codec, F.when(mode == "bitrate", F.concat(kbps.cast("string"), F.lit("k"))).when(mode == "quality", F.concat(mark, quality.cast("string"))).otherwise(F.lit("")))


def ladder_rates(rates: Column, most: int = 5) -> Column:
    """The codec's rates on the standard ladder if three are, else up to `most` of its own, evenly spread."""
    common = F.array_intersect(F.array(*(F.lit(k) for k in LADDER_KBPS)), rates)
    size = F.size(rates)
    spread = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(rates, F.bround(i * (size - 1) / (most - 1)).cast("int") + 1))
    return F.when(F.size(common) >= 3, common).when(size <= most, rates).otherwise(spread)


def overlap_span(intercept: Column, slope: Column, ref_length: Column, test_length: Column) -> tuple[Column, Column]:
    """(first, last) sample of the test that the reference covers, with 2 % kept off at either end."""
    lo, hi = F.greatest(F.lit(0.0), intercept), F.least(test_length.cast("double"), (ref_length + intercept) / (1 - slope))
    pad = 0.02 * (hi - lo)
    return (lo + pad).cast("long"), (hi - pad).cast("long")


def random_start(ref_s: Column, test_s: Column, delay_s: Column, length_s: float, draw: Column, edge_s: float = 0.5) -> Column:
    """A start within what both signals have, at the share `draw` (0 to 1) of the room; NULL if the length does not fit."""
    lo = F.greatest(F.lit(0.0), -delay_s) + edge_s
    hi = F.least(ref_s, test_s - delay_s) - edge_s - length_s
    return F.when(hi >= lo, lo + draw * (hi - lo))


def rejudge_rate(rate: Column, frames: Column, cutoff_hz: Column, source_rate: Column, widest: int = 48_000, share: float = 0.97, least_frames: int = 40) -> Column:
    """The standard rate at which a file of a higher rate is judged again, NULL if it is not."""
    return F.when((frames >= least_frames) & (rate > widest), F.coalesce(source_rate, F.when(cutoff_hz < share * widest / 2, F.lit(widest))))


def calibration(rows: DataFrame, label: str, value: str, decided: Column) -> DataFrame:
    """(label, least, median, most, rows, decided): how a measure falls out in each class."""
    counts = rows.groupBy(label).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.count("*").alias("rows"), F.count_if(decided).alias("decided"))
    middle = medians(rows, [label], value).withColumnRenamed(label, "_label")
    return counts.join(middle, F.col(label).eqNullSafe(F.col("_label")), "left").select(label, "least", "median", "most", "rows", "decided")

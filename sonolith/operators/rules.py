"""Ordered decision rules as conditional expressions, and small renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vendors that rewrite the encoder's own string, and pairs for which seeking is sample-exact; fixed values.
TAGGERS = ("mutagen", "taglib", "jaudiotagger")
SEEK_EXACT = (("wav", "pcm_s16le"), ("wav", "pcm_s24le"), ("wav", "pcm_s32le"), ("wav", "pcm_f32le"), ("wav", "pcm_u8"), ("flac", "flac"), ("ogg", "opus"), ("mp3", "mp3"))
#: Channel layouts that one encoder takes under another name, or not at all; fixed values.
RELABELLED, REJECTED = {"5.1(side)": "5.1", "5.0(side)": "5.0", "quad(side)": "quad"}, ("7.1(wide)", "6.1(back)")
LAYOUTS = {"mono": 1, "stereo": 2, "2.1": 3, "3.0": 3, "quad": 4, "4.0": 4, "5.0": 5, "5.1": 6, "6.1": 7, "7.1": 8}


def encoder_family(vendor: Column) -> Column:
    """Who encoded: NULL where it is unknown, which a tagging library makes it."""
    low = F.lower(vendor)
    tagged = F.lit(False)
    for t in TAGGERS:
        tagged = tagged | low.startswith(t)
    return F.when((vendor == "") | tagged, None).when(low.startswith("reference libflac"), "reference libFLAC").when(low.startswith("lavf") | low.startswith("libavcodec"), "ffmpeg").otherwise(vendor)


def container_notes(vendor: Column, has_md5: Column, max_block: Column, ratio: Column) -> Column:
    """What a container tells; it never changes a verdict."""
    family = encoder_family(vendor)
    rewritten = (vendor != "") & family.isNull()
    notes = [F.when(rewritten, "vendor_rewritten").when(family.isNotNull(), F.concat(F.lit("encoder "), family)), F.when(~has_md5, "no_md5"), F.when((max_block > 0) & (max_block < 256), "blocksize").when(ratio.isNotNull(), F.format_string("ratio %.2f", ratio))]
    return F.array_compact(F.array(*notes))


def seek_exact(container: Column, codec: Column) -> Column:
    """Whether one of the container's names and the codec are a known pair."""
    names = F.transform(F.split(container, ","), lambda n: F.concat_ws("/", F.trim(n), codec))
    return F.arrays_overlap(names, F.array(*(F.lit(f"{a}/{b}") for a, b in SEEK_EXACT)))


def encoder_limits(help_text: Column) -> tuple[Column, Column]:
    """(allowed rates, most channels) from an encoder's help; NULL where it states none."""
    line = lambda key: F.nullif(F.regexp_extract(help_text, rf"(?m)^\s*{key}:(.*)$", 1), F.lit(""))
    rates = F.transform(F.filter(F.split(F.trim(line("Supported sample rates")), r"\s+"), lambda v: v.rlike(r"^\d+$")), lambda v: v.cast("long"))
    known = F.create_map(*(F.lit(x) for kv in LAYOUTS.items() for x in kv))
    names = F.split(F.trim(line("Supported channel layouts")), r"\s+")
    counts = F.transform(names, lambda v: F.coalesce(F.nullif(F.regexp_extract(v, r"^(\d+) ?channels?$", 1), F.lit("")).cast("int"), F.try_element_at(known, v)))
    return F.when(F.size(rates) > 0, rates), F.array_max(counts).cast("long")


def prepared_job(codec: Column, layout: Column, channels: Column, rate: Column, kbps: Column, rates: Column, most: Column) -> Column:
    """struct(error, target_rate, relabel): what an encoder's limits make of a job."""
    opus = codec == "libopus"
    error = F.when(channels > most, "too_many_channels").when(opus & layout.isin(*REJECTED), "layout")
    relabel = F.when(opus, F.try_element_at(F.create_map(*(F.lit(x) for kv in RELABELLED.items() for x in kv)), layout))
    allowed = F.when((codec == "libvorbis") & kbps.isNotNull() & (rate > 48_000), F.array(F.lit(48_000).cast("long"))).otherwise(rates)
    target = F.coalesce(F.array_min(F.filter(allowed, lambda r: r >= rate)), F.array_max(allowed))
    fits = allowed.isNull() | F.array_contains(allowed, rate)
    return F.struct(error.alias("error"), F.when(error.isNull() & ~fits, target).alias("target_rate"), F.when(error.isNull(), relabel).alias("relabel"))


def alignment_verdict(speed_label: Column, ppm: Column, periodic: Column, rho: Column, reliable: Column, silent: Column, partial_rho: Column, overlap: Column, same_channels: Column, points: Column, master_rho: Column) -> Column:
    """The first gate that a pair fails, in their fixed order, else aligned."""
    return (
        F.when(speed_label.isNotNull() | (F.abs(ppm) > 1000), "speed_mismatch").when(periodic, "unaligned")
        .when((rho < 0.70) & ~reliable, F.when(silent | (partial_rho >= 0.70), "unaligned").otherwise("different_recording"))
        .when(overlap < 4096, "unaligned").when(~same_channels, "channel_mismatch").when(points == 0, "unaligned").when(master_rho < 0.60, "different_master").otherwise("aligned")
    )


def headline(status: Column, verdict: Column, snr: Column, excluded_s: Column) -> Column:
    """struct(title, tone) of a result."""
    measured = status == "measured"
    title = F.when(measured & snr.isNull(), "identical to the floor").when(measured, F.format_string("%.1f dB", snr)).otherwise(verdict)
    tone = F.when(~measured, "bad").when((excluded_s > 0) | (verdict == "different_master"), "warn").when(snr.isNull(), "good").otherwise("neutral")
    return F.struct(title.alias("title"), tone.alias("tone"))


def lobe_ratio(rows: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """(key, ratio): the largest magnitude outside the peak's lobe over the peak, circularly.

    The lobe goes from the peak to where magnitudes first rise again on each side.
    """
    top = rows.groupBy(key).agg(F.max(F.struct(F.col(value).alias("m"), (-F.col(at)).alias("k"))).alias("p"), F.count("*").alias("n"))
    around = rows.join(top, key).withColumn("d", F.pmod(F.col(at) + F.col("p.k") + F.floor(F.col("n") / 2), F.col("n")) - F.floor(F.col("n") / 2))
    right, left = Window.partitionBy(key).orderBy("d"), Window.partitionBy(key).orderBy(F.desc("d"))
    around = around.withColumn("up_r", (F.col("d") > 0) & (F.col(value) > F.lag(value).over(right))).withColumn("up_l", (F.col("d") < 0) & (F.col(value) > F.lag(value).over(left)))
    around = around.withColumn("out", F.max(F.col("up_r").cast("int")).over(right.rowsBetween(Window.unboundedPreceding, 0)) + F.max(F.col("up_l").cast("int")).over(left.rowsBetween(Window.unboundedPreceding, 0)))
    rest = F.max(F.when(F.col("out") > 0, F.col(value)))
    return around.groupBy(key).agg(F.when(F.max("p.m") > 0, F.coalesce(rest, F.lit(0.0)) / F.max("p.m")).otherwise(0.0).alias("ratio"))


def crossfade(a: Column, b: Column, pos: Column, switch_at: int, fade: int) -> Column:
    """Sample at `pos` of a render that goes from a to b over `fade` samples."""
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (pos - switch_at + 1) / fade))
    return a * (1 - share) + b * share


def window_length(rate: Column, window_s: float, ppm: Column) -> Column:
    """Samples of a window, shortened under drift so that it smears by 0.1 sample at most, 4096 at least."""
    full = F.floor(rate * window_s)
    return F.greatest(F.lit(4096), F.when(F.abs(ppm) > 0, F.least(full, F.floor(F.lit(0.1) / (F.abs(ppm) * 1e-6)))).otherwise(full)).cast("long")

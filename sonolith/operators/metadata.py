"""What a file's metadata says: probe documents, the default track, bit rates, ratios and blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A probe's document; numbers are read as text, since tools write them both ways.
PROBE = (
    "streams array<struct<index:string,codec_type:string,codec_name:string,profile:string,sample_rate:string,channels:string,channel_layout:string,sample_fmt:string,"
    "bits_per_raw_sample:string,bits_per_sample:string,bit_rate:string,duration:string,disposition:map<string,int>,tags:map<string,string>>>,"
    "format struct<format_name:string,size:string,duration:string,bit_rate:string,tags:map<string,string>>"
)
#: Seconds of packets that are sampled from the middle of a track.
SAMPLE_S = 30.0


def as_int(text: Column) -> Column:
    """A whole number, NULL for anything else."""
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(text).try_cast("long"))


def as_float(text: Column) -> Column:
    """A number, NULL for anything else and for what is not one."""
    number = F.trim(text).try_cast("double")
    return F.when(~F.isnan(number), number)


def probe(text: Column) -> Column:
    """struct(container, size, duration, bit_rate, has_video, has_picture, audio, error) of a probe's JSON.

    audio: array of struct(audio_index, index, codec, sample_rate, channels, bits, bit_rate,
    duration, language, is_default). An embedded picture is no video. Tracks without a rate or
    channels go, but still take an ordinal. A file without any track left has an error.
    """

    def read(document: Column) -> Column:
        kind = lambda name: F.filter(F.coalesce(document["streams"], F.array()), lambda s: s["codec_type"] == name)
        is_set = lambda s, flag: F.coalesce(F.try_element_at(s["disposition"], F.lit(flag)), F.lit(0)) != 0
        track = lambda s, i: F.struct(
            i.cast("long").alias("audio_index"), F.coalesce(as_int(s["index"]), F.lit(0)).alias("index"), s["codec_name"].alias("codec"),
            F.coalesce(as_int(s["sample_rate"]), F.lit(0)).alias("sample_rate"), F.coalesce(as_int(s["channels"]), F.lit(0)).alias("channels"),
            F.coalesce(F.nullif(as_int(s["bits_per_raw_sample"]), F.lit(0)), F.nullif(as_int(s["bits_per_sample"]), F.lit(0))).alias("bits"),
            as_int(s["bit_rate"]).alias("bit_rate"), as_float(s["duration"]).alias("duration"), F.try_element_at(s["tags"], F.lit("language")).alias("language"), is_set(s, "default").alias("is_default"),
        )
        every = F.transform(kind("audio"), track)
        audio = F.filter(every, lambda s: (s["sample_rate"] > 0) & (s["channels"] > 0))
        form = document["format"]
        error = F.when(document.isNull() | (document["streams"].isNull() & form.isNull()), "unreadable").when((F.size(audio) == 0) & (F.size(every) > 0), "undecodable").when(F.size(every) == 0, "no_audio")
        return F.struct(
            F.coalesce(form["format_name"], F.lit("")).alias("container"), as_int(form["size"]).alias("size"), as_float(form["duration"]).alias("duration"), as_int(form["bit_rate"]).alias("bit_rate"),
            F.exists(kind("video"), lambda s: ~is_set(s, "attached_pic")).alias("has_video"), F.exists(kind("video"), lambda s: is_set(s, "attached_pic")).alias("has_picture"), audio.alias("audio"), error.alias("error"),
        )

    # the document is parsed once: as a column it would be again wherever it is named
    return F.element_at(F.transform(F.array(F.from_json(text, PROBE)), read), 1)


def default_track(audio: Column) -> Column:
    """The ordinal of the track to take: the first flagged one, else the one with the most channels, the first of equals."""
    order = F.transform(audio, lambda s: F.struct((~s["is_default"]).alias("a"), F.when(s["is_default"], F.lit(0)).otherwise(-s["channels"]).alias("b"), s["audio_index"].alias("k")))
    return F.array_min(order)["k"]


def default_stream(streams: DataFrame, key: str, ordinal: str, is_default: Column, channels: Column) -> DataFrame:
    """The same over a table of streams: (key, ordinal)."""
    best = F.min(F.struct((~is_default).alias("a"), F.when(is_default, F.lit(0)).otherwise(-channels).alias("b"), F.col(ordinal).alias("k")))
    return streams.groupBy(key).agg(best.alias("m")).select(key, F.col("m.k").alias(ordinal))


def sample_window(duration: Column) -> tuple[Column, Column]:
    """(start, length) of the sampled packets; NULL for what lasts a second or less."""
    start = F.greatest(F.lit(0.0), duration / 2 - SAMPLE_S / 2)
    length = F.least(F.lit(SAMPLE_S), duration - start)
    known = (duration > 1) & (length > 1)
    return F.when(known, start), F.when(known, length)


def sampled_rate(packets: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """(key, sampled) in bits a second: packets (key, at, size, span) around the middle of files (key, duration).

    Over the packets' own time where that is more than half a second, else over the window.
    """
    start, length = sample_window(F.col("duration"))
    window = files.select(key, start.alias("start"), length.alias("length")).where("length is not null")
    inside = packets.join(window, key).where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + F.col("length")) & F.col("size").isNotNull())
    summed = inside.groupBy(key).agg(F.sum("size").alias("bytes"), F.coalesce(F.sum("span"), F.lit(0.0)).alias("time"), F.max("length").alias("length"))
    span = F.when(F.col("time") > 0.5, F.col("time")).otherwise(F.col("length"))
    return summed.where("bytes > 0").select(key, (F.col("bytes") * 8 / span).cast("long").alias("sampled"))


def bit_rate(stated: Column, container: Column, only_audio: Column, sampled: Column) -> tuple[Column, Column]:
    """(tier, rate): the track's own rate, else the file's if it holds nothing else, else the sampled one."""
    stated, container = F.when(stated > 0, stated), F.when(only_audio & (container > 0), container)
    tier = F.when(stated.isNotNull(), "stated").when(container.isNotNull(), "container").when(sampled.isNotNull(), "sampled").otherwise("unknown")
    return tier, F.coalesce(stated, container, sampled)


def variable_rate(frames: DataFrame, key: str, kbps: str) -> DataFrame:
    """(key, is_vbr, average_kbps) of sampled frame headers: two rates or more make it variable."""
    return frames.groupBy(key).agg((F.count_distinct(kbps) > 1).alias("is_vbr"), F.avg(kbps).alias("average_kbps"))


def frames_duration(frames: Column, samples_per_frame: Column, sample_rate: Column, audio_bytes: Column, average_kbps: Column) -> Column:
    """Seconds, by the stated number of frames, else by bytes over the average rate; NULL where neither is known."""
    stated = F.when((frames > 0) & (sample_rate > 0), frames * samples_per_frame / F.when(sample_rate > 0, sample_rate))
    return F.coalesce(stated, F.when(average_kbps > 0, audio_bytes * 8 / (F.when(average_kbps > 0, average_kbps) * 1000)))


def granule_duration(last_granule: Column, sample_rate: Column, chained: Column) -> Column:
    """Seconds of an Ogg stream; NULL for chained ones and unknown rates."""
    return F.when((sample_rate > 0) & ~chained, last_granule / F.when(sample_rate > 0, sample_rate))


def compression_ratio(file_size: Column, metadata_bytes: Column, tag_bytes: Column, samples: Column, channels: Column, bits: Column) -> Column:
    """Audio bytes, without metadata and pictures, over those of plain samples; NULL where either is none."""
    audio = F.greatest(F.lit(0), file_size - metadata_bytes - tag_bytes)
    raw = F.floor(samples * channels * bits / 8)
    return F.when((audio > 0) & (raw > 0), audio / F.when(raw > 0, raw))


def has_block(present: Column, names: list[str]) -> Column:
    """Map from each block name to whether the file has it."""
    return F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.coalesce(F.array_contains(present, n), F.lit(False)) for n in names)))


def read_cache(spark, path: str, rules: str, version: int = 1) -> DataFrame:
    """(path, size, mtime_ns, rules, bucket): the usable entries of a scan cache, one JSON document {format, entries}.

    Another format or rules version, malformed entries and documents that are no JSON give no rows.
    """
    text = spark.read.text(path, wholetext=True)
    document = text.select(F.from_json(F.regexp_replace("value", "^﻿", ""), "format int, entries map<string,string>").alias("d"))
    entry = document.where(F.col("d.format") == version).select(F.explode("d.entries").alias("path", "e"))
    fields = F.from_json("e", "size string, mtime_ns string, rules string, bucket string")
    rows = entry.select("path", fields.alias("f")).select("path", as_int(F.col("f.size")).alias("size"), as_int(F.col("f.mtime_ns")).alias("mtime_ns"), "f.rules", "f.bucket")
    return rows.where((F.col("rules") == rules) & F.col("size").isNotNull() & F.col("mtime_ns").isNotNull() & F.col("bucket").isNotNull())


def reassembled(segments: DataFrame, key: str, order: str, size: str) -> DataFrame:
    """(key, packet, bytes, segments, complete): lacing values joined to packets, across pages; one below 255 ends its packet."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    packet = F.coalesce(F.sum((F.col(size) < 255).cast("long")).over(before), F.lit(0).cast("long"))
    return segments.withColumn("packet", packet).groupBy(key, "packet").agg(F.sum(size).alias("bytes"), F.count("*").alias("segments"), F.bool_or(F.col(size) < 255).alias("complete"))


def regions(size: Column, limit: int = 128 << 20, most: int = 8 << 20, count: int = 5) -> Column:
    """struct(parts, sampled): the byte ranges (start, length) of a file that are read.

    All of it up to `limit`; of a larger one `count` ranges of at most `most` bytes, the first
    at its beginning, the last at its end, the others evenly between, and `sampled` says so.
    """
    length = F.least(F.lit(most).cast("long"), F.greatest(F.lit(1).cast("long"), F.floor(size / count).cast("long")))
    some = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.struct(F.floor((size - length) * i / (count - 1)).cast("long").alias("start"), length.alias("length")))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.cast("long").alias("length")))
    return F.struct(F.when(size <= limit, whole).otherwise(some).alias("parts"), (size > limit).alias("sampled"))


def pcm_matches(pcm: Column, stated_md5: Column, depth: Column) -> Column:
    """Whether the bytes of the samples at their native depth have the stated MD5 (hex); NULL if none is stated or the depth has no bytes of its own."""
    known = depth.isin(8, 16, 24, 32) & ~stated_md5.rlike("^0*$") & pcm.isNotNull()
    return F.when(known, F.md5(pcm) == F.lower(stated_md5))

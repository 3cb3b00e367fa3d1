"""PCM from WAV files in blocks, and a directory listing.

A file is one row of Spark's `binaryFile` source, so a task holds a whole file; what leaves it
are blocks of bounded size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .containers import EXTENSIONS

#: Sample types by format and depth; 24 bits are three bytes, which numpy has no type for.
_KINDS = {(1, 8): "|u1", (1, 16): "<i2", (1, 24): "<i3", (1, 32): "<i4", (3, 32): "<f4", (3, 64): "<f8"}


def _width(kind: str) -> int:
    return int(kind[2:])


def decoded(data: bytes, kind: str, count: int, at: int) -> np.ndarray:
    """`count` samples from byte `at` on, integers as shares of full scale."""
    if kind == "<i3":
        raw = np.frombuffer(data, np.uint8, 3 * count, at).reshape(-1, 3)
        wide = np.zeros((count, 4), np.uint8)
        wide[:, 1:] = raw
        return wide.view("<i4").ravel() / float(1 << 31)
    x = np.frombuffer(data, kind, count, at).astype(np.float64)
    if kind == "|u1":
        return (x - 128) / 128
    return x / float(1 << (8 * _width(kind) - 1)) if kind[1] == "i" else x


def wav_layout(head: bytes) -> tuple[int, int, str, int, int]:
    """(sample rate, channels, sample type, offset of the samples, bytes of samples)."""
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, form = 12, None
    while at + 8 <= len(head):
        name, size = head[at : at + 4], struct.unpack_from("<I", head, at + 4)[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, depth = struct.unpack_from("<HHIIHH", head, at + 8)
            if kind == 0xFFFE:
                kind = struct.unpack_from("<H", head, at + 32)[0]
            form = (rate, channels, _KINDS[kind, depth])
        elif name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            return (*form, at + 8, size)
        at += 8 + size + size % 2
    raise ValueError("no samples")


def read_blocks(files: DataFrame, *, block: int = 1 << 16, start_s: float = 0.0, duration_s: float | None = None) -> DataFrame:
    """(path, sample_rate, block_no, pos, pcm, nonfinite): blocks of frames, the last one short.

    files: (path, content). pcm has an array for each frame, integers of 8 to 32 bits as shares of
    full scale; samples that are not finite become 0 and are counted. A cut-off frame is an error.
    """
    schema = "path string, sample_rate long, block_no long, pos long, pcm array<array<float>>, nonfinite long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch["path"].to_pylist(), batch["content"], strict=True):
                data = raw.as_py()
                rate, channels, kind, at, size = wav_layout(data)
                width = _width(kind) * channels
                size = min(size, len(data) - at)
                if size % width:
                    raise ValueError(f"{path}: a frame is cut off")
                n = size // width
                first = min(n, int(start_s * rate))
                last = n if duration_s is None else min(n, first + int(duration_s * rate))
                for k, p in enumerate(range(first, last, block)):
                    x = decoded(data, kind, min(block, last - p) * channels, at + p * width)
                    bad = ~np.isfinite(x)
                    x = np.where(bad, 0.0, x).astype(np.float32)
                    pcm = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, channels, dtype=np.int32)), pa.array(x))
                    rows = pa.ListArray.from_arrays(pa.array([0, len(pcm)], pa.int32()), pcm)
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([rate]), pa.array([k]), pa.array([p]), rows, pa.array([int(bad.sum())])], ["path", "sample_rate", "block_no", "pos", "pcm", "nonfinite"])

    return files.select(F.col("path").cast("string").alias("path"), "content").mapInArrow(run, schema)


def samples(blocks: DataFrame) -> DataFrame:
    """(path, pos, channels): one row a frame."""
    return blocks.select("path", "pos", F.posexplode("pcm").alias("k", "channels")).select("path", (F.col("pos") + F.col("k")).alias("pos"), "channels")


def window(frames: DataFrame, start: int, count: int) -> DataFrame:
    """Frames start .. start + count - 1, fewer at the end, never padded."""
    if start < 0 or count < 0:
        raise ValueError("start and count are not negative")
    return frames.where((F.col("pos") >= start) & (F.col("pos") < start + count))


def discover(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modificationTime, content): audio files under `root`, hidden folders left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    extension = F.lower(F.element_at(F.split("path", r"\."), -1))
    return files.where(extension.isin(*EXTENSIONS) & ~F.col("path").rlike(r"/\.[^/]+/"))

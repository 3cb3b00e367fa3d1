"""WAV files read by byte ranges: a Spark data source whose input partitions are ranges of frames.

The driver lists files and, only where a window is asked for, reads their headers. Each task reads
the header of its file and the bytes of its own blocks, so a file of any length is read by many
tasks, and a window costs what it holds. Files are reached through pyarrow's file systems.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .wav import _KINDS, _width, decoded

SCHEMA = "path string, sample_rate long, block_no long, pos long, start_s double, pcm array<array<float>>, nonfinite long, bytes long"
#: Sizes that say "longer than 32 bits" or "not known when it was written".
UNKNOWN = (0, 0xFFFFFFFF)
#: What opening a file counts as when ranges of small files are put into one task.
OPEN_BYTES = 4 << 20


class Layout(NamedTuple):
    """Where the samples of a file lie, and what they are."""

    rate: int
    channels: int
    kind: str
    at: int
    frames: int

    @property
    def width(self) -> int:
        return _width(self.kind) * self.channels


def located(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path, and the path in it; no scheme means the local one."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if ":/" in uri else (pafs.LocalFileSystem(), uri)


def layout(read: Callable[[int, int], bytes], size: int) -> Layout:
    """The layout of a RIFF, or 64-bit RF64, file of `size` bytes; `read(at, n)` is asked for chunk headers alone."""
    head = read(0, 12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, form, long_size = 12, None, None
    while at + 8 <= size:
        name, length = struct.unpack("<4sI", read(at, 8))
        if name == b"ds64":
            long_size = struct.unpack("<Q", read(at + 16, 8))[0]
        elif name == b"fmt ":
            spec = read(at + 8, min(length, 40))
            kind, channels, rate, _, _, depth = struct.unpack_from("<HHIIHH", spec)
            if kind == 0xFFFE:
                kind = struct.unpack_from("<H", spec, 24)[0]
            if (kind, depth) not in _KINDS or not channels or not rate:
                raise ValueError(f"samples of format {kind} and {depth} bits are not supported")
            form = (rate, channels, _KINDS[kind, depth])
        elif name == b"data":
            if form is None:
                raise ValueError("samples before their format")
            length = long_size if head[:4] == b"RF64" and long_size is not None else size - at - 8 if length in UNKNOWN else length
            length, width = min(length, size - at - 8), _width(form[2]) * form[1]
            if length % width:
                raise ValueError("a frame is cut off")
            return Layout(*form, at + 8, length // width)
        at += 8 + length + length % 2
    raise ValueError("no samples")


def header(frames: int, channels: int, rate: int, kind: str = "<i2") -> bytes:
    """What precedes samples of 16 bits, or of 32-bit floats ("<f4"); RF64 where 32 bits do not hold their size."""
    width = _width(kind) * channels
    size = frames * width
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 3 if kind[1] == "f" else 1, channels, rate, rate * width, width, 8 * _width(kind))
    if size + 36 < 0xFFFFFFFF:
        return struct.pack("<4sI4s", b"RIFF", 36 + size, b"WAVE") + form + struct.pack("<4sI", b"data", size)
    wide = struct.pack("<4sIQQQI", b"ds64", 28, 72 + size, size, frames, 0)
    return struct.pack("<4sI4s", b"RF64", 0xFFFFFFFF, b"WAVE") + wide + form + struct.pack("<4sI", b"data", 0xFFFFFFFF)


@dataclass
class Ranges(InputPartition):
    """(path, size, first byte, end byte): blocks that begin in a range are the task's own."""

    parts: list[tuple[str, int, int, int]]

    def __init__(self, parts: list[tuple[str, int, int, int]]) -> None:
        super().__init__(None)
        self.parts = parts


class PcmReader(DataSourceReader):
    """Blocks of frames of all WAV files below a path.

    Options: `path` (a file or a folder, read with its subfolders), `block` (frames a row),
    `start_s` and `duration_s` (a window of each file, also as `first` and `count` in frames, and `at`
    as a share of its length from which on it starts), `mono`
    (channels averaged), `split_bytes` (bytes a task), `paths` (a JSON list of the paths to read, of
    those below `path`). What these leave out is never opened, or never read. They are options and not
    filters that Spark hands down, since Spark 4.1 keeps the narrowed partitions for every other plan
    of the same frame: after a count of some files, all files counted as those (10 of 101 blocks).
    """

    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.block, self.split = int(options.get("block", 1 << 16)), int(options.get("split_bytes", 64 << 20))
        self.start_s, self.first = float(options.get("start_s", 0)), int(options.get("first", 0))
        self.duration_s, self.count = (None if options.get(k) is None else kind(options[k]) for k, kind in (("duration_s", float), ("count", int)))
        self.at = float(options.get("at", 0))
        self.mono = str(options.get("mono", "false")).lower() == "true"
        if self.block < 1 or min(self.start_s, self.first, self.at, self.duration_s or 0, self.count or 0) < 0:
            raise ValueError("a window does not start before its file, and nothing is of negative length")
        self.paths = set(json.loads(options["paths"])) if "paths" in options else None

    def window(self, form: Layout) -> tuple[int, int]:
        """First and end frame that the options ask for."""
        first = min(form.frames, max(self.first, int(self.start_s * form.rate), int(self.at * form.frames)))
        ends = [form.frames, *(first + n for n in (None if self.duration_s is None else int(self.duration_s * form.rate), self.count) if n is not None)]
        return first, min(ends)

    def partitions(self) -> Sequence[InputPartition]:
        files, root = located(self.root)
        info = files.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else files.get_file_info(pafs.FileSelector(root, recursive=True)) if info.type == pafs.FileType.Directory else []
        if not found and info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        found = sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._" and (self.paths is None or f.path in self.paths))
        spans = [(path, size, 0, size) for path, size in found]
        if self.start_s or self.first or self.at or self.duration_s is not None or self.count is not None:

            def narrowed(span: tuple[str, int, int, int]) -> tuple[str, int, int, int]:
                path, size, _, _ = span
                with files.open_input_file(path) as f:
                    form = layout(lambda at, n: f.read_at(n, at), size)
                first, end = self.window(form)
                return path, size, form.at + first * form.width, form.at + end * form.width

            with ThreadPoolExecutor(16) as pool:
                spans = [s for s in pool.map(narrowed, spans) if s[3] > s[2]]
        tasks, held, room = [], [], self.split
        for path, size, low, high in spans:
            for at in range(low, high, self.split):
                end = min(high, at + self.split)
                if held and end - at + OPEN_BYTES > room:
                    tasks.append(Ranges(held))
                    held, room = [], self.split
                held.append((path, size, at, end))
                room -= end - at + OPEN_BYTES
        return [*tasks, *([Ranges(held)] if held else [])] or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        files, _ = located(self.root)
        for path, size, low, high in partition.parts:
            with files.open_input_file(path) as f:
                form = layout(lambda at, n, f=f: f.read_at(n, at), size)
                (first, end), step = self.window(form), self.block * form.width
                zero = form.at + first * form.width
                for k in range(max(0, -((zero - low) // step)), min(-((first - end) // self.block), -((zero - high) // step))):
                    pos = first + k * self.block
                    n = min(self.block, end - pos)
                    data = f.read_at(n * form.width, form.at + pos * form.width)
                    x = decoded(data, form.kind, n * form.channels, 0)
                    bad = ~np.isfinite(x)
                    x, channels = np.where(bad, 0.0, x), form.channels
                    if self.mono:
                        x, channels = x.reshape(-1, channels).mean(axis=1), 1
                    frames = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) + 1, channels, dtype=np.int32)), pa.array(x.astype(np.float32)))
                    rows = pa.ListArray.from_arrays(pa.array([0, len(frames)], pa.int32()), frames)
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([form.rate]), pa.array([k]), pa.array([pos]), pa.array([pos / form.rate]), rows, pa.array([int(bad.sum())]), pa.array([len(data)])], names=[c.split()[0] for c in SCHEMA.split(", ")])


class PcmSource(DataSource):
    """`spark.read.format("pcm")`, see PcmReader."""

    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PcmReader:
        return PcmReader(self.options)


def read_pcm(spark: SparkSession, path: str, paths: list[str] | None = None, **options) -> DataFrame:
    """Blocks of the WAV files below `path`: path, sample_rate, block_no, pos, start_s, pcm, nonfinite, bytes.

    pcm holds an array for each frame, integers as shares of full scale; samples that are not finite
    become 0 and are counted; `bytes` is what was read for the row. A window that begins past the end
    of a file gives no rows of it, and an empty folder none at all. A file that is not WAV, or whose
    last frame is cut off, is an error.
    """
    spark.dataSource.register(PcmSource)
    reader = spark.read.format("pcm").option("path", path)
    for k, v in (options | ({} if paths is None else {"paths": json.dumps(paths)})).items():
        reader = reader.option(k, v)
    return reader.load()


def write_wav(blocks: DataFrame, folder: str, rate: int, *, name: str = "name", pos: str = "pos", pcm: str = "pcm", kind: str = "<i2") -> None:
    """WAV files, one for each name, from blocks (name, pos, pcm) that leave no gaps: of 16 bits, or of 32-bit floats ("<f4").

    A file's blocks come to one task in order and go through it one batch at a time. It is written
    under a name of its own and moved when it is whole, so that a task may run twice. 16 bits hold pcm
    beyond full scale to it, floats keep it. A gap, or a change in the number of channels, is an error.
    """
    if kind not in ("<i2", "<f4"):
        raise ValueError(f"no samples of {kind} are written")
    sizes = blocks.groupBy(F.col(name).alias("name")).agg(F.sum(F.size(pcm)).alias("frames"))
    rows = blocks.select(F.col(name).alias("name"), F.col(pos).cast("long").alias("pos"), F.col(pcm).cast("array<array<float>>").alias("pcm"))
    # by a hash: in place of a repartition by the join's own key Spark takes the join's shuffle, and no longer keeps a name in one task once the join becomes a broadcast while it runs
    rows = rows.join(sizes, "name").repartition(F.xxhash64("name")).sortWithinPartitions("name", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = located(folder)
        files.create_dir(root, recursive=True)
        open_name, out, temp, at, due, wide = None, None, "", 0, 0, 0

        def closed() -> None:
            if at != due:
                raise ValueError(f"{open_name}: {at} of {due} frames")
            out.close()
            files.move(temp, f"{root}/{open_name}.wav")

        for batch in batches:
            for key, first, frames, total in zip(batch["name"].to_pylist(), batch["pos"].to_pylist(), batch["pcm"], batch["frames"].to_pylist(), strict=True):
                flat = frames.values
                channels = len(flat[0])
                x = flat.flatten().to_numpy(zero_copy_only=False)
                if key != open_name:
                    if out is not None:
                        closed()
                    open_name, at, due, wide = key, 0, total, channels
                    temp = f"{root}/.{key}-{uuid.uuid4().hex}"
                    out = files.open_output_stream(temp)
                    out.write(header(total, channels, rate, kind))
                if first != at or len(x) != len(flat) * wide:
                    raise ValueError(f"{key}: block at {first} where {at} is due, or another number of channels")
                out.write((x if kind == "<f4" else np.clip(np.rint(x * 32768.0), -32768, 32767)).astype(kind).tobytes())
                at += len(flat)
        if out is not None:
            closed()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32())], names=["task"])

    rows.mapInArrow(run, "task int").write.format("noop").mode("overwrite").save()

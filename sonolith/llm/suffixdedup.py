"""Exact substring dedup: remove bytes covered by a long string that occurs more than once.

This is no induced sort: README.md says why, with figures. Which suffixes share their first
`window` bytes is decided by sampled places and hashes of what stands around them. The places are
content-defined (the smallest gram hash of each window), so equal windows are sampled at equal
places. Places are grouped by gram; if all places of a gram stand in equal strings, that settles
all their windows at once. Where the members of a gram's group differ, one member of each class
goes on to blocks of 32, of 4 and of single windows: blocks whose hashes agree are settled, and
those that share what all their windows have in common are cut further. Groups are aggregates and
joins over two 64-bit hashes, so that no step holds a gram's group or a class of copies in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

GRAM = 32
_NO_ID = -(1 << 63)
_PIECE = 4 << 20
_POS = 28  # bits of a position inside a piece of a batch
#: Odd multipliers of the rolling hash; any will do.
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes from each position on; it doubles the width five times."""
    h, width = data.astype(np.uint64), 1
    for odd in _ODD:
        h = h[:-width] * odd + h[width:]
        width *= 2
    h ^= h >> np.uint64(29)
    h *= _ODD[0]
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each `width` consecutive values."""
    n = len(x) - width + 1
    pad = -len(x) % width
    blocks = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    prefix = np.minimum.accumulate(blocks, 1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(suffix[:n], prefix[width - 1 : width - 1 + n])


def sampled(data: bytes, starts: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, y, gram hash): runs of window starts whose windows have the same sampled suffix.

    y tells how far after the earliest possible one the first window starts.

    data: joined strings, each from starts[k] to ends[k]; windows do not cross them.
    """
    if len(data) < window:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h = _gram_hashes(np.frombuffer(data, np.uint8))
    low = np.uint64((1 << _POS) - 1)
    least = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), window - GRAM + 1)
    valid = np.zeros(len(data) + 1, np.int8)
    long = ends - starts >= window
    valid[starts[long]] += 1
    np.subtract.at(valid, ends[long] - window + 1, 1)
    at = np.flatnonzero(np.cumsum(valid[: len(least)], dtype=np.int8))
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    place = (least[at] & low).astype(np.int64)
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(at) != 1)) + 1
    first, last = at[np.concatenate([[0], cut])], at[np.concatenate([cut - 1, [len(at) - 1]])]
    place = place[np.concatenate([[0], cut])]
    return first, last, first - place + window - GRAM, h[place]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Documents with a key of their own: the id, a null one as `_NO_ID`, and a hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col), _no_id(docs, id_col)).alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _no_id(docs: DataFrame, id_col: str) -> Column:
    return F.lit(_NO_ID).cast(docs.schema[id_col].dataType)


def runs(docs: DataFrame, *, window: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sampled suffixes of all texts: (g, s, doc_id, th, at, more, y).

    g: the gram's hash; the windows from byte `at` to `at + more` have this sampled suffix;
    s: a hash of the bytes that these windows span; y: see `sampled`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, _PIECE):
            parts, row, offset = [], [], []
            for k, text in enumerate(batch["text"].to_pylist()):
                data = text.encode()
                for at in range(0, max(len(data) - window + 1, 0), _PIECE):
                    parts.append(data[at : at + _PIECE + window - 1])
                    row.append(k)
                    offset.append(at)
            # a text longer than a piece fills batches of its own
            for a, b in _groups(parts):
                data = b"".join(parts[a:b])
                ends = np.cumsum([len(p) for p in parts[a:b]])
                starts = ends - [len(p) for p in parts[a:b]]
                first, last, y, gram = sampled(data, starts, ends, window)
                if not len(first):
                    continue
                of = np.searchsorted(ends, first, "right")
                digest = xxhash.xxh64_intdigest
                span = np.array([digest(data[i:j]) for i, j in zip(first.tolist(), (last + window).tolist(), strict=True)], np.uint64)
                rows = pa.array(np.array(row[a:b])[of])
                at = first - starts[of] + np.array(offset[a:b])[of]
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(span.view(np.int64)), batch["doc_id"].take(rows), batch["th"].take(rows), pa.array(at), pa.array((last - first).astype(np.int32)), pa.array(y.astype(np.int32))], ["g", "s", "doc_id", "th", "at", "more", "y"])

    return _rows(docs, id_col, text_col).mapInArrow(run, f"g long, s long, doc_id {docs.schema[id_col].dataType.simpleString()}, th long, at long, more int, y int")


def _groups(parts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of parts of together at most about two pieces."""
    a, size = 0, 0
    for b, p in enumerate(parts):
        if size and size + len(p) > 2 * _PIECE:
            yield a, b
            a, size = b, 0
        size += len(p)
    if parts:
        yield a, len(parts)


#: Blocks of window starts that are compared at once, from level to level of the induction.
LEVELS = (32, 4, 1)


def repeated(docs: DataFrame, *, window: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, th, lo, hi): ranges of window starts whose windows start anywhere else as well."""
    found = materialise(runs(docs, window=window, id_col=id_col, text_col=text_col), "runs")
    often = materialise(found.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g"), "often")
    found = materialise(found.join(often, "g"), "repeated-grams")
    classes = materialise(found.groupBy("g", "s", "more", "y").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "at")).alias("rep")), "classes")
    # all windows of such a class are repeated, whatever else its gram's group holds
    whole = found.join(classes.where("n > 1").select("g", "s", "more"), ["g", "s", "more"]).select("doc_id", "th", F.col("at").alias("lo"), (F.col("at") + F.col("more")).alias("hi"))
    marks = [materialise(whole, "marks")]
    # where classes of a group differ, one member of each goes on with the bytes it spans
    mixed = materialise(classes.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select("g"), "mixed")
    asked = classes.join(mixed, "g").groupBy("rep.doc_id", "rep.th").agg(F.collect_set(F.struct(F.col("rep.at").alias("at"), "more", "y", "n")).alias("asked"))
    texts = _rows(docs, id_col, text_col).join(asked, ["doc_id", "th"])
    members = texts.select("doc_id", "th", F.col("text").cast("binary").alias("text"), F.inline("asked")).select("doc_id", "th", "at", "more", "y", "n", F.expr(f"substring(text, int(at) + 1, more + {window})").alias("span"))
    # rows with equal id and text are one member: their number is in n
    members = materialise(members.dropDuplicates(["doc_id", "th", "at"]).withColumn("id", F.monotonically_increasing_id()), "members")
    pieces = members.select("id", F.lit(0).alias("lo"), F.col("more").alias("hi"), "n")
    for level in LEVELS:
        keys = materialise(_keys(pieces.join(members.select("id", "y", "span"), "id"), level, window), f"keys{level}")
        same = keys.groupBy("c", "s").agg(F.sum("n").alias("n"), F.min(F.struct("id", "lo", "hi")).alias("rep"))
        same = materialise(same, f"same{level}")
        cores = same.groupBy("c").agg(F.count("*").alias("k"), F.sum("n").alias("all")).where("all > 1").select("c", "k")
        done = keys.where("n = 1").join(same.where("n > 1").select("c", "s"), ["c", "s"])
        done = done.join(members.select("id", "doc_id", "th", "at"), "id")
        marks.append(materialise(done.select("doc_id", "th", (F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")), f"marks{level}"))
        pieces = same.join(cores.where("k > 1"), "c").select("rep.*", "n")
    return reduce(DataFrame.unionByName, marks)


def _keys(pieces: DataFrame, level: int, window: int) -> DataFrame:
    """(c, s, id, lo, hi, n): pieces cut at multiples of `level` window starts.

    c: a hash of the bytes that all windows of the uncut block would share, so windows of two
    pieces can be equal only under the same c; s: a hash of all bytes of the piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for batch in small_batches(batches, 4 << 20):
            out: list[tuple] = []
            for k, lo, hi, n, y, span in zip(*(batch[c].to_pylist() for c in ("id", "lo", "hi", "n", "y", "span")), strict=True):
                for x in range((y + lo) // level * level, y + hi + 1, level):
                    a, b = max(x - y, lo), min(x - y + level - 1, hi)
                    out.append((digest(span[x - y + level - 1 : x - y + window], x), digest(span[a : b + window], a - x + y), k, a, b, n))
            c, s, *rest = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (c, s)] + [pa.array(v, t) for v, t in zip(rest, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["c", "s", "id", "lo", "hi", "n"])

    return pieces.select("id", "lo", "hi", "n", "y", "span").mapInArrow(run, "c long, s long, id long, lo int, hi int, n long")


def _spans(lo: np.ndarray, hi: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows that start in lo..hi."""
    order = np.argsort(lo, kind="stable")
    lo, end = lo[order], np.maximum.accumulate(hi[order] + window)
    cut = np.flatnonzero(lo[1:] > end[:-1]) + 1
    return list(zip(lo[np.concatenate([[0], cut])].tolist(), end[np.concatenate([cut - 1, [len(end) - 1]])].tolist(), strict=True))


def dedup(docs: DataFrame, *, window: int = 200, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Remove each byte covered by a `window`-byte string that also starts anywhere else.

    Texts are UTF-8 bytes, a null one has none; matches never cross documents and are judged
    on the input. Returns for each row (doc_id, n_bytes, n_removed, n_spans, kept_sha256) and,
    if asked for, the remaining bytes as `kept`. Repeated rows repeat each other.
    """
    marks = repeated(docs, window=window, id_col=id_col, text_col=text_col)
    marks = marks.groupBy("doc_id", "th").agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi"))
    rows = _rows(docs, id_col, text_col).join(marks, ["doc_id", "th"], "left")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            out = []
            for k, text in enumerate(batch["text"].to_pylist()):
                data, kept, at = text.encode(), [], 0
                lo = batch["lo"][k].values
                spans = _spans(lo.to_numpy(), batch["hi"][k].values.to_numpy(), window) if lo is not None and len(lo) else []
                for a, b in spans:
                    kept.append(data[at:a])
                    at = b
                rest = b"".join([*kept, data[at:]])
                out.append((len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()) + (rest,) * with_text)
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names)

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    done = rows.select("doc_id", "text", "lo", "hi").mapInArrow(run, schema)
    return done.withColumn("doc_id", F.nullif(F.col("doc_id"), _no_id(docs, id_col)))

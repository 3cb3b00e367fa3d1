"""Subword encoding that keeps, for every piece, the bytes of the text that it came from; and decoding.

A character map, compiled into a double-array trie, rewrites the text by longest prefixes; what each
rewritten byte came from is recorded. Where no piece of the model goes on past a space mark that
follows another character, a text is cut there, and equal stretches are merged once a worker.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import small_batches

SPACE = "▁"
#: Stretches that a Python worker remembers before it starts anew.
REMEMBERED = 500_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
            continue
        size = number() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[at : at + size]
        at += size


def compiled_map(blob: bytes) -> dict[str, str]:
    """Every source string of a compiled character map, with its replacement: a walk over all nodes of its trie.

    The blob is the trie's size, its 32-bit units, and replacements that end with a zero byte. A
    unit holds a label, whether a value hangs below, and the offset of its children.
    """
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob, "<u4", size // 4, 4).astype(np.int64), blob[4 + size :]
    labels, leaf, below = units & 0x800000FF, (units >> 8) & 1, (units >> 10) << ((units & 512) >> 6)
    found, every = {}, np.arange(1, 256)
    nodes, prefixes = below[:1], [b""]
    while len(nodes):  # a level of the trie at a time
        children, names = [], []
        for k in range(0, len(nodes), 10_000):
            near = nodes[k : k + 10_000, None] ^ every
            parent, byte = np.nonzero((near < len(units)) & (labels[np.minimum(near, len(units) - 1)] == every))
            place = near[parent, byte]
            child = place ^ below[place]
            sources = [prefixes[k + p] + bytes([b]) for p, b in zip(parent.tolist(), every[byte].tolist(), strict=True)]
            for j in np.flatnonzero(leaf[place]).tolist():
                start = int(units[child[j]]) & 0x7FFFFFFF
                found[sources[j]] = texts[start : texts.index(b"\0", start)]
            children.append(child)
            names += sources
        nodes, prefixes = np.concatenate(children), names
    return {k.decode(): v.decode() for k, v in found.items()}


class Normaliser:
    """Longest-prefix rewriting, white space rules, and where each byte of the outcome came from."""

    def __init__(self, charmap: dict[str, str], dummy_prefix: bool, squeeze: bool, escape: bool) -> None:
        self.charmap, self.dummy_prefix, self.squeeze, self.space = charmap, dummy_prefix, squeeze, SPACE if escape else " "
        longest: dict[str, int] = {}
        for source in charmap:
            longest[source[0]] = max(longest.get(source[0], 0), len(source))
        self.longest = longest

    def plain(self) -> bool:
        """Nothing but spaces is rewritten."""
        return not self.charmap and not self.squeeze

    def text(self, text: str) -> str:
        if self.plain():
            return (self.space if self.dummy_prefix and text else "") + text.replace(" ", self.space)
        return "".join(x[0] for x in self.steps(text))

    def steps(self, text: str) -> list[tuple[str, int, int]]:
        """(rewritten, first character, end character of its source) from left to right."""
        out: list[tuple[str, int, int]] = []
        at, held, blank = 0, self.longest, self.squeeze
        while at < len(text):
            char = text[at]
            size, new = 1, char
            for n in range(min(held.get(char, 0), len(text) - at), 0, -1):
                if (found := self.charmap.get(text[at : at + n])) is not None:
                    size, new = n, found
                    break
            if blank:
                new = new.lstrip(" ")
            if new:
                if not out and self.dummy_prefix:
                    out.append((self.space, at, at))
                out.append((new.replace(" ", self.space), at, at + size))
                blank = self.squeeze and new.endswith(" ")
            elif not out and not self.squeeze and self.dummy_prefix:
                out.append((self.space, at, at))
            at += size
        if self.squeeze:
            while out and out[-1][0].endswith(self.space):
                last, a, b = out.pop()
                if last := last.removesuffix(self.space):
                    out.append((last, a, b))
        return out

    def sources(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First and end byte, in the text's UTF-8, of what each byte of the rewritten text came from.

        A byte that is kept came from itself, each byte of a replacement from all that it replaces,
        and a prefix that is added from nothing.
        """
        raw = np.frombuffer(text.encode(), np.uint8)
        if self.plain():
            wide = len(self.space.encode())
            first = np.repeat(np.arange(len(raw)), np.where(raw == 32, wide, 1))
            extra = np.zeros(wide if self.dummy_prefix and len(raw) else 0, np.int64)
            return np.concatenate([extra, first]), np.concatenate([extra, first + 1])
        begins = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        first, end = [], []
        for new, a, b in self.steps(text):
            a, b, size = int(begins[a]), int(begins[b]), len(new.encode())
            kept = new.encode() == raw[a:b].tobytes()
            first += range(a, b) if kept else [a] * size
            end += range(a + 1, b + 1) if kept else [b] * size
        return np.array(first, np.int64), np.array(end, np.int64)


def _message(fields: list[tuple[int, int | bytes]]) -> bytes:
    """The fields as a protocol-buffer message: numbers and byte strings."""

    def number(value: int) -> bytes:
        out = bytearray()
        while value > 127:
            out.append(value & 127 | 128)
            value >>= 7
        return bytes([*out, value])

    return b"".join(number(k << 3) + number(v) if isinstance(v, int) else number(k << 3 | 2) + number(len(v)) + v for k, v in fields)


class Model:
    """A model's normalisation, with sources, and its merges; the library merges what is already normalised."""

    def __init__(self, path: str) -> None:
        data, rules, rest, sizes, apart, fallback = Path(path).read_bytes(), {}, [], [], True, False
        for field, value in _fields(data):
            if field == 3:
                rules = dict(_fields(value))
                continue
            rest.append((field, value))
            if field == 1:
                piece = dict(_fields(value))
                name, sort = piece[1].decode(), piece.get(3, 1)
                sizes.append(1 if sort == 6 else len(name.encode()))
                apart &= sort in (2, 3, 6) or SPACE not in name.lstrip(SPACE)
            elif field == 2:
                spec = dict(_fields(value))
                fallback, apart = bool(spec.get(35, 0)), apart and not spec.get(24, 0)
        if not fallback:
            raise ValueError("a model without byte fallback does not say how long an unknown piece is")
        self.normaliser = Normaliser(compiled_map(rules.get(2, b"")), bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1)))
        self.stretch = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else r"(?s:.+)")
        self.sizes = np.array(sizes, np.int64)
        as_is = [(1, b"identity"), (2, b""), (3, 0), (4, 0), (5, 0)]
        self.merges = sentencepiece.SentencePieceProcessor(model_proto=_message([*rest, (3, _message(as_is))]))
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts = array("i"), array("q", [0])

    def places(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Where the codes of each text's stretches are kept; what is new is merged first."""
        if len(self.known) > REMEMBERED or len(self.ids) > 16 * REMEMBERED:
            self.forget()
        found = [np.fromiter(map(self.known.get, text, repeat(-1)), np.int64, len(text)) for text in texts]
        gaps = [np.flatnonzero(at < 0) for at in found]
        new = list({text[k] for text, gap in zip(texts, gaps, strict=True) for k in gap.tolist()})
        for stretch, ids in zip(new, self.merges.encode(new, num_threads=1), strict=True):
            self.known[stretch] = len(self.starts) - 1
            self.ids.extend(ids)
            self.starts.append(len(self.ids))
        for text, at, gap in zip(texts, found, gaps, strict=True):
            at[gap] = [self.known[text[k]] for k in gap.tolist()]
        return found

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each text its ids, and the first and end byte of each in the text."""
        cut = [self.stretch.findall(self.normaliser.text(text)) for text in texts]
        held = self.places(cut)
        starts, known, out = np.frombuffer(self.starts, np.int64), np.frombuffer(self.ids, np.int32), []
        for text, places in zip(texts, held, strict=True):
            count = starts[places + 1] - starts[places]
            at = np.repeat(starts[places] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            if not len(at):
                out.append((np.empty(0, np.int32),) * 3)
                continue
            ids = known[at]
            sizes = self.sizes[ids]
            ends = np.cumsum(sizes)
            first, end = self.normaliser.sources(text)
            out.append((ids, first[ends - sizes].astype(np.int32), end[ends - 1].astype(np.int32)))
        return out


@lru_cache(2)
def model(path: str) -> Model:
    """The model of a file, read once in each Python process."""
    return Model(path)


@lru_cache(2)
def _library(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def _text(path: str, ids: list[int]) -> str:
    return _library(path).decode(ids) if ids else ""


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Ids of every whole text without begin and end marks, and the original bytes that each piece stands for.

    With `decoded` there is a column of that name with the text that the ids decode to.

    Returns one row for each row of `docs`: doc_id, ids, begins and ends (byte offsets in the text's
    UTF-8, end exclusive). The first piece of a text starts with a space mark that stands for no
    byte; a character that the map rewrites is covered whole by each piece that holds a part of its
    replacement. A null or empty text has empty arrays; ids may repeat or be null and are passed on;
    other columns are not read. A text of any length is encoded whole.
    """
    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), *(StructField(n, ArrayType(IntegerType())) for n in ("ids", "begins", "ends")), *([StructField("decoded", StringType())] if decoded else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model(model_path)
        for batch in small_batches(batches, 1 << 20):
            coded = held.encode(batch.column(1).to_pylist())
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(c[0]) for c in coded])]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([c[k] for c in coded]), pa.int32())) for k in range(3)]
            texts = [pa.array([_text(model_path, c[0].tolist()) for c in coded], pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, *texts], names=schema.names)

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)


def decode(coded: DataFrame, model_path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """`coded` with the text of its ids as `name`; no ids, or null, give an empty text. A column of that name is replaced."""
    kept = coded.drop(name)
    schema = StructType([*kept.schema.fields, StructField(name, StringType())])
    at = kept.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 20):
            texts = [_text(model_path, ids) for ids in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=schema.names)

    return kept.mapInArrow(run, schema)

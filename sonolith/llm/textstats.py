"""Counts over whole texts that the quality rules and the quality classifier use."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, small_batches

_SYMBOLS = re.compile(r"[#*$%&|<>]+")
_RARE = re.compile(r"[^\w\s.,;:!?'\"()\-#*$%&|<>]+")

#: Columns of `rule_stats` after doc_id; all long.
RULE_STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one text.

    Words are runs of other than space and ASCII control space. A word counts as repeated if
    a window of three words that holds it occurs twice or more in the text.
    """
    raw = text.encode()
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, len(_SYMBOLS.findall(text)) and sum(map(len, _SYMBOLS.findall(text))), 0, 0
    if text.isascii():
        chars = sum(map(len, words))
    else:
        chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    dup = 0
    if b"\n" in raw:
        lines = [x for x in raw.split(b"\n") if x and x.split(None, 1)]
        dup = len(lines) - len(set(lines))
    return n, chars, symbols, dup, _repeated(words)


def _repeated(words: list[bytes]) -> int:
    n = len(words)
    if n < 4:
        return 0
    code: dict[bytes, int] = {}
    c = np.array([code.setdefault(w, len(code)) for w in words], np.uint64)
    if len(code) < 1 << 21:
        key = (c[:-2] << np.uint64(42)) | (c[1:-1] << np.uint64(21)) | c[2:]
    else:  # pairs get numbers of their own, so that a key still fits
        pair = np.unique((c[:-1] << np.uint64(32)) | c[1:], return_inverse=True)[1].astype(np.uint64)
        key = (pair[:-1] << np.uint64(32)) | c[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= again
    return int(hit.sum())


def rule_stats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *RULE_STATS) of every whole text; null and empty texts count zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            cols = zip(*map(rule_counts, batch["text"].to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", *RULE_STATS])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in RULE_STATS)
    return doc_texts(docs, id_col, text_col).mapInArrow(run, schema)


#: Features of the quality classifier, in order; all doubles.
FEATURES = (
    "log_words", "mean_word", "symbol_rate", "upper_rate", "digit_rate", "mark_rate", "bang_rate", "pipe_rate", "distinct_rate",
    "top_word_rate", "log_lines", "dup_line_rate", "short_line_rate", "rare_rate", "words_with_symbol", "longest_word",
)


def features_of(text: str) -> tuple[float, ...]:
    """The classifier's features of one whole text."""
    n_chars = max(len(text), 1)
    words = text.split()
    n = max(len(words), 1)
    lengths = [len(w) for w in words] or [0]
    counts = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    n_lines = max(len(lines), 1)
    count = text.count
    symbols = sum(map(count, "#*$%&|<>"))
    lower = text.lower()
    changed = sum(a != b for a, b in zip(text, lower, strict=False)) if not text.isascii() else _ascii_upper(text)
    digits = sum(map(count, "0123456789"))
    marks = sum(map(count, ".,;:?'\"()-"))
    dirty = sum(map(bool, map(_SYMBOLS.search, words))) if symbols else 0
    return (
        math.log1p(len(words)), sum(lengths) / n, symbols / n_chars, changed / n_chars, digits / n_chars, marks / n_chars, count("!") / n_chars, count("|") / n_chars, len(counts) / n,
        (counts.most_common(1)[0][1] if counts else 0) / n, math.log1p(len(lines)), 1 - len(set(lines)) / n_lines, sum(len(x) < 30 for x in lines) / n_lines, sum(map(len, _RARE.findall(text))) / n_chars, dirty / n, float(max(lengths)),
    )


def _ascii_upper(text: str) -> int:
    a = np.frombuffer(text.encode(), np.uint8)
    return int(((a >= 65) & (a <= 90)).sum())


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f array<double>) of every whole text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            rows = np.array([features_of(t) for t in batch["text"].to_pylist()])
            f = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], f], ["doc_id", "f"])

    source = doc_texts(docs, id_col, text_col)
    return source.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, f array<double>").withColumn("doc_id", F.col("doc_id"))


def all_stats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, *RULE_STATS, *FEATURES) of every whole text, in one pass; null and empty texts count zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            texts = batch["text"].to_pylist()
            counts, values = zip(*map(rule_counts, texts), strict=True), zip(*map(features_of, texts), strict=True)
            columns = [*(pa.array(c, pa.int64()) for c in counts), *(pa.array(c, pa.float64()) for c in values)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *columns], ["doc_id", *RULE_STATS, *FEATURES])

    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join([f"{c} long" for c in RULE_STATS] + [f"{c} double" for c in FEATURES])
    return doc_texts(docs, id_col, text_col).mapInArrow(run, schema)

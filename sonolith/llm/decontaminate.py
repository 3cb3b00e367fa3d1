"""Benchmark decontamination: a generalised suffix automaton of normalised test items.

The automaton recognises every word sequence that occurs in an item. A document's words are
streamed through it; the state holds the longest sequence that ends at the current word and
occurs in an item, and its length tells whether a window of the contract ends here.
"""

from __future__ import annotations

import functools
import itertools
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: Words: digits, letters and whatever is not ASCII.
_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_A_Z = string.ascii_uppercase
_UPPER = str.maketrans({c: c + 32 for c in range(65, 91)})


def words_of(text: str) -> list[str]:
    """Words of a text with A-Z in lower case."""
    return _WORDS.findall(text.translate(_UPPER) if not text.isascii() else text.lower())


class Automaton:
    """Generalised suffix automaton over word numbers, with the windows that end in each state."""

    def __init__(self, items: list[tuple[object, list[str]]], window: int):
        self.window = window
        self.vocab: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in words]
            coded.append((item, ids))
            last = 0
            for w in ids:
                last = self._extend(last, w)
        #: state -> items with a window of full length that it stands for; (length, items) of equal short items
        self.full: dict[int, set] = {}
        self.short: dict[int, list[tuple[int, list]]] = {}
        alike: dict[tuple[int, ...], list] = {}
        for item, ids in coded:
            for state, n in self._walk(ids):
                if n >= window:
                    self.full.setdefault(self.cut(state, window), set()).add(item)
            if 0 < len(ids) < window:
                if tuple(ids) not in alike:
                    self.short.setdefault(state, []).append((len(ids), alike.setdefault(tuple(ids), [])))
                alike[tuple(ids)].append(item)
        self.shortest = min((min(len(ids), window) for _, ids in coded if ids), default=0)
        # a state also ends with what its suffix links end with
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            if above := self.short.get(self.link[state]):
                self.short[state] = self.short.get(state, []) + above

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: int, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = new
            p = self.link[p]
        return new

    def _walk(self, ids: list[int]) -> Iterator[tuple[int, int]]:
        """(state, longest matching length) after each word."""
        nxt, link, length = self.next, self.link, self.length
        state, n = 0, 0
        for w in ids:
            while state and w not in nxt[state]:
                state = link[state]
                n = length[state]
            if w in nxt[state]:
                state, n = nxt[state][w], n + 1
            yield state, n

    def cut(self, state: int, n: int) -> int:
        """The state of the last n words of a match."""
        while self.length[self.link[state]] >= n:
            state = self.link[state]
        return state

    def hits(self, words: list[str]) -> tuple[list[tuple[int, int]], set, int]:
        """Covered word spans (start, end exclusive), items with windows here, longest match."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        met: set = set()  # what has given its items already
        longest = 0
        get = self.vocab.get
        codes = np.array([get(w, -1) for w in words], np.int64)
        known = np.concatenate([[0], (codes >= 0).view(np.int8), [0]])
        edges = np.flatnonzero(np.diff(known))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a < self.shortest:
                continue
            for at, (state, n) in enumerate(self._walk(codes[a:b].tolist()), a + 1):
                longest = max(longest, n)
                reach = 0
                if n >= self.window:
                    reach = self.window
                    if (end := ~self.cut(state, self.window)) not in met:
                        met.add(end)
                        items |= self.full[~end]
                for size, found in self.short.get(state, ()):
                    if size <= n:
                        if id(found) not in met:
                            met.add(id(found))
                            items.update(found)
                        reach = max(reach, size)
                if reach:
                    start = at - reach
                    while spans and start <= spans[-1][1]:
                        start = min(start, spans.pop()[0])
                    spans.append((start, at))
        return spans, items, longest


def _blocks(items: DataFrame, id_col: str, text_col: str, max_words: int) -> Iterator[list[tuple[object, list[str]]]]:
    """The items in blocks of about `max_words` words by the hash of their texts, one block on the driver at a time."""
    known = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n_words = known.agg(F.sum(F.regexp_count(F.lower("text"), F.lit(_WORDS.pattern)))).first()[0] or 0
    parts = max(1, -(-n_words // max_words))
    for k in range(parts):
        some = known if parts == 1 else known.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k)
        yield [(r.id, words_of(r.text)) for r in some.collect()]


def _found(text: str, automaton: Automaton) -> tuple:
    """(n_words, n_hit, items, spans, longest) of one text."""
    words = words_of(text)
    spans, items, longest = automaton.hits(words)
    return len(words), sum(e - s for s, e in spans), sorted(items, key=lambda x: (x is None, x)), [{"start": s, "end": e} for s, e in spans], longest


def find(docs: DataFrame, items: DataFrame, *, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", max_words: int = 1_000_000) -> DataFrame:
    """Where windows of benchmark items occur in documents.

    Returns (doc_id, n_words, n_hit, items, spans, longest): spans are of word positions,
    ends exclusive; items are ids whose windows occur; longest is the longest sequence shared
    with any item. Ids may be of any type. Null texts have no words, items without words no
    windows; an item of fewer words than `window` is one window. An automaton holds at most
    about `max_words` words of items, which bounds what the driver and the tasks hold; a larger
    benchmark takes a pass over the texts for each block of items.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    doc_type, item_type = (t.schema[c].dataType.simpleString() for t, c in ((docs, id_col), (items, item_id_col)))
    schema = f"doc_id {doc_type}, th long, n_words long, n_hit long, items array<{item_type}>, spans array<struct<start:long,end:long>>, longest long"
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    names = ["n_words", "n_hit", "items", "spans", "longest"]

    def over(block: list, only_hits: bool) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(Automaton(block, window))
        ids = pa.list_(pa.array([i for i, _ in block if i is not None][:1] or [0]).type)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small_batches(batches, 4 << 20):
                rows = [_found(t, shared.value) for t in batch["text"].to_pylist()]
                types = [pa.int64(), pa.int64(), ids, pa.list_(span), pa.int64()]
                made = pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))], ["doc_id", "th", *names])
                yield made.filter(pc.greater(made["longest"], 0)) if only_hits else made

        return source.withColumn("th", F.xxhash64("text")).select("doc_id", "th", "text").mapInArrow(scan, schema)

    blocks = _blocks(items, item_id_col, item_text_col, max_words)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        return over(block, False).drop("th")
    # a row is known by its id and the hash of its text: equal rows have equal hits
    parts = [materialise(over(b, True), "hits") for b in itertools.chain([block, more], blocks)]
    hits = functools.reduce(DataFrame.union, parts).groupBy("doc_id", "th").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_set("items")).alias("items"), F.flatten(F.collect_set("spans")).alias("spans"), F.max("longest").alias("longest"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_union([(x["start"], x["end"]) for x in row]) for row in batch["spans"].to_pylist()]
            ids = [sorted(set(row), key=lambda x: (x is None, x)) for row in batch["items"].to_pylist()]
            columns = [batch["n_words"], pa.array([sum(e - s for s, e in row) for row in spans], pa.int64()), pa.array(ids, batch["items"].type), pa.array([[{"start": s, "end": e} for s, e in row] for row in spans], pa.list_(span)), batch["longest"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], *columns], ["doc_id", "th", *names])

    hits = hits.select("doc_id", "th", "n_words", F.lit(0).cast("long").alias("n_hit"), "items", "spans", "longest").mapInArrow(merge, schema)
    hits = hits.select(F.col("doc_id").alias("hit_id"), F.col("th").alias("hit_th"), *(F.col(c).alias(f"hit_{c}") for c in names[1:]))
    rows = source.select("doc_id", F.xxhash64("text").alias("th"), F.regexp_count(F.translate("text", _A_Z, _A_Z.lower()), F.lit(_WORDS.pattern)).cast("long").alias("n_words"))
    both = rows.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("th") == F.col("hit_th")), "left")
    empty = {"n_hit": F.lit(0).cast("long"), "items": F.array().cast(f"array<{item_type}>"), "spans": F.array().cast("array<struct<start:long,end:long>>"), "longest": F.lit(0).cast("long")}
    return both.select("doc_id", "n_words", *(F.coalesce(f"hit_{c}", empty[c]).alias(c) for c in names[1:]))


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def contaminated(n_hit, n_words, coverage: int = 20):
    """The contract's rule: some word is hit, and at least one in `coverage` words."""
    return (n_hit > 0) & (n_hit * coverage >= n_words)


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans (word positions) and what stands between them."""
    at = [m.span() for m in _WORDS.finditer(text.translate(_UPPER))]
    for s, e in reversed(spans):
        text = text[: at[s][0]] + text[at[e - 1][1] :]
    return text


def clean(docs: DataFrame, items: DataFrame, *, coverage: int = 20, longest: int | None = None, drop: bool = True, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", max_words: int = 1_000_000) -> DataFrame:
    """`docs` without contamination, with the same columns; repeated rows and null ids included.

    A document over the coverage limit, or with a shared sequence longer than `longest`
    words, is dropped, or with `drop=False` loses the hit spans. One pass over the texts, and
    as many more as a larger benchmark has blocks (see `find`).
    """
    blocks = _blocks(items, item_id_col, item_text_col, max_words)
    block, more = next(blocks), next(blocks, None)
    shared = docs.sparkSession.sparkContext.broadcast(Automaton(block, window)) if more is None else None
    columns, place = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            texts, stays = batch[text_col].to_pylist(), []
            for k, text in enumerate(texts):
                if shared is None:
                    spans, most = batch["_hit_spans"][k].as_py() or [], batch["_hit_longest"][k].as_py() or 0
                    n_words = len(words_of(text or "")) if spans else 0
                else:
                    n_words, _, _, spans, most = _found(text or "", shared.value)
                n_hit = sum(x["end"] - x["start"] for x in spans)
                over = contaminated(n_hit, n_words, coverage) or longest is not None and most > longest
                stays.append(not (over and drop))
                if over and not drop:
                    texts[k] = remove_spans(text, [(x["start"], x["end"]) for x in spans])
            kept = pa.RecordBatch.from_arrays(batch.columns[: len(columns)], columns)
            yield kept.filter(pa.array(stays)) if drop else kept.set_column(place, text_col, pa.array(texts, kept[text_col].type))

    if shared is not None:
        return docs.mapInArrow(run, docs.schema)
    # which row it is, by the id and the hash of the text; found again from the rows themselves
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    names = ["_hit_id", "_hit_th", "_hit_spans", "_hit_longest"]
    hits = find(docs.select(F.struct(F.col(id_col).alias("id"), th.alias("th")).alias(id_col), F.col(text_col)), items, window=window, id_col=id_col, text_col=text_col, item_id_col=item_id_col, item_text_col=item_text_col, max_words=max_words)
    hits = hits.where("longest > 0").select(F.col("doc_id.id").alias(names[0]), F.col("doc_id.th").alias(names[1]), F.col("spans").alias(names[2]), F.col("longest").alias(names[3])).dropDuplicates(names[:2])
    both = docs.join(hits, F.col(id_col).eqNullSafe(F.col("_hit_id")) & (th == F.col("_hit_th")), "left")
    return both.select(*docs.columns, *names[2:]).mapInArrow(run, docs.schema)

"""Best-fit packing: configuration linear program over the length histogram.

The pieces of all documents are counted by length (at most `capacity` counters). Where there
are more lengths than `most_classes`, neighbouring ones share a size class; a configuration is a
multiset of classes that fits a sequence. The covering program "fewest sequences so that each
class is covered" is solved by multiplicative weights, a knapsack dynamic program pricing the
best configurations in each round. As its solution nears the optimum slowly, it is moved to a
vertex of the program: its configurations enter a basis one by one, and the same dynamic program
prices further ones until the bound is reached. The vertex is rounded down, the configurations
are given real lengths, and what is left over goes by best fit into the gaps. All of that works
on groups of equal sequences, so its size depends on `capacity` alone, never on the number of
pieces. Spark then ranks the pieces of each length and looks each rank up in the plan.
"""

from __future__ import annotations

import bisect
import math
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import doc_texts, materialise, small_batches

#: Texts of these characters alone are normalised by lower() and split as the tokenizer does it.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u017f]*+")
#: The tokenizer's own splitting rule for lower-cased texts of these characters; fixed values.
_LETTER, _NUMBER = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", r"0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECES = re.compile(rf"[{_LETTER}]+|[{_NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTER}{_NUMBER}]+")


@cache
def _loaded(path: str) -> tuple:
    """The tokenizer, and which ids end a word; once for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    vocab = tokenizer.get_vocab()
    is_end = np.zeros(max(vocab.values()) + 1, bool)
    is_end[[k for w, k in vocab.items() if w.endswith("</w>")]] = True
    return tokenizer, is_end


class WordEncoder:
    """Encodes texts as `tokenizers` does, each distinct word once.

    Texts with characters or special-token strings for which that shortcut isn't proven
    to be exact go through the tokenizer whole.
    """

    def __init__(self, path: str, max_words: int = 400_000):
        self.max_words = max_words
        self.tokenizer, self.is_end = _loaded(path)
        self.reset()

    def reset(self) -> None:
        self.code: defaultdict[str, int] = defaultdict(count().__next__)
        self.known, self.ids, self.start = 0, np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self) -> None:
        """Encode the words met since the last call: joined by spaces, told apart by their last tokens."""
        fresh = list(islice(self.code, self.known, None))
        lines = [" ".join(fresh[k : k + 2000]) for k in range(0, len(fresh), 2000)]
        if not lines:
            return
        got = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)])
        ends = np.flatnonzero(self.is_end[got]) + 1
        if len(ends) != len(fresh):
            raise RuntimeError("the tokenizer doesn't mark word ends as expected")
        self.start = np.concatenate([self.start, ends + len(self.ids)])
        self.ids = np.concatenate([self.ids, got])
        self.known = len(self.code)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text."""
        if len(self.code) > self.max_words:
            self.reset()
        code = self.code
        codes: list[int] = []
        ends, whole = [], {}
        for k, t in enumerate(texts):
            if "<|" not in t and _PLAIN.fullmatch(t):
                codes += [code[w] for w in _PIECES.findall(t.lower())]
            else:
                whole[k] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
            ends.append(len(codes))
        self._learn()
        words = np.array(codes, np.int64)
        begin, length = self.start[words], self.start[words + 1] - self.start[words]
        upto = np.concatenate([[0], np.cumsum(length)])
        flat = self.ids[np.repeat(begin - upto[:-1], length) + np.arange(upto[-1])]
        cuts = [0, *upto[ends].tolist()]
        return [whole[k] if k in whole else flat[cuts[k] : cuts[k + 1]] for k in range(len(texts))]


def pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of at most `capacity` ids: (doc_id, piece, start, length, ids_crc32[, ids]).

    A null or empty text is `end_id` alone (no piece if that is None). Repeated rows give
    repeated pieces; other columns are ignored.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(tokenizer_path)
        for batch in small_batches(batches, 2 << 20):
            rows = []
            for doc, ids in zip(batch["doc_id"].to_pylist(), encoder.encode(batch["text"].to_pylist()), strict=True):
                if end_id is not None:
                    ids = np.append(ids, np.uint32(end_id))
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((doc, k, start, len(part), zlib.crc32(part.astype("<u4").tobytes())) + (part.astype("i4"),) * with_ids)
            cols = list(zip(*rows, strict=True)) or [()] * (5 + with_ids)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return doc_texts(docs, id_col, text_col).mapInArrow(cut, schema)


class _Group:
    """`count` equal sequences: the lengths in them, in order, and the room left."""

    __slots__ = ("count", "gap", "items")

    def __init__(self, count: int, gap: int, items: tuple):
        self.count, self.gap, self.items = count, gap, items


Configuration = tuple[tuple[int, ...], tuple[int, ...]]  # classes, and how many of each


def _knapsack(sizes: np.ndarray, price: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The best value for each room, and the class to take there (-1: leave a unit empty)."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1)
    fits = np.searchsorted(sizes, np.arange(room + 1), "right")
    for c in range(int(sizes[0]), room + 1):
        value = best[c - sizes[: fits[c]]] + price[: fits[c]]
        k = int(value.argmax())
        best[c] = max(best[c - 1], value[k])
        take[c] = k if value[k] > best[c - 1] else -1
    return best, take


def _priced(sizes: np.ndarray, price: np.ndarray, room: int, least: float) -> tuple[float, Iterator[Configuration]]:
    """The value of the best configuration, and for each class the best one that holds it, best first, down to `least` of that value."""
    best, take = _knapsack(sizes, price, room)
    value, left, active = price + best[room - sizes], room - sizes, np.arange(len(sizes))
    last = np.maximum.accumulate(np.where(take >= 0, np.arange(room + 1), 0))  # the next room below where a class is taken
    rows, cols = [active], [active]
    while len(active):
        c = last[left[active]]
        active, c = active[take[c] >= 0], c[take[c] >= 0]
        rows.append(active)
        cols.append(take[c])
        left[active] = c - sizes[take[c]]
    row, col = np.concatenate(rows), np.concatenate(cols)
    order = np.lexsort((col, row))
    col, cut = col[order], np.searchsorted(row[order], np.arange(len(sizes) + 1))

    def each() -> Iterator[Configuration]:
        for i in np.argsort(-value, kind="stable"):
            if value[i] < least * best[room]:
                return
            k, n = np.unique(col[cut[i] : cut[i + 1]], return_counts=True)
            yield tuple(k.tolist()), tuple(n.tolist())

    return float(best[room]), each()


def weigh_configurations(sizes: np.ndarray, need: np.ndarray, room: int, rounds: int = 40, epsilon: float = 0.1) -> dict[Configuration, float]:
    """Multiplicative weights: in each round near-best configurations are used a little and the prices of what they cover fall.

    sizes: the classes' sizes, ascending; need: how many items each has.
    """
    price = sizes / (sizes * need).sum()
    used: dict[Configuration, float] = {}
    for _ in range(rounds):
        _, found = _priced(sizes, price, room, 1 - epsilon)
        covered = np.zeros(len(sizes))
        for config in found:
            k, n = np.array(config[0]), np.array(config[1])
            if covered[k].max() < epsilon / 2:
                step = float((need[k] / n).min()) * epsilon
                used[config] = used.get(config, 0.0) + step
                covered[k] += step * n / need[k]
        price = price * np.exp(-3 * covered)
    return used


def solve_configurations(sizes: np.ndarray, counts: np.ndarray, room: int, gap: float = 5e-4, most_rounds: int = 200) -> tuple[list[tuple[Configuration, float]], float]:
    """A vertex of the covering program, as configurations and amounts, and a lower bound on the number of sequences.

    Starts from sequences of one class each; the configurations of `weigh_configurations`
    enter first, then those that the prices of the basis ask for, until the number of
    sequences is within `gap` of the bound or `most_rounds` are over: a few more sequences, as
    any basis covers all classes.
    """
    need, fit = counts.astype(float), room // sizes
    basis: list[Configuration] = [((i,), (int(n),)) for i, n in enumerate(fit)]
    inverse, amount, price = np.diag(1.0 / fit), need / fit, 1.0 / fit
    bound = float(need @ sizes) / room

    def enter(config: Configuration) -> bool:
        nonlocal price
        k, n = np.array(config[0]), np.array(config[1], float)
        gained = float(price[k] @ n) - 1
        if gained <= 1e-7:
            return False
        change = inverse[:, k] @ n
        ratio = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1.0), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            return False
        amount[:] = np.maximum(amount - ratio[out] * change, 0.0)
        amount[out] = ratio[out]
        row = inverse[out] / change[out]
        other = np.flatnonzero(np.abs(change) > 1e-12)
        inverse[other] -= change[other, None] * row
        inverse[out] = row
        price = price - gained * row
        basis[out] = config
        return True

    for config, _ in sorted(weigh_configurations(sizes, need, room).items(), key=lambda x: -x[1]):
        enter(config)
    for _ in range(most_rounds):
        valid = np.maximum(price, 0.0)
        best, found = _priced(sizes, valid, room, 1e-9)
        bound = max(bound, float((need * valid).sum() / best))
        if amount.sum() <= bound * (1 + gap):
            break
        if not sum(map(enter, islice(found, max(20, len(sizes) // 4)))):
            break
    return list(zip(basis, amount.tolist(), strict=True)), bound


def _classes(lengths: np.ndarray, most: int) -> np.ndarray:
    """The class of each length, named by its largest: neighbours within the smallest share that leaves `most` classes."""
    low, high = 0.0, 1.0
    name = lengths
    if len(lengths) <= most:
        return name
    for _ in range(20):
        share = (low + high) / 2
        made, top = [], 0
        for x in lengths[::-1].tolist():
            if not made or x < top * (1 - share):
                top = x
            made.append(top)
        found = np.array(made[::-1])
        if len(set(made)) <= most:
            high, name = share, found
        else:
            low = share
    return name


def plan(histogram: dict[int, int], capacity: int = 4096, most_classes: int = 640) -> tuple[np.ndarray, dict]:
    """Where the pieces of each length go, and figures on the solution.

    Returns rows (length, first rank, number, first sequence id, offset): of the pieces with
    that length, those with ranks from `first rank` on go one each to consecutive sequences.
    The solution is rounded three ways, with all of its configurations, those used twice or
    more, and none, and the way with the fewest sequences holds.
    """
    lengths = np.array(sorted(k for k, n in histogram.items() if n > 0), np.int64)
    if not len(lengths):
        return np.zeros((0, 5), np.int64), {"sequences": 0, "lower_bound": 0}
    name = _classes(lengths, most_classes)
    sizes = np.unique(name)
    members = {int(c): lengths[name == c].tolist() for c in sizes}  # ascending
    counts = np.array([sum(histogram[x] for x in members[int(c)]) for c in sizes])
    solution, bound = solve_configurations(sizes, counts, capacity)
    tried = [_rounded([x for x in solution if x[1] >= least], sizes, members, histogram, capacity) for least in (1, 2, math.inf)]
    groups = min(tried, key=lambda gs: sum(g.count for g in gs))
    rows: list[tuple[int, int, int, int, int]] = []
    rank, sequence = dict.fromkeys(lengths.tolist(), 0), 0
    for g in groups:
        offset = 0
        for x in g.items:
            rows.append((x, rank[x], g.count, sequence, offset))
            rank[x] += g.count
            offset += x
        sequence += g.count
    out = np.array(rows, np.int64)
    tokens = sum(k * n for k, n in histogram.items())
    return out[np.lexsort((out[:, 1], out[:, 0]))], {"sequences": sequence, "lower_bound": -(-tokens // capacity), "lp_bound_on_classes": bound, "classes": len(sizes), "groups": len(rows)}


def _rounded(solution: list[tuple[Configuration, float]], sizes: np.ndarray, members: dict[int, list[int]], histogram: dict[int, int], capacity: int) -> list[_Group]:
    """Sequences of the whole parts of a solution, and of the rest by best fit."""
    left = {int(k): int(n) for k, n in histogram.items() if n > 0}
    members = {c: [*xs] for c, xs in members.items()}
    groups: list[_Group] = []
    ordered = sorted(left)
    for (classes, times), amount in sorted(solution, key=lambda x: -x[1]):
        slots = [int(sizes[k]) for k, n in zip(reversed(classes), reversed(times), strict=True) for _ in range(n)]
        number = min([int(amount + 1e-9), *(sum(left[x] for x in members[c]) // slots.count(c) for c in set(slots))])
        todo = [_Group(number, capacity, ())] if number > 0 else []
        for k, c in enumerate(slots):
            done = []
            for g in todo:
                # the last one may be longer by what the others of its sequence are shorter than their classes
                spare = sum(slots[:k]) - sum(g.items) if k == len(slots) - 1 else 0
                while g.count:
                    x = _longest(ordered, left, c + spare) if spare else 0
                    if x <= c:
                        while members[c] and not left[members[c][-1]]:
                            members[c].pop()
                        x = members[c][-1] if members[c] else 0
                    if not x:
                        done.append(_Group(g.count, g.gap, g.items))
                        break
                    n = min(g.count, left[x])
                    done.append(_Group(n, g.gap - x, (*g.items, x)))
                    left[x] -= n
                    g.count -= n
            todo = done
        groups += todo
    return _best_fit(groups, left, capacity)


def _longest(ordered: list[int], left: dict[int, int], most: int) -> int:
    """The longest length up to `most` of which some are left; those used up go from `ordered`."""
    at = bisect.bisect_right(ordered, most) - 1
    while at >= 0 and not left[ordered[at]]:
        ordered.pop(at)
        at -= 1
    return ordered[at] if at >= 0 else 0


def _best_fit(groups: list[_Group], left: dict[int, int], capacity: int) -> list[_Group]:
    """What the rounding left over: largest first, each into the smallest gap that holds it, else into a new sequence."""
    gaps: dict[int, list[_Group]] = {}
    for g in groups:
        if g.count and g.items:
            gaps.setdefault(g.gap, []).append(g)
    order = sorted(gaps)

    def put(g: _Group) -> None:
        if g.gap not in gaps:
            gaps[g.gap] = []
            bisect.insort(order, g.gap)
        gaps[g.gap].append(g)

    for x in sorted((k for k, n in left.items() if n), reverse=True):
        while left[x]:
            at = bisect.bisect_left(order, x)
            if at == len(order):
                fit = capacity // x
                full, rest = divmod(left[x], fit)
                if full:
                    put(_Group(full, capacity - fit * x, (x,) * fit))
                if rest:
                    put(_Group(1, capacity - rest * x, (x,) * rest))
                left[x] = 0
                continue
            gap = order[at]
            g = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
                order.pop(at)
            each = min(gap // x, left[x])
            some = min(g.count, left[x] // each)
            put(_Group(some, gap - each * x, g.items + (x,) * each))
            if some < g.count:
                put(_Group(g.count - some, gap, g.items))
            left[x] -= some * each
    return [g for gs in gaps.values() for g in gs]


def pack(parts: DataFrame, *, capacity: int = 4096, deals: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to `parts` (doc_id, piece, length, any more columns).

    `parts` is read twice, so pass a materialised table. A length that many pieces share is
    ranked in `deals` parts by a hash of the document, so no task sorts a whole hot length.
    Ties and repeated rows get ranks of their own; an empty table gives an empty one.
    The plan that all tasks get has a few rows for each of `capacity` lengths at most.
    """
    parts = parts.withColumn("_deal", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(deals)).cast("int"))
    counts = parts.groupBy("length", "_deal").agg(F.count("*").alias("_n"))
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("_n")).collect()}  # <= capacity rows
    table, _ = plan(histogram, capacity)
    shared = parts.sparkSession.sparkContext.broadcast(table)
    first = counts.withColumn("_first", F.sum("_n").over(Window.partitionBy("length").orderBy("_deal")) - F.col("_n")).drop("_n")
    local = F.row_number().over(Window.partitionBy("length", "_deal").orderBy("doc_id", "piece")) - 1
    ranked = parts.withColumn("_local", local).join(first, ["length", "_deal"]).withColumn("_rank", F.col("_first") + F.col("_local"))
    kept = [c for c in parts.columns if c != "_deal"]
    ranked = ranked.select(*kept, "_rank")
    schema = ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        lo = np.searchsorted(rows[:, 0], np.arange(capacity + 2))
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for batch in batches:
            if batch.num_rows:
                n, rank = (pc.cast(batch[c], pa.int64()).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
                at = np.maximum(np.searchsorted(keys, (n << 44) + rank, "right") - 1, lo[n])
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in kept), pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])], [*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = 4096, **more) -> DataFrame:
    """Cut documents into token pieces and pack them; see `pieces` and `pack`."""
    return pack(materialise(pieces(docs, tokenizer_path, capacity=capacity, **more), "pieces"), capacity=capacity)

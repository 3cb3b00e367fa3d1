"""LM scoring with a probabilistic suffix tree over words.

Contexts of one word and longer that occur `min_count` times are candidates, so that their
number grows with the corpus. They are retained where a divergence test finds that they predict
the next word better than their longest retained suffix does, as it is smoothed. A context keeps
the next words that it has seen `min_follow` times; what all others had goes to the suffix's
distribution, down to add-one word frequencies. A text is scored by the longest retained
suffix at each token.

The corpus is encoded once into blocks (word codes and the 64-bit hashes of the block's words,
whose collisions are too rare to matter: about V * V / 2**65 for V distinct words). Counts are
made in each block with numpy and summed in a shuffle. To score, the distinct words of a block
are joined with their counts, and a block's codes meet them in one group. The driver and every
task hold the contexts, all that occur often enough; where a caller gives `max_contexts`, the least
count of a length is doubled until its contexts fit. The counts of next words are broadcast up to `max_pairs` of them; beyond that
each block asks for those it needs, in a join.
"""

from __future__ import annotations

import functools
import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, materialise, small_batches

#: Stands for the end token; no word holds a newline.
_END = b"\n"
BLOCK_BYTES = 16 << 20


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of whole documents: (block, doc_ids, held, lens, codes, words).

    codes: the block's tokens as little-endian uint32 numbers of entries of `words`, the
    64-bit hashes of its words. Null texts are empty: an end token alone.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(held_out(id_col, modulus, remainder), F.lit(False)).alias("held"))
    source = source.withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = itertools.count()
        ids, held, lens, codes, size, part = [], [], [], [], 0, 0
        id_type = None
        code: dict[bytes, int] = defaultdict(itertools.count().__next__)

        def block() -> pa.RecordBatch:
            words = np.array([xxhash.xxh64_intdigest(w) for w in code], np.uint64).view(np.int64)
            row = ([(part << 33) + next(number)], [ids], [held], [lens], [np.concatenate(codes).tobytes()], [words])
            types = (pa.int64(), pa.list_(id_type), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types, strict=True)], ["block", "doc_ids", "held", "lens", "codes", "words"])

        for batch in small_batches(batches, 4 << 20):
            part, id_type = batch["part"][0].as_py(), batch["doc_id"].type
            flat: list[int] = []
            for text in batch["text"].to_pylist():
                words = text.encode().lower().split()
                flat += [code[w] for w in words]
                flat.append(code[_END])
                lens.append(len(words) + 1)
                size += len(text)
            codes.append(np.array(flat, "<u4"))
            ids += batch["doc_id"].to_pylist()
            held += batch["held"].to_pylist()
            if size >= block_bytes:
                yield block()
                ids, held, lens, codes, size = [], [], [], [], 0
                code = defaultdict(itertools.count().__next__)
        if lens:
            yield block()

    return source.mapInArrow(run, f"block long, doc_ids array<{docs.schema[id_col].dataType.simpleString()}>, held array<boolean>, lens array<int>, codes binary, words array<long>")


@dataclass
class Tree:
    """Contexts and their smoothing; state 0 is the root.

    steps[d] maps (candidate of d words, next word) to a candidate of d + 1 words, as sorted
    keys and values. By state: `seen`, the occurrences of the next words it keeps, and `escape`,
    the weight of its suffix's distribution; `kept` tells retained ones.
    """

    n: int
    v: int
    heads: np.ndarray  # hashes of the one-word contexts, sorted
    steps: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    seen: np.ndarray = field(default_factory=lambda: np.zeros(1))
    escape: np.ndarray = field(default_factory=lambda: np.zeros(1))
    kept: np.ndarray = field(default_factory=lambda: np.zeros(1, bool))
    depth: int = 0

    def base(self, c):
        return (c + 1) / (self.n + self.v + 1)

    def states(self, words: np.ndarray, codes: np.ndarray, begin: np.ndarray, depth: int) -> Iterator[np.ndarray]:
        """For d = 1 .. depth: the candidate of d words that ends before each token, or 0."""
        at = np.searchsorted(self.heads, words)
        at[at == len(self.heads)] = 0
        head = np.where(self.heads[at] == words, at + 1, 0) if len(self.heads) else np.zeros(len(words), np.int64)
        head = head[codes]  # number of a token's word among the one-word contexts
        here = head.copy()  # one-word contexts are states 1 .. len(heads)
        for d in range(1, depth + 1):
            if d > 1:
                keys, values = self.steps[d - 2]
                last = np.concatenate([[0], here[:-1]])
                last[begin] = 0
                key = last * (len(self.heads) + 1) + head
                at = np.searchsorted(keys, key)
                at[at == len(keys)] = 0
                here = np.where((last > 0) & (head > 0) & (keys[at] == key), values[at], 0) if len(keys) else np.zeros(len(head), np.int64)
            before = np.concatenate([[0], here[:-1]])
            before[begin] = 0
            yield before


def _begin(lens: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)


def _counts(blocks: DataFrame, tree: Tree | None, depth: int) -> DataFrame:
    """(t, s, n): how often word t follows state s of `depth` words in training texts."""
    shared = blocks.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                held, lens, words = (np.asarray(batch[c][row].values.to_numpy(zero_copy_only=False)) for c in ("held", "lens", "words"))
                codes = np.frombuffer(batch["codes"][row].as_buffer(), "<u4").astype(np.int64)
                use = np.repeat(~held, lens)
                state = np.zeros(len(codes), np.int64)
                if depth:
                    *_, state = shared.value.states(words, codes, _begin(lens), depth)
                    use &= state > 0
                key, n = np.unique(state[use] * len(words) + codes[use], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words[key % len(words)]), pa.array((key // len(words)).astype(np.int32)), pa.array(n)], ["t", "s", "n"])

    partial = blocks.select("held", "lens", "codes", "words").mapInArrow(run, "t long, s int, n long")
    return partial.groupBy("t", "s").agg(F.sum("n").alias("n"))


def _fitting(counts: DataFrame, column: str, least: int, room: int | None) -> int:
    """`least`, doubled until at most `room` rows of `counts` have so much in `column`; as it is without a limit."""
    while room is not None and counts.where(F.col(column) >= least).count() > room:
        least *= 2
    return least


def _rows(df: DataFrame, *columns: str) -> Iterator[tuple]:
    """Rows of a bounded table, by way of Arrow: a list of Row objects takes ten times the memory."""
    table = df.select(*columns).toArrow()
    return zip(*(table[c].to_pylist() for c in columns), strict=True)


def _table(spark: SparkSession, **columns: tuple[pa.DataType, Iterable]) -> DataFrame:
    """A table of columns given as (type, values)."""
    return spark.createDataFrame(pa.table([pa.array(list(values), kind) for kind, values in columns.values()], names=list(columns)))


def learn(blocks: DataFrame, *, min_count: int = 256, min_follow: int = 8, max_depth: int = 4, least_gain: float = 0.01, max_contexts: int | None = None) -> tuple[Tree, DataFrame, DataFrame]:
    """The tree, the counts (t, c) of every training word, and those of next words (s, t, n) of the retained contexts.

    least_gain: nats a token by which a context has to beat its longest retained suffix,
    measured with each occurrence left out of its own estimate.
    """
    spark = blocks.sparkSession
    words = materialise(_counts(blocks, None, 0).select("t", F.col("n").alias("c")), "words")
    n, v = (x or 0 for x in words.agg(F.sum("c"), F.count("*")).first())
    end = int(np.uint64(xxhash.xxh64_intdigest(_END)).view(np.int64))
    often = words.where(F.col("t") != end)
    often = often.where(F.col("c") >= _fitting(often, "c", min_count, None if max_contexts is None else max_contexts // 2))
    total = dict(sorted(_rows(often, "t", "c")))
    tree = Tree(n, v, np.array(list(total), np.int64))
    number = {h: k for k, h in enumerate(total, 1)}
    context, parent, occurs = [(), *((h,) for h in total)], [-1, *[0] * len(total)], [0, *total.values()]
    known = {c: k for k, c in enumerate(context)}
    longest = [0] * len(context)  # the longest retained proper suffix
    seen, escape, kept = {}, {}, set()
    base = words.select(F.lit(0).alias("s"), "t", ((F.col("c") + 1) / F.lit(float(n + v + 1))).alias("p"))
    smooth, pairs, first = base, [], 1
    heads = F.broadcast(_table(spark, t=(pa.int64(), total)))
    for depth in range(1, max_depth + 1):
        if first == len(context):
            break
        table = materialise(_counts(blocks, tree, depth).where(F.col("n") >= min_follow), f"follows{depth}")
        for s, c, k in _rows(table.groupBy("s").agg(F.sum("n").alias("c"), F.count("*").alias("k")), "s", "c", "k"):
            seen[s], escape[s] = c, occurs[s] - c + k
        level = [s for s in range(first, len(context)) if s in seen]
        numbers = {name: (pa.float64(), [of[s] for s in level]) for name, of in (("cs", seen), ("es", escape), ("total", occurs))}
        about = _table(spark, s=(pa.int32(), level), up=(pa.int32(), [longest[s] for s in level]), **numbers)
        rows = table.join(F.broadcast(about), "s").join(smooth.select("t", F.col("s").alias("up"), "p"), ["t", "up"])
        alone = (F.col("n") - 1 + F.col("es") * F.col("p")) / (F.col("cs") - 1 + F.col("es"))
        others = (F.first("total") - F.first("cs")) * F.log(F.first("es") / (F.first("cs") + F.first("es")))
        rows = materialise(rows.select("s", "t", "n", "cs", "es", "total", "p", alone.alias("alone")), f"tested{depth}")
        gain = rows.groupBy("s").agg(((F.sum(F.col("n") * F.log(F.col("alone") / F.col("p"))) + others) / F.first("total")).alias("gain"))
        good = [s for (s,) in _rows(gain.where(F.col("gain") >= least_gain), "s")]
        kept.update(good)
        if good:
            mine = rows.join(F.broadcast(_table(spark, s=(pa.int32(), good))), "s")
            smooth = smooth.unionByName(mine.select("s", "t", ((F.col("n") + F.col("es") * F.col("p")) / (F.col("cs") + F.col("es"))).alias("p")))
            pairs.append(mine.select("s", "t", "n"))
        if depth == max_depth:
            break
        # longer candidates: this context and one more word, whose own suffix is a candidate
        room = None if max_contexts is None else max_contexts - len(context)
        grown = table.join(heads, "t")
        grown = grown.where(F.col("n") >= _fitting(grown, "n", min_count, room)).select("s", "t", "n")
        grown = sorted((s * (len(total) + 1) + number[t], (*context[s], t), c) for s, t, c in _rows(grown, "s", "t", "n") if (*context[s], t)[1:] in known)
        first = len(context)
        tree.steps.append((np.array([g[0] for g in grown], np.int64), np.arange(first, first + len(grown))))
        for _, words_of, c in grown:
            up = known[words_of[1:]]
            known[words_of] = len(context)
            context.append(words_of)
            parent.append(up)
            occurs.append(c)
            longest.append(up if up in kept else longest[up])
    tree.seen, tree.escape, tree.kept = np.zeros(len(context)), np.zeros(len(context)), np.zeros(len(context), bool)
    for s in kept:
        tree.seen[s], tree.escape[s], tree.kept[s] = seen[s], escape[s], True
    tree.depth = max((len(context[s]) for s in kept), default=0)
    none = spark.createDataFrame([], "s int, t long, n long")
    return tree, words, materialise(functools.reduce(DataFrame.unionByName, pairs, none), "pairs")


def _packed(rows: DataFrame, names: tuple[str, ...], most: int = 1_000_000) -> DataFrame:
    """(of, names...): the numbers in the columns `names` of each block `of`, as compressed int64 arrays.

    Packing before the shuffle to the blocks leaves a few bytes a row of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            of, *columns = (np.concatenate([b[k].to_numpy(zero_copy_only=False) for b in held]) for k in ("of", *names))
            order = np.argsort(of, kind="stable")
            cut = np.concatenate([[0], np.flatnonzero(np.diff(of[order])) + 1, [len(of)]])
            packed = [[zlib.compress(c[order[i:j]].astype("<i8").tobytes(), 1) for i, j in itertools.pairwise(cut)] for c in columns]
            return pa.RecordBatch.from_arrays([pa.array(of[order[cut[:-1]]]), *(pa.array(x, pa.binary()) for x in packed)], ["of", *names])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= most:
                yield emit()
                held, size = [], 0
        if held:
            yield emit()

    return rows.select("of", *names).mapInArrow(run, "of long, " + ", ".join(f"{x} binary" for x in names))


def _key_of(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """A 64-bit key of a context and a word; t holds the words' hashes."""
    with np.errstate(over="ignore"):
        return t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (s.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)


def _asked_pairs(blocks: DataFrame, tree: Tree) -> DataFrame:
    """(of, s, code, t): the distinct retained contexts and next words of each block."""
    shared = blocks.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = shared.value
        for batch in batches:
            for row in range(batch.num_rows):
                lens, words = (np.asarray(batch[c][row].values.to_numpy(zero_copy_only=False)) for c in ("lens", "words"))
                codes = np.frombuffer(batch["codes"][row].as_buffer(), "<u4").astype(np.int64)
                for state in tree.states(words, codes, _begin(lens), tree.depth):
                    on = tree.kept[state]
                    key = np.unique(state[on] * len(words) + codes[on])
                    of = np.full(len(key), batch["block"][row].as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(of), pa.array((key // len(words)).astype(np.int32)), pa.array(key % len(words)), pa.array(words[key % len(words)])], ["of", "s", "code", "t"])

    return blocks.select("block", "lens", "codes", "words").mapInArrow(run, "of long, s int, code long, t long")


def score_blocks(blocks: DataFrame, tree: Tree, words: DataFrame, pairs: DataFrame, max_pairs: int = 1_500_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, score) of every document."""
    asked = blocks.select(F.col("block").alias("of"), F.posexplode("words").alias("code", "t"))
    known = _packed(asked.join(words, "t"), ("code", "c"))
    empty = F.lit(None).cast("binary")
    near = None
    if pairs.count() <= max_pairs:
        near = pairs.toArrow()
        key, times = _key_of(near["s"].to_numpy(), near["t"].to_numpy()), near["n"].to_numpy()
        order = np.argsort(key)
        near = (key[order], times[order])  # 16 bytes a pair
        known = known.select("of", "code", "c", *(empty.alias(x) for x in ("s", "follow", "n")))
    elif tree.depth:
        of_block = _packed(_asked_pairs(blocks, tree).join(pairs, ["s", "t"]).withColumnRenamed("code", "follow"), ("s", "follow", "n"))
        known = known.select("of", "code", "c", *(empty.alias(x) for x in ("s", "follow", "n"))).unionByName(of_block.select("of", empty.alias("code"), empty.alias("c"), "s", "follow", "n"))
    shared = blocks.sparkSession.sparkContext.broadcast((tree, near))
    schema = f"doc_id {blocks.schema['doc_ids'].dataType.elementType.simpleString()}, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    none = {"doc_id": pa.null(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}

    def unpacked(table: pa.Table, column: str) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(zlib.decompress(x), "<i8") for x in table[column].to_pylist() if x is not None)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        tree, near = shared.value
        out = []
        code, count, s, follow, n = (unpacked(right, x) for x in ("code", "c", "s", "follow", "n"))
        for row in range(left.num_rows):
            held, lens, words = (left[c][row].values.to_numpy(zero_copy_only=False) for c in ("held", "lens", "words"))
            codes = np.frombuffer(left["codes"][row].as_buffer(), "<u4").astype(np.int64)
            keys, times = near if near is not None else (_key_of(s, words[follow]), n)
            if near is None:
                order = np.argsort(keys)
                keys, times = keys[order], times[order]
            c = np.zeros(len(words), np.int64)
            c[code] = count
            base = tree.base(c)[codes]
            p = base.copy()
            if tree.depth and len(keys):
                for state in tree.states(words, codes, _begin(lens), tree.depth):
                    on = np.flatnonzero(tree.kept[state])
                    at = state[on]
                    pair, back = np.unique(at * len(words) + codes[on], return_inverse=True)  # a pair is looked up once
                    want = _key_of(pair // len(words), words[pair % len(words)])
                    place = np.searchsorted(keys, want)
                    place[place == len(keys)] = 0
                    got = np.where(keys[place] == want, times[place], 0)[back]
                    p[on] = (got + tree.escape[at] * p[on]) / (tree.seen[at] + tree.escape[at])
            begin = _begin(lens)
            total = [np.add.reduceat(x, begin) for x in (np.log10(base), np.log10(p), (c[codes] > 0).astype(np.int64))]
            out.append(pa.table([left["doc_ids"][row].values, pa.array(held), pa.array(lens.astype(np.int64)), pa.array(total[2]), pa.array(total[0]), pa.array(total[1])], list(none)))
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], t) for k, t in none.items()}).slice(0, 0)

    return blocks.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(run, schema)


def train_and_score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2, block_bytes: int = BLOCK_BYTES, max_pairs: int = 1_500_000, **more) -> DataFrame:
    """Scores of every whole text; learns from those whose crc32(id) mod `modulus` isn't `remainder`.

    Returns (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score). Words are
    lower-cased (A-Z) and end with one end token a text, so that a null or empty text has one
    token. Repeated rows are counted and scored each; a null id counts as training.
    """
    blocks = materialise(encode(docs, id_col=id_col, text_col=text_col, modulus=modulus, remainder=remainder, block_bytes=block_bytes), "blocks")
    tree, words, pairs = learn(blocks, **more)
    scored = score_blocks(blocks, tree, words, pairs, max_pairs)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tree.n).cast("long").alias("train_tokens"), "base_score", "score")

"""How the sources of each language differ in their words: all pairs of sources, and the words that set each apart.

The words of a language are dealt to blocks and its sources to an even number of slots. The vectors
of a slot's sources over a block stay where they are; those of other slots come by, compressed, in
the rounds of a round-robin tournament, and each meeting gives both directions of all its pairs.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, small_batches

#: Shares are in so many parts, rounded down, plus one.
PARTS = 1_000_000_000
#: Counts that a task holds before it passes them on.
HELD = 400_000
#: Bytes to term bytes: A-Z in lower case, all else that is neither a letter nor beyond ASCII becomes a space.
TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def shares(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """1 + floor(PARTS * count / whole) by long division, three digits at a time: exact below 2^53."""
    digits, rest = divmod(count, whole)
    for _ in range(3):
        more, rest = divmod(rest * 1000, whole)
        digits = digits * 1000 + more
    return digits + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q); exact, since shares are at most PARTS + 1."""
    return (p - q) ** 2 // q


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", most: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, and a row without a term for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, seen) in held.items():
                size = len(n) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array([None, *n], pa.binary()).cast(pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(seen[t] for t in n)], pa.int64())],
                    names=["lang", "source", "term", "n", "docs"],
                )
            held.clear()

        entries = 0
        for batch in small_batches(batches, 4 << 20):
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                n, seen = held.setdefault((lang, source), (Counter(), Counter()))
                terms, before = text.translate(TERM_BYTES).split(b" "), len(n)
                n.update(terms)
                del n[b""]
                one = set(terms)
                one.discard(b"")
                seen.update(one)
                entries += len(n) - before
                if entries > most:
                    yield from passed_on()
                    entries = 0
        yield from passed_on()

    plain = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang_col), ("source", source_col), ("text", text_col))))
    counted = plain.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def packed(sources: list[str], p: np.ndarray) -> bytes:
    """Sources and their shares over a block, as a compressed Arrow message."""
    batch = pa.RecordBatch.from_arrays([pa.array([json.dumps(sources)]), pa.array([p.reshape(-1)], pa.list_(pa.int32() if p.max(initial=0) < 1 << 31 else pa.int64()))], names=["sources", "p"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(message: bytes) -> tuple[list[str], np.ndarray]:
    batch = pa.ipc.open_stream(message).read_next_batch()
    sources = json.loads(batch.column(0)[0].as_py())
    return sources, batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(sources), -1)


def meeting(a: tuple[list[str], np.ndarray], b: tuple[list[str], np.ndarray] | None = None) -> tuple[list[str], list[str], list[int]]:
    """Sums over a block for all ordered pairs between two slots, or within one: sources, peers, values."""
    sources, peers, values = [], [], []
    for k, x in enumerate(a[0]):
        others, first = (a, k + 1) if b is None else (b, 0)
        for j in range(first, len(others[0])):
            p, q = a[1][k], others[1][j]
            squared = (p - q) ** 2
            sources += [x, others[0][j]]
            peers += [others[0][j], x]
            values += [int((squared // q).sum()), int((squared // p).sum())]
    return sources, peers, values


BLOCK = "lang string, block int, slot int, slots int, part string, source string, item string, value long, message binary"
NAMES = [x.split()[0] for x in BLOCK.split(", ")]


def _rows(n: int, **columns) -> pa.RecordBatch:
    """`n` rows of BLOCK; a column is a list, one value for all rows, or null."""
    kinds = {"block": pa.int32(), "slot": pa.int32(), "slots": pa.int32(), "value": pa.int64(), "message": pa.binary()}
    full = lambda x: x if isinstance(x, list) else [x] * n
    return pa.RecordBatch.from_arrays([pa.array(full(columns.get(c)), kinds.get(c, pa.string())) for c in NAMES], names=NAMES)


def _settle(top: int):
    """Of a block's entries of one slot: its vectors, packed; the pairs within; and the best `top` terms of each source."""

    def run(table: pa.Table) -> pa.Table:
        head = table.filter(pa.compute.is_null(table["id"])).sort_by("source")
        at = {c: head[c][0].as_py() for c in ("lang", "block", "slot", "slots", "n_lang", "n_terms", "n_block")}
        place = {c: at[c] for c in ("lang", "block", "slot", "slots")}
        sources, whole = head["source"].to_pylist(), head["n_source"].to_numpy() + at["n_terms"]
        p = np.repeat(shares(np.ones(len(sources), np.int64), np.maximum(whole, 1))[:, None], at["n_block"], axis=1)
        found = []
        entries = table.filter(pa.compute.is_valid(table["id"]))
        if entries.num_rows:
            group = pa.compute.index_in(entries["source"], head["source"].combine_chunks()).to_numpy()
            own = shares(entries["n"].to_numpy() + 1, whole[group])
            p[group, entries["id"].to_numpy()] = own
            all_ = shares(entries["total"].to_numpy() + 1, at["n_lang"] + at["n_terms"])
            above = np.flatnonzero(own > all_)
            value = gaps(own[above], all_[above])
            terms = entries["term"].combine_chunks().cast(pa.binary()).take(pa.array(above)).to_pylist()
            order = np.argsort(group[above], kind="stable")
            ends = np.searchsorted(group[above][order], np.arange(len(sources) + 1))
            for k, source in enumerate(sources):
                best = heapq.nsmallest(top, ((-int(value[j]), terms[j]) for j in order[ends[k] : ends[k + 1]]))
                found.append(_rows(len(best), part="term", source=source, item=[t.decode() for _, t in best], value=[-v for v, _ in best], **place))
        ours, peers, values = meeting((sources, p))
        found.append(_rows(len(ours), part="pair", source=ours, item=peers, value=values, **place))
        found.append(_rows(1, part="vector", message=packed(sources, p), **place))
        return pa.Table.from_batches(found)

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, here, comes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sources, peers, values = meeting(unpacked(here), unpacked(comes))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(sources), pa.string()), pa.array(sources, pa.string()), pa.array(peers, pa.string()), pa.array(values, pa.int64())], names=["lang", "source", "item", "value"])


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, per_slot: int = 8, block_terms: int = 32_768, block_entries: int = 100_000, held: int = HELD, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Divergence of every ordered pair of a language's sources, and the best `top` terms of each source against its language.

    Terms are runs of ASCII letters, in lower case, and of characters beyond ASCII; a language keeps
    those in at least `min_docs` of its documents. A group's share of a term is
    p = 1 + floor(10^9 (count + 1) / (N + V)), and a term's value floor((p - q)^2 / q). All is
    integer arithmetic.

    Returns lang, source, part, item, value, rank. `pair`: item is another source of the language
    and value the sum over all V kept terms, those that neither has included. `term`: item is a
    kept term that the source has, with p above the language's q. Ranks run from 1 for each source
    and part, by value descending, then by the item's bytes.

    A block holds at most about `block_terms` terms and `block_entries` counts of a slot, and a slot
    `per_slot` sources on average, so that a task's memory depends on these alone; the number of
    blocks and of rounds follows from the data. A hot source or language is more counts for more
    tasks, since counts are summed before they are shuffled.

    Null text, lang or source count as ''. A language without kept terms has pairs of value 0 and no
    terms; one with a single source has no pairs; an empty table gives no rows. Repeated rows count
    as documents. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    counts = materialise(term_counts(docs, lang_col, source_col, text_col, held), "terms")
    groups = counts.where("term is null").select("lang", "source")
    kept = materialise(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"), F.count("*").alias("spread")).where(F.col("docs") >= min_docs).drop("docs"), "kept")
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_sources")).join(kept.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("total").alias("n_lang"), F.sum("spread").alias("entries")), "lang", "left").fillna(0)
    langs = langs.withColumn("slots", (2 * F.ceil(F.col("n_sources") / (2 * per_slot))).cast("int"))
    blocks = F.greatest(F.ceil(F.col("n_terms") / block_terms), F.ceil(F.col("entries") / (F.col("slots") * block_entries)), F.lit(1))
    langs = materialise(langs.withColumn("blocks", blocks.cast("int")).drop("entries"), "langs")

    dealt = kept.join(langs.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int"))
    dealt = dealt.select("lang", "term", "total", "block", (F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1).alias("id"))
    dealt = materialise(dealt, "dealt")
    entries = materialise(counts.where("term is not null").join(dealt, ["lang", "term"]).select("lang", "source", "term", "n", "total", "block", "id"), "entries")
    slot = F.pmod(F.xxhash64("source"), "slots").cast("int")
    heads = groups.join(entries.groupBy("lang", "source").agg(F.sum("n").alias("n_source")), ["lang", "source"], "left").join(langs, "lang").fillna(0, ["n_source"])
    heads = heads.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(dealt.groupBy("lang", "block").agg(F.count("*").alias("n_block")), ["lang", "block"], "left").fillna(0, ["n_block"])
    heads = heads.select("lang", "source", "block", slot.alias("slot"), "slots", "n_source", "n_lang", "n_terms", "n_block")
    rows = heads.unionByName(entries.join(langs.select("lang", "slots"), "lang").withColumn("slot", slot), allowMissingColumns=True)
    settled = materialise(rows.groupBy("lang", "block", "slot").applyInArrow(_settle(top), BLOCK), "settled")

    # circle method: the last slot stays, the others turn; of each two that meet the lower one is at home
    vectors = settled.where("part = 'vector'").select("lang", "block", "slot", "slots", "message")
    home = vectors.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lang", "block", "slot").persist(StorageLevel.DISK_ONLY)
    sums = settled.where("part = 'pair'").select("lang", "source", "item", "value")
    rounds = (langs.agg(F.max("slots")).first()[0] or 1) - 1
    for r in range(rounds):
        turn = F.expr(f"pmod({2 * r} - slot, slots - 1)")
        peer = F.when(F.col("slot") == F.col("slots") - 1, F.lit(r)).when(turn == F.col("slot"), F.col("slots") - 1).otherwise(turn)
        guests = vectors.where(F.col("slots") - 1 > r).withColumn("peer", peer).where("peer < slot").select("lang", "block", F.col("peer").alias("slot"), F.col("message").alias("comes"))
        met = home.join(guests, ["lang", "block", "slot"]).select("lang", "message", "comes").mapInArrow(_meet, "lang string, source string, item string, value long")
        sums = sums.union(materialise(met.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "round"))
    home.unpersist()

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    terms = settled.where("part = 'term'").select("lang", "source", "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))

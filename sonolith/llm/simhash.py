"""SimHash near-duplicates with deletion-variant signatures.

Fingerprints of 64 bits are cut into two segments of 32. Of two fingerprints that differ in
at most two bits, one segment differs in at most one. So each segment is indexed under its 32
one-wildcard variants (one bit left out), equal variants are joined, and a pair is verified
by its number of differing bits. Equal fingerprints are one node from the start.

A variant that many fingerprints share would give all pairs of them. Such a variant is
refined instead by what the other segment may still differ by: fingerprints that agree in all
but one wildcard bit of each segment, or in one segment and up to a wildcard flip in the
other, are within two bits by construction, so each joins the smallest of its refined group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, materialise, small_batches
from .components import components

_BITS = np.arange(64, dtype=np.uint64)


def fingerprint(text: str, width: int = 3) -> int:
    """SimHash of `width`-word shingles, repeats included; 0 for a text without words."""
    words = text.encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << _BITS[ones * 2 > len(h)]).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, *, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long. Null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 4 << 20):
            fps = np.array([fingerprint(t, width) for t in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return doc_texts(docs, id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long")


def _segment(fp, k: int):
    """Segment k (0: low, 1: high) as a long of 32 bits."""
    return fp.bitwiseAND(F.lit(0xFFFFFFFF)) if k == 0 else F.shiftrightunsigned(fp, 32)


def _shift(value, bits):
    return F.call_function("shiftleft", value, bits)


def _wild(value, bit):
    """A segment without one bit, with that bit's number: the key of a one-wildcard variant."""
    return value.bitwiseAND(F.bitwise_not(_shift(F.lit(1).cast("long"), bit))).bitwiseOR(_shift(bit.cast("long"), F.lit(32)))


def _all_bits():
    return F.array(*[F.lit(k) for k in range(32)])


def links(fps: DataFrame, *, crowd: int = 64, broadcast_keys: int = 1_000_000) -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints at 2 or fewer differing bits.

    fps: distinct values in a long column `fp`. Variants of up to `crowd` fingerprints give
    their verified pairs, larger ones stars of their refined groups; both link exactly those
    within the distance, through each other at least, and lose no link. Keys of variants of
    three and more are broadcast while they are at most `broadcast_keys` (16 bytes each) and
    joined by a shuffle beyond that.
    """
    variant = lambda k: F.transform(_all_bits(), lambda bit: _wild(_segment(F.col("fp"), k), bit).bitwiseOR(F.lit(k << 40)))
    # each fingerprint becomes 64 rows: spread them over tasks first, by a number that small input isn't merged back from
    spread = fps.repartition(min(10_000, max(8, fps.count() // 20_000)), "fp")
    index = spread.select("fp", F.explode(F.concat(variant(0), variant(1))).alias("key"))
    sizes = index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("low"), F.max("fp").alias("high")).where("n > 1")
    sizes = materialise(sizes, "variants")
    close = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= 2
    pairs = sizes.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).where(close(F.col("a"), F.col("b")))
    # members of larger variants; their keys are few unless the texts are mostly near copies
    larger = sizes.where("n > 2").select("key", "n")
    members = materialise(index.join(F.broadcast(larger) if larger.count() <= broadcast_keys else larger, "key"), "members")
    some = members.where(f"n <= {crowd}")
    other = some.select("key", F.col("fp").alias("b"))
    several = some.select("key", F.col("fp").alias("a")).join(other, "key").where("a < b").where(close(F.col("a"), F.col("b"))).select("a", "b")
    # crowded variants: the key is segment, wildcard bit and the rest of the segment
    many = members.where(f"n > {crowd}").withColumn("seg", F.shiftright("key", 40).bitwiseAND(F.lit(1)))
    other = F.when(F.col("seg") == 0, _segment(F.col("fp"), 1)).otherwise(_segment(F.col("fp"), 0))
    own = F.when(F.col("seg") == 0, _segment(F.col("fp"), 0)).otherwise(_segment(F.col("fp"), 1))
    many = many.select("fp", "key", own.alias("own"), other.alias("other"))
    one_each = many.select("fp", "key", F.lit(-1).cast("long").alias("own"), F.explode(F.transform(_all_bits(), lambda bit: _wild(F.col("other"), bit))).alias("rest"))
    flips = F.transform(_all_bits(), lambda bit: F.col("other").bitwiseXOR(_shift(F.lit(1).cast("long"), bit)))
    equal = many.select("fp", F.col("key").bitwiseAND(F.lit(1 << 40)).alias("key"), "own", "other").distinct()
    two_in_other = equal.select("fp", "key", "own", F.explode(F.concat(F.array("other"), flips)).alias("rest"))
    refined = one_each.unionByName(two_in_other)
    heads = refined.groupBy("key", "own", "rest").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = refined.join(heads, ["key", "own", "rest"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(several).union(stars).distinct()


def near_duplicates(docs: DataFrame, *, width: int = 3, id_col: str = "doc_id", text_col: str = "text", crowd: int = 64) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links, itself included.

    Texts without words have fingerprint zero and are linked like others. Rows with equal
    ids share a component of the smaller of their classes' ids. An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs, width=width, id_col=id_col, text_col=text_col), "simhash")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    reach = components(links(classes.select("fp"), crowd=crowd))
    joined = classes.join(reach.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(lowest, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, width: int = 3, id_col: str = "doc_id", text_col: str = "text", crowd: int = 64) -> DataFrame:
    """The rows of `docs` with the smallest id of their component, in the same columns.

    Null ids count as largest; of rows with equal ids in a component the text with the smaller
    hash stays, and of rows with equal id and text one.
    """
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    key = F.struct(F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), th.alias("th"))
    prints = materialise(fingerprints(docs.select(key.alias("doc_id"), F.col(text_col).alias("text")), width=width).withColumnRenamed("doc_id", "k"), "simhash")
    classes = materialise(prints.groupBy("fp").agg(F.min("k").alias("least")), "classes")
    reach = components(links(classes.select("fp"), crowd=crowd))
    heads = classes.join(reach.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("component", "fp").alias("c")).agg(F.min("least").alias("k"))
    heads = heads.select(F.col("k.id").alias("id"), F.col("k.th").alias("head"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(id_col).alias("own"), th.alias("th"))  # columns of any name
    kept = rows.join(heads, F.col("own").eqNullSafe(F.col("id")) & (F.col("th") == F.col("head")), "left_semi")
    if not prints.groupBy("k").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["own", "th"])
    return kept.select(*(F.col("row")[c].alias(c) for c in docs.columns))

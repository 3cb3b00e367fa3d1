"""Exact quantiles of any number of values a key, by counts of digits.

A double becomes a long of the same order. Its four 16-bit digits are settled one after the other:
tasks count the next digit of the values that share the digits known so far, and the counts, at most
65,536 for each of those, say where a rank falls. No task holds or sorts the values of a key, but
where every key has few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .shared import written

#: Up to so many keys the known digits are broadcast (some 10 MB), so that values are not shuffled.
BROADCAST_KEYS = 100_000
#: Up to so many values a key are sorted in one task.
HELD = 1 << 16


def _order(bits: np.ndarray) -> np.ndarray:
    """The bits of doubles to longs of their order, and back: of negative ones all but the sign is turned."""
    return bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF))


def _mapped(rows: DataFrame, column: str, kind: LongType | DoubleType) -> DataFrame:
    """`rows` with a column of doubles as longs of their order, or of such longs as doubles."""
    at = rows.columns.index(column)
    schema = StructType([StructField(f.name, kind if f.name == column else f.dataType) for f in rows.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(at).to_numpy(zero_copy_only=False)
            if isinstance(kind, LongType):
                x = np.where(np.isnan(x), np.nan, x + 0.0)  # one zero, and one that is no number
                new = pa.array(_order(x.view(np.int64)))
            else:
                new = pa.array(_order(x).view(np.float64))
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns)], names=schema.names)

    return rows.mapInArrow(run, schema)


def quantiles(rows: DataFrame, keys: list[str], value: str | Column, shares: list[float], held: int = HELD) -> DataFrame:
    """(keys, q, n): the values at `shares` of each key's order, between two of them in proportion, and their number.

    Equal to `percentile`. Nulls are left out, and a key with nothing else has no row; NaN comes
    after all numbers; a null key is a key. Without keys there is one row, or none of no values.
    """
    key = F.struct(*(keys or [F.lit(0).alias("_none")]))
    plain = rows.select(key.alias("k"), (F.col(value) if isinstance(value, str) else value).cast("double").alias("u")).where(F.col("u").isNotNull())
    plain = written(plain, "values")
    if (plain.groupBy("k").count().agg(F.max("count")).first()[0] or 0) <= held:
        found = plain.groupBy("k").agg(F.percentile("u", F.array(*map(F.lit, shares))).alias("q"), F.count("*").alias("n"))
        return found.select(*(F.col("k")[c].alias(c) for c in keys), "q", "n")
    bits = _mapped(plain, "u", LongType())
    bits = written(bits, "digits")
    first = written(bits.groupBy("k", F.shiftright("u", 48).alias("digit")).agg(F.count("*").alias("c")), "digits")
    many = first.select("k").distinct().count() > BROADCAST_KEYS

    counts = first.withColumns({"prefix": F.lit(0).cast("long"), "n": F.sum("c").over(Window.partitionBy("k"))})
    place = [F.col("n").cast("double").__sub__(1) * s for s in shares]
    ranks = [F.struct(F.lit(2 * i + j).alias("w"), f(p).cast("long").alias("rank")) for i, p in enumerate(place) for j, f in enumerate((F.floor, F.ceil))]
    counts = counts.withColumn("wants", F.array(*ranks))
    for step in range(4):
        upto = F.sum("c").over(Window.partitionBy("k", "prefix").orderBy("digit"))
        found = counts.withColumn("upto", upto).select("k", "n", (F.shiftleft("prefix", 16) + F.col("digit")).alias("prefix"), "c", "upto", F.explode("wants").alias("want"))
        found = found.where((F.col("want.rank") < F.col("upto")) & (F.col("want.rank") >= F.col("upto") - F.col("c")))
        found = found.select("k", "n", "prefix", F.struct("want.w", (F.col("want.rank") - F.col("upto") + F.col("c")).alias("rank")).alias("want"))
        if step == 3:
            break
        asked = found.groupBy("k", "prefix").agg(F.first("n").alias("n"), F.collect_list("want").alias("wants"))  # two ranks a share at most
        rest = bits.select("k", F.shiftright("u", 48 - 16 * step).alias("prefix"), F.shiftright("u", 32 - 16 * step).bitwiseAND(0xFFFF).alias("digit"))
        counts = rest.join(asked if many else F.broadcast(asked), ["k", "prefix"]).groupBy("k", "prefix", "digit").agg(F.count("*").alias("c"), F.first("n").alias("n"), F.first("wants").alias("wants"))
    ends = _mapped(found.select("k", "n", F.col("want.w").alias("w"), F.col("prefix").alias("u")), "u", DoubleType()).groupBy("k", "n").agg(F.map_from_entries(F.collect_list(F.struct("w", "u"))).alias("at"))
    between = []
    for i, p in enumerate(place):
        low, high, part = F.element_at("at", F.lit(2 * i)), F.element_at("at", F.lit(2 * i + 1)), p - F.floor(p)
        between.append(F.when(part == 0, low).otherwise((1 - part) * low + part * high))
    return ends.select(*(F.col("k")[c].alias(c) for c in keys), F.array(*between).alias("q"), "n")


def medians(rows: DataFrame, keys: list[str], value: str | Column, name: str = "median", held: int = HELD) -> DataFrame:
    """(keys, name): the exact median of each key."""
    return quantiles(rows, keys, value, [0.5], held).select(*keys, F.col("q")[0].alias(name))

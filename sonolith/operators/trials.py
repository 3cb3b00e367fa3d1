"""Blind listening trials: exact and sequential tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numeric import wald_bounds


def ln_factorials(spark: SparkSession, most: int) -> DataFrame:
    """(n, lf): ln n! for n = 0 .. most; a small dimension."""
    ln = spark.range(most + 1).select(F.col("id").alias("n"), F.log(F.greatest(F.col("id"), F.lit(1)).cast("double")).alias("l"))
    return ln.select("n", F.sum("l").over(Window.orderBy("n")).alias("lf"))


def binomial_tails(spark: SparkSession, most: int, p: float = 0.5) -> DataFrame:
    """(n, k, tail): chance of k or more right answers of n, for n up to `most`."""
    import math

    lf = ln_factorials(spark, most)
    n, k, r = (lf.select(F.col("n").alias(c), F.col("lf").alias(f"l{c}")) for c in "nkr")
    term = F.exp(F.col("ln") - F.col("lk") - F.col("lr") + F.col("k") * math.log(p) + F.col("r") * math.log(1 - p))
    terms = n.join(k, F.col("k") <= F.col("n")).join(r, F.col("r") == F.col("n") - F.col("k")).select("n", "k", term.alias("term"))
    return terms.select("n", "k", F.sum("term").over(Window.partitionBy("n").orderBy(F.desc("k"))).alias("tail"))


def sequential(trials: DataFrame, *, key: str, order: str, correct: str, n_max: int = 50) -> DataFrame:
    """(key, decision, at, llr): first crossing of Wald's bounds, or the end of the budget."""
    upper, lower, right, wrong = wald_bounds()
    w = Window.partitionBy(key).orderBy(order)
    rows = trials.withColumn("n", F.row_number().over(w)).withColumn("llr", F.sum(F.when(F.col(correct), right).otherwise(wrong)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.where(F.col("n") <= n_max).withColumn("said", F.when(F.col("llr") >= upper, "shown").when(F.col("llr") <= lower, "not_shown").when(F.col("n") == n_max, "inconclusive"))
    first = F.min(F.when(F.col("said").isNotNull(), F.struct("n", "said", "llr"))).alias("f")
    return rows.groupBy(key).agg(first, F.max("n").alias("n")).select(key, F.coalesce("f.said", F.lit("open")).alias("decision"), F.coalesce("f.n", "n").cast("long").alias("at"), F.col("f.llr").alias("llr"))

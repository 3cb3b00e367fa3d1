"""Library scans with a result cache, and placing a result on a quality ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ["path", "size", "mtime_ns", "rules"]


def split_by_cache(files: DataFrame, cache: DataFrame, *, rescan: bool = False) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): files whose path, size, time and rule version the cache holds, and the rest."""
    known = cache.select(*KEYS).distinct()
    if rescan:
        return files.limit(0), files
    return files.join(known, KEYS, "left_semi"), files.join(known, KEYS, "left_anti")


def upsert(cache: DataFrame, fresh: DataFrame, order: str = "seen") -> DataFrame:
    """One entry a path: the latest."""
    both = cache.unionByName(fresh)
    return both.groupBy("path").agg(F.max_by(F.struct(*[c for c in both.columns if c != "path"]), order).alias("e")).select("path", "e.*")


def staged(files: DataFrame, first: Column, second: Column, lossless: Column, broken: Column) -> DataFrame:
    """Adds bucket and stage: metadata settles lossy formats, one excerpt most, two more the undetermined."""
    bucket = F.when(broken, "error").when(~lossless, "lossy format").when(first != "undetermined", first).otherwise(second)
    stage = F.when(broken | ~lossless, 0).when(first != "undetermined", 1).otherwise(2)
    return files.withColumn("bucket", bucket).withColumn("stage", stage.cast("long"))


def place(rungs: DataFrame, tests: DataFrame, key: str) -> DataFrame:
    """Where a test value falls on its key's ladder of (kbps, value) rungs.

    The axis is made monotone by its running maximum and read linearly in log2 of the rate.
    Fewer than two rungs, an unknown rung or an unknown test value give "unknown".
    """
    w = Window.partitionBy(key).orderBy("kbps")
    r = rungs.withColumn("axis", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rises", F.col("value") > F.lag("value").over(w))
    r = r.withColumn("next_axis", F.lead("axis").over(w)).withColumn("next_kbps", F.lead("kbps").over(w))
    ends = r.groupBy(key).agg(
        F.count("*").alias("rungs"), F.count("value").alias("known"), F.max("value").alias("top"), F.min("value").alias("bottom"), F.coalesce(F.bool_and("rises"), F.lit(True)).alias("monotonic"),
        F.min_by("kbps", F.struct(-F.col("value"), "kbps")).alias("top_kbps"), F.min_by("kbps", F.struct("value", "kbps")).alias("bottom_kbps"),
    )
    t = tests.join(ends, key, "left")
    known = (F.col("rungs") >= 2) & (F.col("known") == F.col("rungs")) & F.col("test").isNotNull()
    t = t.withColumn("position", F.when(~F.coalesce(known, F.lit(False)), "unknown").when(F.col("test") >= F.col("top"), "above").when(F.col("test") <= F.col("bottom"), "below").otherwise("within"))
    inside = r.where("next_axis > axis").select(F.col(key).alias("_k"), "axis", "next_axis", "kbps", "next_kbps")
    hit = t.join(inside, (F.col(key) == F.col("_k")) & (F.col("position") == "within") & (F.col("test") >= F.col("axis")) & (F.col("test") < F.col("next_axis")), "left")
    share = (F.col("test") - F.col("axis")) / (F.col("next_axis") - F.col("axis"))
    between = F.pow(F.lit(2.0), F.log2(F.col("kbps").cast("double")) + share * (F.log2(F.col("next_kbps").cast("double")) - F.log2(F.col("kbps").cast("double"))))
    lower = F.when(F.col("position") == "within", F.col("kbps")).when(F.col("position") == "above", F.col("top_kbps"))
    upper = F.when(F.col("position") == "within", F.col("next_kbps")).when(F.col("position") == "below", F.col("bottom_kbps"))
    return hit.select(*tests.columns, "position", between.alias("kbps"), lower.alias("lower_kbps"), upper.alias("upper_kbps"), F.when(F.col("position") != "unknown", F.col("monotonic")).otherwise(False).alias("monotonic"))


def excerpt_starts(duration: Column, length: float) -> Column:
    """Candidate starts at 1/2, 1/4, 3/4, 1/10 and 9/10 of the room; one NULL where the length is unknown."""
    room = duration - length
    fits = F.transform(F.array(*map(F.lit, (0.5, 0.25, 0.75, 0.1, 0.9))), lambda f: f * room)
    return F.when(duration.isNull(), F.array(F.lit(None).cast("double"))).when(room <= 0, F.array(F.lit(0.0))).otherwise(fits)


def verify_starts(duration: Column, length: float = 30.0, edge: float = 0.05) -> Column:
    """Where the excerpts of a file that is verified by itself start: the centre first, then four more places, all off the edges."""
    lo, hi = edge * duration, (1 - edge) * duration - length
    places = F.transform(F.array(*map(F.lit, (0.5, 0.25, 0.75, 0.0, 1.0))), lambda f: lo + f * (hi - lo))
    return F.when(duration.isNull() | (hi <= lo), F.array(F.lit(0.0))).otherwise(places)


def first_usable(excerpts: DataFrame, key: str, order: str, frames: str, least: int = 40) -> DataFrame:
    """The first excerpt of each file with `least` active frames; without one, that with the most, the first of equals."""
    enough = F.col(frames) >= least
    rank = F.struct(enough.cast("int").alias("a"), F.when(enough, F.lit(0)).otherwise(F.col(frames)).alias("b"), (-F.col(order)).alias("c"))
    best = excerpts.groupBy(key).agg(F.max_by(F.struct(*(c for c in excerpts.columns if c != key)), rank).alias("e"), F.count("*").alias("tried"))
    return best.select(key, "e.*", "tried")

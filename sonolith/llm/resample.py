"""Importance resampling towards a target text, with hashed n-gram weights and exact ranks, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise

#: A run of digits, ASCII letters in either case and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The gain table is broadcast up to so many rows (16 MB), and joined by a shuffle beyond.
BROADCAST_BUCKETS = 1 << 20


def words(text: Column) -> Column:
    """Words of a text with A-Z, and nothing else, in lower case; a null text has none."""
    lowered = lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, UPPER, LOWER))
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lowered)


def grams(tokens: Column, longest: int) -> Column:
    """All runs of 1 to `longest` consecutive words, joined by one space, repeats included."""
    def runs(n: int) -> Column:
        places = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda k: F.array_join(F.slice(tokens, k, n), " "))

    return F.concat(tokens, *map(runs, range(2, longest + 1))) if longest > 1 else tokens


def hashed(docs: DataFrame, text: Column, keep: dict[str, Column], longest: int, buckets: int) -> DataFrame:
    """`keep`, `n_words` and the `buckets` (crc32 of the UTF-8 bytes, modulo) of all features of each row."""
    tokens = docs.select(*(c.alias(n) for n, c in keep.items()), words(text).alias("_words"))
    features = F.transform(grams(F.col("_words"), longest), lambda g: (F.crc32(g.cast("binary")) % buckets).cast("int"))
    return tokens.select(*keep, F.size("_words").cast("long").alias("n_words"), features.alias("buckets"))


def bucket_counts(features: DataFrame, name: str) -> DataFrame:
    """Occurrences of each bucket: summed in the task that explodes them, so a row a bucket and task is shuffled."""
    return features.select(F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))


def gains(features: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """floor(1000 ln) of a bucket's smoothed share in the target over its share in the documents, for buckets that occur in these."""
    held = materialise(bucket_counts(features, "s").join(bucket_counts(target, "t"), "bucket", "full").fillna(0, ["s", "t"]), "buckets")
    s_all, t_all = held.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    top = (F.col("t") + 1).cast("double") * F.lit(float(s_all + buckets))
    low = (F.col("s") + 1).cast("double") * F.lit(float(t_all + buckets))
    return held.where("s > 0").select("bucket", F.floor(F.lit(1000.0) * F.log(top / low)).alias("gain"))


def luck(doc_id: Column, seed: int) -> Column:
    """A Gumbel draw in thousandths, rounded down, that depends on the seed and the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """`rows` with their place in `order` from 1, without bringing all rows to one task.

    A range partitioning sorts; a row's place is what the partitions before its own hold, plus its
    place there. The offsets are one row a partition. Give an order without ties.
    """
    place = F.col("_place")
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    spread = materialise(spread.withColumns({"_part": F.shiftright(place, 33), "_place": place.bitwiseAND((1 << 33) - 1)}), "ranked")
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))
    return spread.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place + 1).drop("_part", "_place", "_before")


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Scores of all documents and the ranks of those drawn: the best `percent` of what has `min_words` words, without replacement.

    A document's weight is the mean gain of its features, rounded down; its score adds a Gumbel
    draw, so that the highest scores are a sample in proportion to the weights. Returns one row for
    each row of `docs`: doc_id, n_features, weight, score and rank (null if not drawn), all long but
    the id. Ties go to the smaller id; of repeated ids each row counts, in any order among equals.

    A null text or one without words has no features and weight 0; a null id draws as an empty
    string does and sorts first. With an empty target all gains compare with a flat distribution; an
    empty table gives no rows. Other columns of `docs`, whatever their names, are not read.
    """
    features = materialise(hashed(docs, F.col(text_col), {"doc_id": F.col(id_col), "_row": F.monotonically_increasing_id()}, longest, buckets), "features")
    table = gains(features, hashed(target, F.col(target_col), {}, longest, buckets), buckets)
    table = F.broadcast(table) if buckets <= BROADCAST_BUCKETS else table
    # a document's features are exploded and summed in one task; only the sums are shuffled
    summed = features.select("_row", "doc_id", "n_words", F.size("buckets").cast("long").alias("n_features"), F.explode_outer("buckets").alias("bucket")).join(table, "bucket", "left")
    summed = summed.groupBy("_row", "doc_id", "n_words", "n_features").agg(F.coalesce(F.sum("gain"), F.lit(0)).alias("gain"))
    mean = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    scored = materialise(summed.withColumn("weight", mean).withColumn("score", F.col("weight") + luck(F.col("doc_id"), seed)), "scored")
    fit = scored.where(F.col("n_words") >= min_words)
    drawn = percent * fit.count() // 100
    places = ranked(fit.select("_row", "doc_id", "n_features", "weight", "score"), [F.desc("score"), F.asc("doc_id"), F.asc("_row")])
    places = places.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long").alias("rank"))
    return places.unionByName(scored.where(F.col("n_words") < min_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))

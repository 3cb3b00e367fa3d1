"""Role views: the driver's tables seen as signals, frames, trials and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, t, vec_id, a, b): embeddings as reference frames, and a noisy copy as test frames; the number is the time."""
    e = table(spark, sf_dir, "embeddings")
    noisy = F.transform("a", lambda x, i: 0.8 * x + 0.01 * (((F.col("vec_id") * 31 + i * 17) % 23) - 11))
    rows = e.select(F.col("label").cast("long").alias("track"), F.col("vec_id").alias("t"), "vec_id", F.col("embedding").cast("array<double>").alias("a"))
    return rows.withColumn("b", noisy)


def ranked_frames(spark: SparkSession, sf_dir: str, stretch: int = 1 << 16) -> DataFrame:
    """The frames with their place in their track, from 0 on by number, as the time.

    A track is numbered in stretches of numbers, each by one task, from what the stretches before it hold.
    """
    f = frames(spark, sf_dir).withColumn("stretch", F.coalesce(F.floor(F.col("vec_id") / stretch), F.lit((1 << 63) - 1)))
    sizes = f.groupBy("track", "stretch").agg(F.count("*").alias("size"))
    before = sizes.select(F.col("track").alias("of"), F.col("stretch").alias("at"), (F.sum("size").over(Window.partitionBy("track").orderBy("stretch")) - F.col("size")).alias("before"))
    place = F.row_number().over(Window.partitionBy("track", "stretch").orderBy(F.asc_nulls_last("vec_id"))) - 1
    rows = f.withColumn("place", place).join(before, F.col("track").eqNullSafe(F.col("of")) & (F.col("stretch") == F.col("at")))
    return rows.select("track", (F.col("before") + F.col("place")).alias("t"), "vec_id", "a", "b")


#: The same in SQL, down to one-sided spectra of 33 bins.
FRAMES_SQL = """
fr AS (SELECT label::BIGINT AS track, vec_id AS t, vec_id, embedding FROM embeddings),
s AS (SELECT track, t, i, embedding[i + 1]::DOUBLE AS a, 0.8::DOUBLE * embedding[i + 1]::DOUBLE + 0.01::DOUBLE * (((vec_id * 31 + i * 17) % 23) - 11) AS b
      FROM fr, (SELECT unnest(range(64)) AS i)),
sp AS (SELECT track, t, f AS bin, sum(a * cos(2 * pi() * f * i / 64)) AS are, -sum(a * sin(2 * pi() * f * i / 64)) AS aim,
              sum(b * cos(2 * pi() * f * i / 64)) AS bre, -sum(b * sin(2 * pi() * f * i / 64)) AS bim
       FROM s, (SELECT unnest(range(33)) AS f) GROUP BY track, t, f)"""
RANKED_SQL = FRAMES_SQL.replace("vec_id AS t,", "row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t,")
CROSS_SQL = (
    FRAMES_SQL
    + """,
x AS (SELECT track, bin, sum(are * are + aim * aim) AS saa, sum(bre * bre + bim * bim) AS sbb, sum(are * bre + aim * bim) AS sab_re,
             sum(are * bim - aim * bre) AS sab_im, count(*) AS frames FROM sp GROUP BY track, bin)"""
)


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pos, x, ch, track): one long signal with a channel and a user for each sample."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.col("value").alias("x"), F.col("event_type").alias("ch"), F.col("user_id").alias("track"))


def r6(expr: str) -> str:
    return f"floor(({expr}) * 1e6 + 0.5) / 1e6"

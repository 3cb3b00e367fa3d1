"""Writers: guarded reports, CSV of a scan, names that are never overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import privacy


def write_guarded(reports: DataFrame, path: str, *, text_col: str = "text", secrets: list[str] | None = None, names: list[str] | None = None, mode: str = "error") -> None:
    """Write report texts, refusing all of them if one still has a personal trace. Data URIs are not searched."""
    searched = F.regexp_replace(text_col, r"data:[a-z/+.-]+;base64,[A-Za-z0-9+/=]*", "")
    leaks = F.size(privacy.audit(searched, secrets or [], names or []))
    checked = reports.withColumn(text_col, F.when(leaks == 0, F.col(text_col)).otherwise(F.raise_error(F.lit("a report has personal traces")).cast("string")))
    checked.write.mode(mode).parquet(path)


def csv_rows(scan: DataFrame) -> DataFrame:
    """file, verdict, cutoff_khz and seconds with two decimals and blanks for unknown, stage, reason."""
    two = lambda c: F.when(c.isNull(), "").otherwise(F.format_string("%.2f", c))
    return scan.select(privacy.basename(F.col("path")).alias("file"), F.col("bucket").alias("verdict"), two(F.col("cutoff_hz") / 1000).alias("cutoff_khz"), "stage", F.coalesce("reason", F.lit("")).alias("reason"), two(F.col("seconds")).alias("seconds"))


def unique_names(jobs: DataFrame, taken: DataFrame, base: Column, extension: Column, *, order: str) -> DataFrame:
    """Adds name: base.ext, or base_2.ext and so on, so that jobs avoid each other and what exists.

    taken: (name). Each job takes the first number that is free.
    """
    rows = jobs.withColumn("_b", base).withColumn("_e", extension)
    used = taken.select(F.regexp_extract("name", r"^(.*?)(?:_(\d+))?\.([^.]+)$", 1).alias("_b"), F.regexp_extract("name", r"\.([^.]+)$", 1).alias("_e"), F.coalesce(F.regexp_extract("name", r"_(\d+)\.[^.]+$", 1).try_cast("int"), F.lit(1)).alias("_u"))
    used = used.groupBy("_b", "_e").agg(F.sort_array(F.collect_set("_u")).alias("_u"))
    place = F.row_number().over(Window.partitionBy("_b", "_e").orderBy(order))
    rows = rows.withColumn("_n", place).join(used, ["_b", "_e"], "left")
    n = F.coalesce(F.aggregate("_u", F.col("_n"), lambda free, u: F.when(u <= free, free + 1).otherwise(free)), F.col("_n"))
    return rows.withColumn("name", F.concat("_b", F.when(n > 1, F.concat(F.lit("_"), n)).otherwise(""), F.lit("."), "_e")).drop("_b", "_e", "_u", "_n")


def session_log(sessions: DataFrame) -> DataFrame:
    """One JSON text a session; practice sessions keep none."""
    return sessions.where("mode <> 'practice'").select(F.to_json(F.struct(*sessions.columns)).alias("value"))

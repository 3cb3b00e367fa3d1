"""Long signals in blocks, and the blocks that a piece of work needs.

A track is rows (track, block, start, x): block k holds the samples from k * size on, without
gaps; `start` is the position of its first one. Pieces of work name the range that they need and
get its blocks by an equi-join, so that memory depends on the range alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blocks(series: DataFrame, size: int, *, key: str = "track", pos: str = "pos", value: str = "x") -> DataFrame:
    """(track, block, start, x) of samples (key, pos, value); a gap, or a position twice, within a block is an error."""
    rows = series.select(F.col(key).alias("track"), F.floor(F.col(pos) / size).cast("long").alias("block"), F.struct(F.col(pos).cast("long").alias("p"), F.col(value).cast("double").alias("v")).alias("s"))
    held = rows.groupBy("track", "block").agg(F.min("s.p").alias("start"), F.max("s.p").alias("last"), F.sort_array(F.collect_list("s")).alias("s"))
    whole = F.col("last") - F.col("start") + 1 == F.size("s")
    x = F.when(whole, F.transform("s", lambda s: s["v"])).otherwise(F.raise_error(F.concat(F.lit("samples are missing, or there twice, from "), F.col("start"))).cast("array<double>"))
    return held.select("track", "block", "start", x.alias("x"))


def lengths(parts: DataFrame) -> DataFrame:
    """(track, n): the position after the last sample of each track."""
    return parts.groupBy("track").agg(F.max(F.col("start") + F.size("x")).alias("n"))


def asked(wanted: DataFrame, parts: DataFrame, role: str, size: int, lo: str, hi: str, keys: list[str]) -> DataFrame:
    """(keys, role, block, start, x): the blocks of `parts` that hold samples lo .. hi - 1 of each row's track."""
    first, last = F.floor(F.greatest(F.col(lo), F.lit(0)) / size).cast("long"), F.floor((F.col(hi) - 1) / size).cast("long")
    asks = wanted.where(F.col(hi) > F.greatest(F.col(lo), F.lit(0))).select(*keys, F.explode(F.sequence(first, last)).alias("block"))
    return asks.join(parts, ["track", "block"]).select(*keys, F.lit(role).alias("role"), "block", "start", "x")


def stretch(rows: pd.DataFrame, role: str) -> tuple[int, np.ndarray]:
    """The first position and the samples of one side of a group, up to the first gap between its blocks."""
    mine = rows[rows.role == role].drop_duplicates("block").sort_values("block")
    if mine.empty:
        return 0, np.zeros(0)
    ends = mine.start.to_numpy() + np.array([len(x) for x in mine.x])
    whole = 1 + int(np.argmin(np.append(mine.start.to_numpy()[1:] == ends[:-1], False)))
    return int(mine.start.iloc[0]), np.concatenate([np.asarray(x, float) for x in mine.x.iloc[:whole]])


def frame(columns: dict) -> pd.DataFrame:
    """Plain columns: text and arrays as objects, which is what Arrow takes whatever pandas infers."""
    whole = {"block", "start", "lag", "pos", "overlap"}
    return pd.DataFrame({k: pd.Series(v, dtype=object if k in ("track", "x", "sums") else np.int64 if k in whole else float) for k, v in columns.items()})

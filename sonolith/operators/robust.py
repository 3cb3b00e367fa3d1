"""The line through the median of all pairwise slopes, for any number of points a key, without making the pairs.

The slopes below m are the pairs that stand the other way round by y - m x than by x: inversions,
which blocks count by merging. Some m are tried at a time until few enough slopes are left between
two of them; the points that these belong to then give the median itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import medians
from .shared import written

#: Slopes that one task may make: a number of pairs, whatever the number of points.
PAIRS = 1 << 20
#: Points a block; sampled points a block, which say where blocks by y - m x begin.
BLOCK, SAMPLED = 1 << 16, 16
TRIED = 64


def inversions(z: np.ndarray) -> int:
    """How many pairs i < j have z[j] < z[i], by merging runs of twice the length each time."""
    count, _, _ = _merged(z, False)
    return count


def inverted(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) themselves."""
    _, i, j = _merged(z, True)
    return i, j


def _merged(z: np.ndarray, listed: bool) -> tuple[int, np.ndarray, np.ndarray]:
    n = len(z)
    size = 1 << max(0, (n - 1).bit_length())
    rank = np.full(size, n, np.int64)  # what fills up the last run stands last and is in no pair
    rank[:n] = np.unique(z, return_inverse=True)[1]
    place, count, left, right, width = np.arange(size), 0, [], [], 1
    while width < size:
        rows = size // (2 * width)
        keys = rank.reshape(rows, 2, width) + (np.arange(rows) * (n + 2))[:, None, None]  # runs of each row are sorted, rows follow each other
        lower, upper = keys[:, 0].ravel(), keys[:, 1].ravel()
        ends = np.repeat((np.arange(rows) + 1) * width, width)
        first = np.searchsorted(lower, upper, side="right")
        above = ends - first
        count += int(above.sum())
        if listed and (some := np.flatnonzero(above)).size:
            at = np.repeat(first[some] - (np.cumsum(above[some]) - above[some]), above[some]) + np.arange(int(above[some].sum()))
            spots = place.reshape(rows, 2, width)
            left.append(spots[:, 0].ravel()[at])
            right.append(np.repeat(spots[:, 1].ravel()[some], above[some]))
        if listed:
            order = np.argsort(rank.reshape(rows, 2 * width), axis=1, kind="stable")
            rank, place = (np.take_along_axis(v.reshape(rows, 2 * width), order, axis=1).ravel() for v in (rank, place))
        else:
            rank = np.sort(rank.reshape(rows, 2 * width), axis=1).ravel()
        width *= 2
    none = np.zeros(0, np.int64)
    return count, np.concatenate([none, *left]), np.concatenate([none, *right])


def turned(x: np.ndarray, y: np.ndarray, m: float) -> np.ndarray:
    """y - m x, whose order is that of x for an m below all slopes and the reverse above them."""
    return x if m == -np.inf else -x if m == np.inf else y - m * x


def median_slope(x: np.ndarray, y: np.ndarray, low: float = -np.inf, high: float = np.inf, below: int = 0, pairs: int | None = None) -> float:
    """The median of `pairs` slopes, of which `below` lie under `low` and all that are made lie from there to `high`."""
    order = np.lexsort((y, x, turned(x, y, low)))
    x, y = x[order], y[order]
    i, j = inverted(turned(x, y, high))
    slopes = np.sort((y[j] - y[i]) / (x[j] - x[i]))
    total = len(slopes) if pairs is None else pairs
    if not len(slopes):
        return float("nan")
    a, b = (int(np.clip(r - below, 0, len(slopes) - 1)) for r in ((total - 1) // 2, total // 2))
    return float((slopes[a] + slopes[b]) / 2)


def candidates(x: np.ndarray, y: np.ndarray, low: float, high: float, below: int, upto: int, target: float) -> np.ndarray:
    """Slopes to try between two bounds: by the sampled points while these have enough there, else in proportion."""
    some = np.linspace(0, len(x) - 1, min(len(x), 512)).astype(int)
    i, j = np.triu_indices(len(some), 1)
    dx = x[some][j] - x[some][i]
    with np.errstate(over="ignore", invalid="ignore"):
        slopes = ((y[some][j] - y[some][i])[dx != 0] / dx[dx != 0]).astype(float)
    slopes = np.sort(slopes[(slopes > low) & (slopes < high)])
    share = (target - below) / max(1, upto - below)
    tried: list[float] = []
    if len(slopes) >= 1000:
        tried += np.quantile(slopes, np.clip(share + np.array([-0.1, -0.02, -0.005, 0.005, 0.02, 0.1]), 0, 1)).tolist()
    elif np.isfinite(low) and np.isfinite(high):
        width, about = high - low, low + share * (high - low)
        tried += [about, *(about + side * width / k for k in (16, 256) for side in (-1, 1)), _halfway(low, high)]
    else:
        around = (slopes[[0, -1]] if len(slopes) else np.array([low if np.isfinite(low) else high if np.isfinite(high) else 0.0] * 2)).tolist()
        tried += [around[0] - (abs(around[0]) + 1) * k for k in (0, 1, 1e6)] + [around[1] + (abs(around[1]) + 1) * k for k in (0, 1, 1e6)]
    return np.unique([m for m in tried if low < m < high])


def _halfway(low: float, high: float) -> float:
    """The double in the middle of those between two, by their order."""
    bits = np.array([low, high]).view(np.int64)
    low_bits, high_bits = (int(b) if b >= 0 else -(int(b) & 0x7FFFFFFFFFFFFFFF) for b in bits)
    middle = (low_bits + high_bits) // 2
    return float(np.array([middle if middle >= 0 else -middle | -(1 << 63)], np.int64).view(np.float64)[0])


def _in_order(points: DataFrame, sizes: DataFrame, block: int) -> DataFrame:
    """(k, a, rank, x, y): points by x, with their exact rank in their key and its block; a range partitioning sorts."""
    spread = points.repartitionByRange("k", "x", "y", "u").sortWithinPartitions("k", "x", "y", "u").withColumn("at", F.monotonically_increasing_id())
    spread = written(spread.withColumn("part", F.shiftright("at", 33)).select("k", "x", "y", "part", "at"), "ordered")
    parts = spread.groupBy("k", "part").agg(F.count("*").alias("c"), F.min("at").alias("first"))
    parts = parts.withColumn("before", F.sum("c").over(Window.partitionBy("k").orderBy("part")) - F.col("c")).select("k", "part", "first", "before")
    rank = F.col("before") + F.col("at") - F.col("first")
    return spread.join(parts, ["k", "part"]).select("k", rank.alias("rank"), F.floor(rank / block).cast("long").alias("a"), "x", "y")


def _table(key, n: int, **columns) -> pd.DataFrame:
    """`n` rows of one key; keys and lists as objects, which is what Arrow takes whatever pandas infers."""
    return pd.DataFrame({"k": pd.Series([key] * n, dtype=object), **{c: pd.Series(v, dtype=object) if c in ("zs", "xs", "ys", "bounds") else v for c, v in columns.items()}})


def _rows(batches: Iterator[pd.DataFrame], made) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for row in batch.itertuples(index=False):
            yield from made(row)


def _bounds(row) -> np.ndarray:
    """Where the blocks by y - m x begin, from the sampled points."""
    z = np.sort(turned(np.asarray(row.sx, float), np.asarray(row.sy, float), row.m))
    return z[(np.arange(1, row.blocks) * len(z)) // row.blocks]


def _cut(z: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """Places of the values of each block, in their own order."""
    where = np.searchsorted(bounds, z, side="right")
    order = np.argsort(where, kind="stable")
    return np.split(order, np.searchsorted(where[order], np.arange(1, len(bounds) + 1)))


def _below(held: DataFrame, asked: DataFrame, kind: str) -> DataFrame:
    """(k, m, c): how many slopes of a key lie below each m."""

    def cells(row) -> Iterator[pd.DataFrame]:
        z = turned(np.asarray(row.xs, float), np.asarray(row.ys, float), row.m)
        parts = _cut(z, np.asarray(row.bounds, float))
        inner = [inversions(z), *[0] * (len(parts) - 1)]
        yield _table(row.k, len(parts), m=row.m, a=row.a, b=np.arange(len(parts)), c=[len(p) for p in parts], zs=[np.sort(z[p]) for p in parts], inner=inner)

    def crossing(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("a")
        return _table(key[0], 1, m=[key[1]], c=[inversions(np.concatenate(group.zs.tolist()))])

    made = held.join(asked, "k").mapInPandas(lambda it: _rows(it, cells), f"k {kind}, m double, a long, b long, c long, zs array<double>, inner long")
    made = written(made, "cells")
    # pairs of two blocks by x: in one block by z they cross as counted there, else as the numbers of both say
    near = made.where("c > 0").groupBy("k", "m", "b").applyInPandas(crossing, f"k {kind}, m double, c long")
    later = F.coalesce(F.sum("c").over(Window.partitionBy("k", "m", "b").orderBy(F.desc("a")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lower = F.coalesce(F.sum("later").over(Window.partitionBy("k", "m", "a").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    far = made.select("k", "m", "a", "b", "c", "inner").withColumn("later", later).select("k", "m", (F.col("c") * lower + F.col("inner")).alias("c"))
    return near.unionByName(far).groupBy("k", "m").agg(F.sum("c").alias("c"))


def _left(held: DataFrame, state: DataFrame, kind: str) -> DataFrame:
    """(k, x, y): the points of which some pair has its slope between the bounds, at most two a slope.

    From the order at the lower bound to that at the upper one only those pairs turn; a point that
    no earlier one passes, and that passes no later one, is in none of them.
    """

    def cut(row) -> Iterator[pd.DataFrame]:
        x, y = np.asarray(row.xs, float), np.asarray(row.ys, float)
        high = turned(x, y, row.high)
        parts = [(b, p) for b, p in enumerate(_cut(turned(x, y, row.m), _bounds(row))) if len(p)]
        yield _table(row.k, len(parts), b=[b for b, _ in parts], low=row.m, high=row.high, most=[high[p].max() for _, p in parts], least=[high[p].min() for _, p in parts], xs=[x[p] for _, p in parts], ys=[y[p] for _, p in parts])

    def passed(_: tuple, group: pd.DataFrame) -> pd.DataFrame:
        one = group.iloc[0]
        x, y = (np.concatenate(group[c].tolist()) for c in ("xs", "ys"))
        order = np.lexsort((y, x, turned(x, y, one.low)))
        x, y = x[order], y[order]
        z = turned(x, y, one.high)
        earlier = np.maximum.accumulate(np.concatenate([[-np.inf if pd.isna(one.earlier) else one.earlier], z[:-1]]))
        later = np.minimum.accumulate(np.concatenate([[np.inf if pd.isna(one.later) else one.later], z[:0:-1]]))[::-1]
        some = (z < earlier) | (z > later)
        return _table(one.k, int(some.sum()), x=x[some], y=y[some])

    parts = held.join(state.withColumnRenamed("low", "m"), "k").mapInPandas(lambda it: _rows(it, cut), f"k {kind}, b long, low double, high double, most double, least double, xs array<double>, ys array<double>")
    parts = written(parts, "turning")
    by = Window.partitionBy("k").orderBy("b")
    ends = parts.groupBy("k", "b").agg(F.max("most").alias("most"), F.min("least").alias("least"))
    ends = ends.select("k", "b", F.max("most").over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.min("least").over(by.rowsBetween(1, Window.unboundedFollowing)).alias("later"))
    return parts.join(ends, ["k", "b"]).groupBy("k", "b").applyInPandas(passed, f"k {kind}, x double, y double")


def slopes(points: DataFrame, key: str, x: str, y: str, *, block: int = BLOCK, pairs: int = PAIRS, rounds: list[int] | None = None) -> DataFrame:
    """(key, slope): the median of the slopes of all pairs of a key's points that differ in x.

    Few points a key make their pairs in one task. More go by blocks of `block` points: no task
    holds more than some blocks, the points of `pairs` slopes, or one sampled point for 4,096. The
    number of rounds grows with the logarithm of the number of pairs (`rounds`, if given, takes that of
    the open keys in each). Equal slopes by the million are found to 1e-14 of their size, all others
    exactly.

    Points with a null or not finite coordinate, or a null key, are left out; a key without two
    different x has no row.
    """
    return _slopes(_points(points, key, x, y), block, pairs, rounds).withColumnRenamed("k", key)


def _points(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    kept = points.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(F.col("k").isNotNull() & F.abs("x").between(0, 1.7e308) & F.abs("y").between(0, 1.7e308))
    return written(kept.withColumn("u", F.monotonically_increasing_id()), "points")


def _slopes(kept: DataFrame, block: int = BLOCK, pairs: int = PAIRS, rounds: list[int] | None = None) -> DataFrame:
    kind = kept.schema["k"].dataType.simpleString()
    sizes = kept.groupBy("k", "x").agg(F.count("*").alias("c")).groupBy("k").agg(F.sum("c").alias("n"), F.sum(F.expr("c * (c - 1) div 2")).alias("ties"))
    sizes = written(sizes.select("k", "n", (F.expr("n * (n - 1) div 2") - F.col("ties")).alias("total")).where("total > 0"), "sizes")
    few = F.expr(f"n * (n - 1) div 2 <= {pairs}")

    def at_once(key_: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return _table(key_[0], 1, slope=[median_slope(group.x.to_numpy(), group.y.to_numpy())])

    found = kept.join(sizes.where(few).select("k"), "k").groupBy("k").applyInPandas(at_once, f"k {kind}, slope double")
    if not sizes.where(~few).isEmpty():
        found = found.unionByName(_many(kept, sizes.where(~few), kind, block, pairs, rounds))
    return found


def _many(kept: DataFrame, sizes: DataFrame, kind: str, block: int, pairs: int, rounds: list[int] | None) -> DataFrame:
    """(k, slope) of keys with many points."""
    blocks = F.ceil(F.col("n") / block).cast("long")
    placed = written(_in_order(kept.join(sizes.select("k"), "k"), sizes, block), "placed")
    held = placed.groupBy("k", "a").agg(F.sort_array(F.collect_list(F.struct("rank", "x", "y"))).alias("p")).select("k", "a", F.transform("p", lambda p: p["x"]).alias("xs"), F.transform("p", lambda p: p["y"]).alias("ys"))
    held = written(held, "blocks")
    step = F.greatest(F.lit(1), F.expr(f"n div greatest(512, {SAMPLED} * ceil(n / {block}))"))
    sample = placed.join(sizes, "k").where(F.col("rank") % step == 0).groupBy("k").agg(F.first("n").alias("n"), F.first("total").alias("total"), F.sort_array(F.collect_list(F.struct("rank", "x", "y"))).alias("p"))
    sample = written(sample.select("k", "total", blocks.alias("blocks"), F.transform("p", lambda p: p["x"]).alias("sx"), F.transform("p", lambda p: p["y"]).alias("sy")), "sampled")
    state = written(sizes.select("k", F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0).cast("long").alias("below"), F.col("total").alias("upto"), "total"), "state")
    width = F.col("high") - F.col("low")
    narrow = (width < float("inf")) & (width <= 1e-14 * F.greatest(F.abs("low"), F.abs("high")))
    open_ = (F.col("upto") - F.col("below") > pairs) & ~narrow

    def tries(row) -> Iterator[pd.DataFrame]:
        sx, sy = np.asarray(row.sx, float), np.asarray(row.sy, float)
        ms = candidates(sx, sy, row.low, row.high, row.below, row.upto, (row.total - 1) / 2)
        made = [row._replace(m=m) for m in ms]
        yield _table(row.k, len(ms), m=ms, bounds=[_bounds(r) for r in made])

    for _ in range(TRIED):
        todo = state.where(open_)
        many = todo.count()
        if rounds is not None and many:
            rounds.append(many)
        if not many:
            break
        asked = todo.join(sample.drop("total"), "k").withColumn("m", F.lit(0.0)).mapInPandas(lambda it: _rows(it, tries), f"k {kind}, m double, bounds array<double>")
        got = _below(held, written(asked, "asked"), kind).join(state.select("k", "total"), "k")
        got = got.groupBy("k").agg(*(f(F.when(test, F.struct("m", "c"))).alias(name) for name, f, test in (("lo", F.max, F.col("c") <= F.expr("(total - 1) div 2")), ("hi", F.min, F.col("c") > F.expr("total div 2")))))
        pick = lambda new, old: F.coalesce(F.col(new), F.col(old)).alias(old)
        state = written(state.join(got, "k", "left").select("k", pick("lo.m", "low"), pick("hi.m", "high"), pick("lo.c", "below"), pick("hi.c", "upto"), "total"), "state")
    else:
        raise RuntimeError(f"slopes are not settled after {TRIED} rounds")

    def last(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        one = group.iloc[0]
        return _table(key[0], 1, slope=[median_slope(group.x.to_numpy(), group.y.to_numpy(), one.low, one.high, int(one.below), int(one.total))])

    settled = state.where(F.col("upto") - F.col("below") <= pairs)
    turning = _left(held, settled.join(sample.drop("total"), "k").select("k", "low", "high", "blocks", "sx", "sy"), kind)
    exact = turning.join(settled.select("k", "low", "high", "below", "total"), "k").groupBy("k").applyInPandas(last, f"k {kind}, slope double")
    return exact.unionByName(state.where(F.col("upto") - F.col("below") > pairs).select("k", ((F.col("low") + F.col("high")) / 2).alias("slope")))


def theil_sen(points: DataFrame, key: str, x: str, y: str, **limits) -> DataFrame:
    """(key, slope, intercept): median of pairwise slopes, median of what is left. See `slopes`."""
    kept = _points(points, key, x, y)
    fit = written(_slopes(kept, **limits), "slopes")
    rest = medians(kept.join(fit, "k"), ["k"], F.col("y") - F.col("slope") * F.col("x"), "intercept")
    return fit.join(rest, "k").select(F.col("k").alias(key), "slope", "intercept")


def mad(points: DataFrame, fit: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, mad, points): median absolute deviation of residuals from their median."""
    rows = written(points.join(fit, key).select(key, (F.col(y) - F.col("intercept") - F.col("slope") * F.col(x)).alias("r")), "residuals")
    centre = medians(rows, [key], "r", "c")
    spread = medians(rows.join(centre, key), [key], F.abs(F.col("r") - F.col("c")), "mad")
    return spread.join(rows.groupBy(key).agg(F.count("*").alias("points")), key).select(key, "mad", "points")

"""Exact quantiles and the robust line at any size against plain forms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonolith.operators import quantiles as q
from sonolith.operators import robust


def pairwise(x, y):
    i, j = np.triu_indices(len(x), 1)
    d = x[j] - x[i]
    return np.median((y[j] - y[i])[d != 0] / d[d != 0])


def frame(spark, **keys):
    return spark.createDataFrame([(k, float(a), float(b)) for k, (x, y) in keys.items() for a, b in zip(x, y, strict=True)], "k string, x double, y double").repartition(8)


@pytest.mark.parametrize("held", [0, q.HELD])
def test_quantiles_equal_percentile(spark, held):
    r = np.random.default_rng(3)
    rows = [(k, float(v)) for k, n in (("a", 1), ("b", 2), ("c", 999), ("e", 1000)) for v in np.concatenate([r.normal(size=n // 2) * 10.0 ** r.integers(-300, 300, n // 2), r.integers(-3, 3, n - n // 2)])]
    rows += [("d", v) for v in (0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324)] + [("n", math.nan), ("n", 1.0), ("n", math.nan), ("z", None), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: (r.q, r.n) for r in q.quantiles(df, ["k"], "v", shares, held).collect()}
    want = {r.k: (r.q, r.n) for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q"), F.count("v").alias("n")).collect() if r.n}
    assert got.keys() == want.keys() and len(got) == 7
    for k, (values, n) in want.items():
        assert got[k][1] == n and np.allclose(got[k][0], values, rtol=1e-15, atol=0, equal_nan=True), k
    assert q.medians(df.where("k = 'e'"), [], "v", held=held).first().median == pytest.approx(np.median([v for k, v in rows if k == "e"]), rel=1e-15)
    assert q.medians(df.where("false"), ["k"], "v", held=held).count() == 0


def test_keys_that_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(q, "BROADCAST_KEYS", 0)
    df = spark.range(5000).selectExpr("id % 3 a", "id % 2 = 0 b", "sqrt(id) v")
    got = {(r.a, r.b): r.m for r in q.medians(df, ["a", "b"], "v", "m", held=0).collect()}
    assert got == {(r.a, r.b): pytest.approx(r.m, rel=1e-15) for r in df.groupBy("a", "b").agg(F.percentile("v", 0.5).alias("m")).collect()}


def test_inversions():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 17, 64, 200):
        for top in (3, 10**6):
            z = r.integers(0, top, n).astype(float)
            want = {(i, j) for i in range(n) for j in range(i + 1, n) if z[j] < z[i]}
            i, j = robust.inverted(z)
            assert robust.inversions(z) == len(want) and set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


def test_halfway():
    for low, high in ((1.0, 2.0), (-2.0, 3.0), (-5.0, -1.0), (0.0, 5e-324 * 4)):
        assert low <= robust._halfway(low, high) <= high
    assert low < robust._halfway(-1.0, 1.0) + 1e-9 and robust._halfway(np.nextafter(1.0, 0), 1.0) < 1.0


@pytest.mark.parametrize(("block", "pairs"), [(1 << 16, robust.PAIRS), (100, 500), (64, 64)])
def test_line_equals_all_pairs(spark, block, pairs):
    """Many points by blocks, some with equal x or y, outliers, all on one line; the same as pairs of all."""
    r = np.random.default_rng(block)
    x = np.sort(r.uniform(0, 100, 2048))
    data = {
        "line": (x, 3 - 0.25 * x + r.normal(0, 0.5, len(x)) + np.where(r.uniform(size=len(x)) < 0.3, r.normal(40, 9, len(x)), 0)),
        "grid": (r.integers(0, 40, 500).astype(float), r.integers(-5, 5, 500).astype(float)),
        "steep": (x[:700] * 1e-9, 1e6 * r.normal(size=700)),
        "two": (np.array([1.0, 3.0]), np.array([5.0, 1.0])),
    }
    rounds = []
    got = {g.k: g.slope for g in robust.slopes(frame(spark, **data, same=(np.ones(300), np.arange(300))), "k", "x", "y", block=block, pairs=pairs, rounds=rounds).collect()}
    assert set(got) == set(data)  # a key with one x has no slope
    for k, (a, b) in data.items():
        assert got[k] == pytest.approx(pairwise(a, b), rel=1e-12, abs=1e-15), k
    assert bool(rounds) and len(rounds) < 40


def test_a_million_points_of_one_key(spark):
    """Points of one key on many tasks: half of all slopes lie below the one found, counted on all points at once."""
    n = 1_000_000
    noise = lambda salt: f"(pmod(xxhash64(id, {salt}), 1000003) / 1000003 - 0.5)"
    df = spark.range(n).selectExpr("1 k", "id * 0.01D x", f"7 + id * 0.01D * 0.0002D + {noise(1)} + case when id % 7 = 3 then 9 * {noise(2)} + 3 else 0 end y")
    rounds = []
    m = robust.slopes(df, "k", "x", "y", rounds=rounds).first().slope
    points = df.orderBy("x").toPandas()
    x, y, total = points.x.to_numpy(), points.y.to_numpy(), n * (n - 1) // 2
    below, upto = (robust.inversions(y - s * x) for s in (m - 1e-13, m + 1e-13))
    assert below <= (total - 1) // 2 and upto >= total // 2 and upto - below < 1_000_000 and len(rounds) < 12
    assert m == pytest.approx(0.0002, rel=1e-2)


def test_points_that_are_none(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", None, 2.0), ("a", 0.0, 1.0), ("a", 2.0, 5.0), ("a", math.inf, 1.0), (None, 1.0, 1.0), (None, 2.0, 1.0), ("b", 1.0, 1.0)], "k string, x double, y double")
    assert [tuple(r) for r in robust.theil_sen(df.dropna(), "k", "x", "y").collect()] == [("a", 2.0, 1.0)]
    assert [tuple(r) for r in robust.slopes(df, "k", "x", "y").collect()] == [("a", 2.0)]
    assert robust.theil_sen(df.where("false"), "k", "x", "y").count() == 0

"""Queries whose frames are numbered within their track."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sonolith.plans import catalogue, roles
from tests.signal.test_oracles import SF, canonical

RANKED = ["sfm_tonality", "tonal_peaks", "nmr_per_frame", "nmr_time_grid", "critical_window", "gcc_phat_lag", "phase_shift"]


@pytest.mark.parametrize("name", RANKED)
def test_frames_are_numbered_within_their_track(spark, name):
    sql = catalogue.SQL[name]
    assert "row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS t" in sql
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert canonical(catalogue.QUERIES[name](spark, SF).toPandas()) == canonical(duck.sql(sql).df())


def test_any_stretch_gives_the_same_numbers(spark):
    want = {r.vec_id: (r.track, r.t) for r in roles.ranked_frames(spark, SF).collect()}
    assert {r.vec_id: (r.track, r.t) for r in roles.ranked_frames(spark, SF, 7).select("vec_id", "track", "t").collect()} == want
    tops = roles.ranked_frames(spark, SF, 7).groupBy("track").agg(F.max("t").alias("top"), F.count("*").alias("n"), F.countDistinct("t").alias("d")).collect()
    assert all(r.top + 1 == r.n == r.d for r in tops)

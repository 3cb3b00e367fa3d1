"""Every query with SQL against DuckDB on the smallest tables, and a proof that the harness notices faults."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from sonolith.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def canonical(df: pd.DataFrame) -> list[tuple]:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "NULL"
        if isinstance(v, str) or hasattr(v, "year"):
            return str(v)
        return f"{float(v) + 0.0:.7g}"

    return sorted(tuple(cell(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
    assert len(want)


def test_wrong_query_is_noticed(spark, duck):
    sql = catalogue.SQL["pair_gain_polarity"].replace("0.8::DOUBLE", "0.81::DOUBLE")
    assert canonical(catalogue.QUERIES["pair_gain_polarity"](spark, SF).toPandas()) != canonical(duck.sql(sql).df())


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)

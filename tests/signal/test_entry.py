"""The driver's entry with and without the training-data subpackage."""

import sys

import __spark_entry__
from sonolith.plans import catalogue


def test_queries_without_training_data(monkeypatch):
    for missing in ("sonolith.llm", "corpus_pipeline"):
        monkeypatch.setitem(sys.modules, missing, None)
    assert __spark_entry__.queries() == catalogue.QUERIES and __spark_entry__.oracle_sql() == catalogue.SQL


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries()) and len(catalogue.QUERIES) == len(catalogue.SQL)

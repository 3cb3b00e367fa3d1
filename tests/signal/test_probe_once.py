"""A probe's document is parsed once a row."""

from sonolith.plans import metadata
from tests.signal.test_oracles import SF


def test_documents_are_parsed_once(spark):
    plan = metadata.probe_json(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1

"""Registered blocks of documents are found on the document's own row."""

from invoicelines.plans.queries import QUERIES

from .conftest import SMALL


def test_blocks_shuffle_no_line(spark):
    plan = QUERIES["blocks_modern"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("collect_list(") == 1  # the rendering's; no lines are gathered
    assert "explode(" not in plan

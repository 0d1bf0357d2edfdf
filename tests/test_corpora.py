"""Texts of the derived corpora: made once, after their rows are dealt out."""

import re

import pytest
from pyspark.sql import functions as F

from cilode.catalog import corpora

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("made", [corpora.workflows, corpora.json_workflows])
def test_filters_on_texts_stay_above_the_dealing(spark, made):
    texts = made(spark, FOLDER).where(F.col("path").endswith("1.yml") | F.contains(F.lower("text"), F.lit("api-level")))
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    below = plan[re.search(r"^\W*RepartitionByExpression", plan, re.MULTILINE).start() :]
    assert "api-level" in plan and "api-level" not in below
    # In the filter stands the column, not what it is made of.
    assert plan.count("emulator-options: tail") + plan.count('"emulator-options": "tail"') == 1


def test_texts_are_those_of_the_expressions(spark):
    orders = corpora._orders(spark, FOLDER)
    want = orders.select(F.expr(corpora.WORKFLOW_PATH).alias("path"), F.expr(corpora.WORKFLOW_TEXT).alias("text"))
    got = corpora.workflows(spark, FOLDER)
    assert got.count() == want.count() and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()

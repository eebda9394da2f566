"""What the planner makes of the queries: no join without keys, pushed filters, pruned columns."""

import os

import pytest
from pyspark.sql import functions as F

from sievelark.operators import instants, recall
from sievelark.plans import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
#: Queries that run jobs while they are planned, or join one small row by an inequality on purpose.
SKIP = {"stream_apply", "stream_daily"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in SKIP])
def test_no_keyless_join(spark, name):
    text = plan(queries.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


def test_filters_reach_the_scan(spark):
    text = plan(queries.QUERIES["recency_filter"](spark, DATA))
    assert "GreaterThanOrEqual(fetched_at" in text and "ReadSchema: struct<item_ord:bigint,fetched_at:timestamp_ntz>" in text


def test_typed_times_stay_in_the_jvm(spark):
    text = plan(instants.p3_found(spark, DATA))
    assert "Python" not in text and "BroadcastHashJoin" in text


def test_top_k_is_no_full_sort(spark):
    df = spark.range(1000).select(F.col("id").alias("item_ord"))
    assert "TakeOrderedAndProject" in plan(recall.top_k(df, 5, [F.col("item_ord").desc()]))

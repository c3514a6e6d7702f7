"""Plan checks: no Python evaluation nodes, no cartesian or nested-loop joins,
and single-partition exchanges below partial aggregates only."""

import os
import re

import pytest

from promolift.plans.pipeline import PromoPipeline
from promolift.sources import testtables as tt

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")

FORBIDDEN = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas",
             "CartesianProduct", "BroadcastNestedLoopJoin")


def executed_plan(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def single_partition_feeds(plan: str) -> list[str]:
    """The operator directly below each SinglePartition exchange."""
    lines = plan.split("\n")
    out = []
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line and i + 1 < len(lines):
            out.append(re.sub(r"^[\s:+\-|*()0-9]*", "", lines[i + 1]))
    return out


@pytest.fixture(scope="module")
def pipelines(spark):
    return {m: PromoPipeline(tt.shop_lines(spark, SF), tt.shop_orders(spark, SF), tt.shop_campaigns(spark),
                             min_units=500, materialized=m) for m in (False, True)}


@pytest.fixture(scope="module")
def pipeline(pipelines):
    return pipelines[False]


@pytest.mark.parametrize("materialized", [False, True])
@pytest.mark.parametrize("stage", ["line_margin", "products", "classified", "campaign_eval",
                                   "recommendations"])
def test_stage_plans(pipelines, stage, materialized):
    pipeline = pipelines[materialized]
    plan = executed_plan(getattr(pipeline, stage + "_plan", None) or getattr(pipeline, stage))
    for bad in FORBIDDEN:
        assert bad not in plan, (stage, bad)
    for feed in single_partition_feeds(plan):
        # one row per task
        assert feed.startswith(("HashAggregate", "ObjectHashAggregate", "SortAggregate")) and "partial_" in feed, (stage, feed)


def test_segments_and_scan_plans(spark, pipeline):
    from promolift.operators import privacy as PV
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang", "source")
    for df in (pipeline.segments(), PV.pii_value_scan(docs, "documents")):
        plan = executed_plan(df)
        for bad in FORBIDDEN:
            assert bad not in plan

"""Physical-plan properties of the headline queries (what the plan review checks)."""

import re

import pytest

from conftest import SF_SMALL
from tailorspark.plans.registry import all_queries


def executed_plan(spark, name):
    df = all_queries()[name](spark, SF_SMALL)
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["recent_signals", "event_sequences", "recent_events"])
def test_top_k_per_user_is_group_limited(spark, name):
    assert "WindowGroupLimit" in executed_plan(spark, name)


@pytest.mark.parametrize("name", ["training_frame", "coldstart_table", "coldstart_resolve", "personalize_cold",
                                  "product_picks", "recent_signals", "event_sequences", "merge_small_clusters"])
def test_no_cross_products(spark, name):
    plan = executed_plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_backoff_levels_are_broadcast(spark):
    plan = executed_plan(spark, "coldstart_resolve")
    joins = re.findall(r"BroadcastHashJoin \[([^\]]*)\], \[([^\]]*)\], LeftOuter", plan)
    level_joins = [j for j in joins if "region" in j[0] or "source" in j[0] or "medium" in j[0]
                   or "category" in j[0]]
    assert len(level_joins) >= 9


def test_scans_are_pruned(spark):
    plan = executed_plan(spark, "recent_signals")
    schemas = re.findall(r"events\.parquet.*?ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all("value" not in s for s in schemas)


def test_segment_name_takes_the_pages_own_training_frame(spark, monkeypatch):
    from tailorspark.plans import q_pages

    def again(*_, **__):
        raise AssertionError("the events are rolled up a second time")

    monkeypatch.setattr(q_pages, "training_frame", again)
    rows = q_pages.q_segment_name(spark, SF_SMALL).collect()
    assert rows and all(r["segment_name"] and r["shifted_name"] for r in rows)

"""Physical plans: what must and must not appear."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from palisade.plans.relational import j5
from palisade.session import tasks_for
from palisade.sources.tables import Tables


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def run(spark, sf, name):
    return plan(entry.queries()[name](spark, sf))


def test_range_filter_is_pushed(spark, sf):
    text = run(spark, sf, "p5_price_range")
    assert "p_retailprice,930.5)" in text and "LessThanOrEqual(p_retailprice" in text
    assert "p_name" not in text.split("ReadSchema")[1]


def test_product_search_is_pushed_and_pruned(spark, sf):
    text = run(spark, sf, "p7_product_search")
    assert "PushedFilters" in text and "GreaterThanOrEqual(p_retailpr" in text
    assert "p_brand" not in text.split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["j8_rule_match", "j11_typosquat", "j10_interval", "j9_asof", "d16_signature", "r3_correlate"])
def test_no_cross_product(spark, sf, name):
    text = run(spark, sf, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_vectors_are_broadcast(spark, sf):
    assert "BroadcastHashJoin" in run(spark, sf, "j12_classify")


def test_scan_without_shuffle(spark, sf):
    assert "Exchange hashpartitioning" not in run(spark, sf, "d1_secrets")


def test_top_k_is_trimmed_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in run(spark, sf, "w6_topk")


def test_global_top_keeps_k_rows(spark, sf):
    assert "TakeOrderedAndProject" in run(spark, sf, "o3_top_global")


def test_shared_folder_is_required_on_a_cluster(monkeypatch):
    from palisade.session import shared_dir

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:1"

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_tasks_follow_the_rows(spark, sf):
    """A task's share of a table's rows is bounded; j5 tells orders apart in that many tasks."""
    assert tasks_for(spark.range(100), rows=10) == 10 and tasks_for(spark.range(100)) == 4
    plan = j5(Tables(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in plan

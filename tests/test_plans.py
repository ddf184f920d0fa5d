"""Plan guards for scale: no registered query plans a cartesian product or
a nested-loop join, per-group top-k runs as a partial WindowGroupLimit
before its shuffle, and event filters reach the parquet scan."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL

STREAMS = {n for n in E.queries() if n.startswith("stream_")}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(E.queries()) - STREAMS))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["related_products", "wishlist_preview"])
def test_group_top_k_is_limited_before_shuffle(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_event_filter_pushed_to_scan(spark):
    plan = _plan(E.queries()["cart_view"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)" in plan

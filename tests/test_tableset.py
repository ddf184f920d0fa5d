"""Tables that change together."""

import pytest
from pyspark.sql import functions as F

from shopframe.functions import pricing as R
from shopframe.operators import checkout as CO
from shopframe.sources import sinks as K
from shopframe.sources.tableset import Conflict, TableSet

NAMES = ["products", "product_variants", "cart_items", "orders", "order_items", "order_addresses", "order_status_history"]
NOW = "2024-02-01 00:00:00"


def state(held):
    t = held.load()
    return {n: t[n].count() for n in NAMES} | {"stock": t["product_variants"].agg(F.sum("stock")).first()[0]}


@pytest.fixture
def held(spark, t_small, tmp_path):
    out = TableSet(spark, f"file://{tmp_path}/shop")
    out.commit({n: t_small[n] for n in NAMES})
    return out


def test_checkout_commits_as_one(held, t_small):
    before = state(held)
    out = CO.commit_checkout(held, t_small["checkout_requests"], R.ts_literal(NOW))
    after, taken = state(held), out.where("accepted").count()
    assert taken > 0 and after["orders"] == before["orders"] + taken
    assert after["order_addresses"] == before["order_addresses"] + taken
    sold = held.load()["order_items"].count() - before["order_items"]
    assert before["cart_items"] - after["cart_items"] >= sold > 0
    new = held.load()["order_items"].join(held.load()["orders"].where(f"created_at = timestamp'{NOW}'").select(
        F.col("id").alias("order_id")), "order_id", "left_semi")
    assert before["stock"] - after["stock"] == new.agg(F.sum("quantity")).first()[0]
    # Run again: the carts of those users are gone.
    assert CO.commit_checkout(held, t_small["checkout_requests"].where("seq < 0"), R.ts_literal(NOW)).count() == 0


@pytest.mark.parametrize("stop_at", range(7))
def test_a_stopped_commit_leaves_the_old_state(held, t_small, monkeypatch, stop_at):
    before, calls = state(held), []
    real_write, real_publish = TableSet._write, type(held.folder).publish

    def step(real):
        def run(self, *a):
            if len(calls) == stop_at:
                raise RuntimeError("lost")
            calls.append(1)
            return real(self, *a)
        return run

    monkeypatch.setattr(TableSet, "_write", step(real_write))
    monkeypatch.setattr(type(held.folder), "publish", step(real_publish))
    with pytest.raises(RuntimeError, match="lost"):
        CO.commit_checkout(held, t_small["checkout_requests"], R.ts_literal(NOW))
    monkeypatch.undo()
    assert held.version == 1 and state(held) == before
    CO.commit_checkout(held, t_small["checkout_requests"], R.ts_literal(NOW))
    assert held.version == 2 and state(held)["orders"] > before["orders"]


def test_versions_conflicts_and_cleaning(spark, tmp_path):
    held = TableSet(spark, f"file://{tmp_path}/t")

    def rows(*v):
        return spark.createDataFrame([(x,) for x in v], "k long").coalesce(1)
    v1 = held.commit({"a": rows(1), "b": rows(10)})
    reader = held.load()
    held.commit({"a": rows(2)}, {"b": rows(11)}, version=v1)
    assert [r.k for r in reader["a"].collect()] == [1]              # a reader of the version before
    with pytest.raises(Conflict):
        held.commit({"a": rows(3)}, version=v1)
    with pytest.raises(KeyError):
        held.commit(append={"c": rows(1)})
    for i in range(5):
        held.commit({"a": rows(i)})
    t = held.load()
    assert [r.k for r in t["a"].collect()] == [4] and sorted(r.k for r in t["b"].collect()) == [10, 11]
    assert len(held.folder.names("manifest")) == 2 and len(held.folder.names("data")) <= 4


def test_written_result_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    df = spark.range(100).mapInArrow(count, "id long")
    assert K.write_result(df, f"file://{tmp_path}/r") == 100 == seen.value
    assert spark.read.parquet(f"file://{tmp_path}/r/_total").first().total == 100
    assert spark.read.parquet(f"file://{tmp_path}/r/rows").count() == 100
    assert K.write_result(spark.range(0), f"file://{tmp_path}/e", fmt="json") == 0

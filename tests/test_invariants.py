"""SURVEY §5 invariants: one cart row per key, deterministic replays,
conserved stock deltas, non-negative totals outside the live policy."""

from pyspark.sql import functions as F

from shopframe.functions import pricing as R
from shopframe.operators import cart_fold as CF
from shopframe.operators import checkout as CO
from shopframe.operators import coupons as Q


def test_one_cart_row_per_key_and_deterministic(t_small):
    new1, out1 = CF.apply_cart_commands(t_small["cart_items"], t_small["cart_commands"],
                                        t_small["product_variants"])
    assert new1.groupBy("id").count().where("count > 1").count() == 0
    # A key gets no second line; stored duplicates stay as they were.
    key = ["user_id", "variant_id"]
    before = t_small["cart_items"].groupBy(*key).count().withColumnRenamed("count", "b")
    after = new1.groupBy(*key).count().join(before, key, "left")
    assert after.where("count > greatest(coalesce(b, 0), 1)").count() == 0
    new2, out2 = CF.apply_cart_commands(t_small["cart_items"], t_small["cart_commands"],
                                        t_small["product_variants"])
    assert sorted(new1.collect()) == sorted(new2.collect())
    assert sorted(out1.collect()) == sorted(out2.collect())
    assert out1.count() == t_small["cart_commands"].count()


def test_checkout_stock_deltas_conserved(t_small):
    res = CO.checkout(t_small, t_small["checkout_requests"], R.ts_literal("2024-02-01 00:00:00"), "cod")
    taken = res["stock_deltas"].agg(F.sum("delta")).first()[0] or 0
    items = res["order_items"].agg(F.sum("quantity")).first()[0] or 0
    assert taken == -items
    before = t_small["product_variants"].agg(F.sum("stock")).first()[0]
    after = CO.apply_stock_deltas(t_small["product_variants"], res["stock_deltas"]).agg(F.sum("stock")).first()[0]
    assert after == before + taken
    # every accepted order's items equal its user's cart lines
    n_orders = res["orders"].count()
    assert res["outcomes"].where("accepted").count() == n_orders


def test_totals_non_negative_except_live(t_small):
    now = R.ts_literal("1996-06-01 00:00:00")
    for policy in ("strict", "order", "gateway"):
        q = Q.apply_coupons(t_small["coupon_requests"], t_small["coupons"], t_small["coupon_usages"], now, policy)
        assert q.where(F.col("final_amount") < 0).count() == 0


def test_fcfs_leaves_no_negative_stock_on_fixture(t_small):
    res = CO.checkout(t_small, t_small["checkout_requests"], R.ts_literal("2024-02-01 00:00:00"), "cod",
                      stock_policy="fcfs")
    after = CO.apply_stock_deltas(t_small["product_variants"], res["stock_deltas"])
    assert after.where(F.col("stock") < 0).count() == 0

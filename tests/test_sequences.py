"""Several requests on one key, rejected ones first: the batch operators give
what a handler gives that takes the requests one after another."""

import datetime as dt

from pyspark.sql import functions as F

from shopframe.functions import pricing as R
from shopframe.operators import changes as G
from shopframe.operators import checkout as CO
from shopframe.operators import reviews as V

NOW = "2024-02-01 00:00:00"


def by(df, key, *cols):
    return {r[key]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


def test_register_ranks_valid_requests_only(spark):
    users = spark.createDataFrame([(1, "A", "B", "a@x", None, 0)],
                                  "id long, first_name string, last_name string, email string, provider string, is_admin int")
    req = spark.createDataFrame([(1, " ", "B", "n@x"), (2, "N", "B", "N@x"), (3, "N", "B", "n@x"), (4, "C", "D", "A@x"),
                                 (5, "E", "F", ""), (6, None, "F", "k@x"), (7, "E", "F", "k@x")],
                                "seq long, first_name string, last_name string, email string")
    new, out = G.register_users(users, req)
    assert by(out, "seq", "reason") == {1: "missing_fields", 2: None, 3: "email_taken", 4: "email_taken",
                                        5: "missing_fields", 6: "missing_fields", 7: None}
    assert by(new, "id", "email") == {1: "a@x", 3: "N@x", 8: "k@x"}
    admin = req.withColumn("is_admin", F.col("seq") % 2)
    new, _ = G.register_users(users, admin, check_email=False, trim_check=False)
    assert by(new.where("id > 1"), "id", "is_admin")[1 + 7] == 1


def test_user_edits(spark):
    users = spark.createDataFrame([(i, "F", "L", f"u{i}@x", None, 0) for i in range(1, 5)],
                                  "id long, first_name string, last_name string, email string, provider string, is_admin int")
    req = spark.createDataFrame([(1, 1, "A", "B", "u2@x"), (2, 1, "A", "B", "new@x"), (3, 2, "C", "D", "NEW@x"),
                                 (4, 1, "A2", "B2", "own@x"), (5, 3, "", "D", "q@x"), (6, 4, "E", "F", "q@x")],
                                "seq long, user_id long, first_name string, last_name string, email string")
    new, out = G.edit_users(users, req)
    assert by(out, "seq", "reason") == {1: "email_taken", 2: None, 3: "email_taken", 4: None, 5: "missing_fields", 6: None}
    assert by(new, "id", "first_name", "email") == {1: ("A2", "own@x"), 2: ("F", "u2@x"), 3: ("F", "u3@x"), 4: ("E", "q@x")}
    assert new.count() == 4


def test_review_delete_then_update(spark):
    reviews = spark.createDataFrame([(i, i, 1, 5, "t", "c", dt.datetime(2024, 1, i)) for i in range(1, 5)],
                                    "id long, user_id long, product_id long, rating int, title string, comment string, "
                                    "created_at timestamp_ntz")
    req = spark.createDataFrame([(1, 1, 1, "delete", 1, "x", "x"), (2, 1, 1, "update", 2, "x", "x"),
                                 (3, 2, 9, "delete", 1, "x", "x"), (4, 2, 2, "update", 3, "y", "y"),
                                 (5, 2, 2, "update", 4, "z", "z"), (6, 3, 3, "update", 1, "x", "x"), (7, 3, 3, "delete", 1, "", "")],
                                "seq long, review_id long, user_id long, op string, rating int, title string, comment string")
    new, out = G.edit_reviews(reviews, req)
    assert by(out, "seq", "accepted") == {1: True, 2: False, 3: False, 4: True, 5: True, 6: True, 7: True}
    assert by(new, "id", "rating") == {2: 4, 4: 5}


def test_admin_review_order_is_by_id(spark):
    df = spark.createDataFrame([(1, 5, "2024-01-09"), (2, 4, "2024-01-01"), (3, 5, "2024-01-05")],
                               "id long, rating int, created_at string")
    assert [r.id for r in V.sort_reviews(df, "latest").collect()] == [3, 2, 1]
    assert [r.id for r in V.sort_reviews(df, "admin_oldest").collect()] == [1, 2, 3]
    assert [r.id for r in V.sort_reviews(df, "newest").collect()] == [1, 3, 2]
    assert [r.id for r in V.sort_reviews(df, "oldest").collect()] == [2, 3, 1]


def test_product_updates_keep_earlier_images(t_small):
    p = t_small["products"]
    one = p.orderBy("id").limit(1)
    base = one.withColumn("seq", F.lit(1)).withColumn("image1", F.lit("first.jpg"))
    nxt = one.withColumn("seq", F.lit(2)).withColumn("image1", F.lit(None).cast("string")).withColumn("name", F.lit("N2")) \
        .withColumn("is_gifting", F.lit(None).cast(p.schema["is_gifting"].dataType))
    nameless = one.withColumn("seq", F.lit(3)).withColumn("id", F.lit(None).cast("long")).withColumn("name", F.lit(""))
    new = G.upsert_products(p, base.unionByName(nxt).unionByName(nameless))
    was, now = one.first(), new.where(F.col("id") == one.first().id).first()
    assert (now.name, now.image1, now.is_gifting, now.image2) == ("N2", "first.jpg", was.is_gifting, was.image2)
    assert new.count() == p.count()


def test_variant_requests(t_small):
    v = t_small["product_variants"]
    one = v.orderBy("id").limit(1)
    first = one.first()

    def req(seq, **kw):
        d = one.withColumn("seq", F.lit(seq))
        for k, x in kw.items():
            d = d.withColumn(k, F.lit(x).cast(v.schema[k].dataType))
        return d
    batch = req(1, id=None, sku="S-NEW", price=0).unionByName(req(2, id=None, sku="S-NEW")) \
        .unionByName(req(3, id=None, sku="S-NEW")).unionByName(req(4, product_id=999, stock=77)).unionByName(req(5, price=0))
    new, out = G.upsert_variants(v, batch)
    assert by(out, "seq", "reason") == {1: "missing_fields", 2: None, 3: "duplicate_sku", 4: None, 5: "missing_fields"}
    now = new.where(F.col("id") == first.id).first()
    assert (now.product_id, now.stock, now.sku) == (first.product_id, 77, first.sku)
    assert new.count() == v.count() + 1


def test_message_edit_then_toggle(spark):
    messages = spark.createDataFrame([(1, "n", "e", None, "m", 1), (2, "n", "e", None, "m", 1)],
                                     "id long, name string, email string, phone string, message string, status int")
    req = spark.createDataFrame([(1, 1, "n2", "e2", None, "m2", 1), (2, 1, None, None, None, None, 0),
                                 (3, 2, None, None, None, None, 0)],
                                "seq long, id long, name string, email string, phone string, message string, status int")
    got = by(G.edit_messages(messages, req), "id", "name", "message", "status")
    assert got == {1: ("n2", "m2", 0), 2: ("n", "m", 0)}


def orders_frame(t_small, spark):
    o = t_small["orders"]
    ids = [r.id for r in o.orderBy("id").limit(3).collect()]
    o = o.where(F.col("id").isin(ids)).withColumn("created_at", R.ts_literal(NOW)).withColumn("user_id", F.col("id"))
    o = o.withColumn("status", F.lit("pending")).withColumn(
        "payment_status", F.when(F.col("id") == ids[0], "paid").otherwise("pending"))
    return {**t_small, "orders": o}, ids


def test_cancel_by_a_stranger_first(spark, t_small):
    t, (a, b, c) = orders_frame(t_small, spark)
    req = spark.createDataFrame([(1, a, -5), (2, a, a), (3, a, a), (4, b, b)], "seq long, order_id long, user_id long")
    res = CO.customer_cancel(t, req, R.ts_literal(NOW))
    assert by(res["outcomes"], "seq", "reason") == {1: "not_found", 2: None, 3: "not_cancellable", 4: None}
    assert by(res["orders"], "id", "status") == {a: "cancelled", b: "cancelled", c: "pending"}
    assert res["status_history"].count() == 2


def test_status_changes_in_order(spark, t_small):
    t, (a, b, c) = orders_frame(t_small, spark)
    steps = ["processing", "cancelled", "cancelled", "processing", "cancelled", "shipped"]
    req = spark.createDataFrame([(i, a, s, None) for i, s in enumerate(steps)] + [(9, b, "cancelled", "x"), (10, -1, "y", None)],
                                "seq long, order_id long, status string, comment string")
    res = CO.admin_set_status(t, req, R.ts_literal(NOW))
    assert by(res["orders"], "id", "status") == {a: "shipped", b: "cancelled", c: "pending"}
    assert res["status_history"].where(F.col("order_id") == a).count() == 6
    assert by(res["outcomes"], "seq", "accepted")[10] is False
    ordered = t["order_items"].where(F.col("order_id") == a).agg(F.sum("quantity")).first()[0]
    assert res["stock_deltas"].agg(F.sum("delta")).first()[0] == 2 * ordered     # paid, cancelled twice; b was not paid


def test_payment_changes_in_order(spark, t_small):
    t, (a, b, c) = orders_frame(t_small, spark)
    req = spark.createDataFrame([(1, a, "paid", None), (2, a, "refunded", None), (3, a, "paid", None), (4, b, "paid", None),
                                 (5, b, "failed", "x"), (6, b, "pending", None)],
                                "seq long, order_id long, payment_status string, comment string")
    res = CO.admin_set_payment(t, req, R.ts_literal(NOW))
    assert by(res["outcomes"], "seq", "reason") == {1: None, 2: None, 3: "gateway_only", 4: "gateway_only", 5: None, 6: None}
    assert by(res["orders"], "id", "payment_status") == {a: "refunded", b: "pending", c: "pending"}
    assert res["payment_history"].count() == 4

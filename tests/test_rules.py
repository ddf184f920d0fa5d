"""Edge frames for predicates, display helpers and pricing rules
(FIXTURES.md §3)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shopframe.functions import predicates as P
from shopframe.functions import pricing as R
from shopframe.functions import text as T
from shopframe.operators import catalog as C
from shopframe.operators import coupons as Q
from shopframe.operators import reviews as V


def test_price_spec_parsing():
    assert P.parse_price_spec("0-1000,4000+") == [(0.0, 1000.0, False), (4000.0, None, True)]
    assert P.parse_price_spec("") == []
    # '4000 ' (a '+' decoded to a space) is BETWEEN 4000 AND NULL
    assert P.parse_price_spec("4000 ") == [(4000.0, None, False)]
    assert P.parse_price_spec("abc-5") == [(None, 5.0, False)]


def test_price_filter_bounds_inclusive(spark):
    df = spark.createDataFrame([(Decimal("1000.00"),), (Decimal("4000.00"),), (Decimal("3999.99"),),
                                (Decimal("0.00"),)], "price decimal(10,2)")
    got = sorted(r.price for r in df.where(P.price_filter("0-1000,4000+")).collect())
    assert got == [Decimal("0.00"), Decimal("1000.00"), Decimal("4000.00")]
    assert df.where(P.price_filter("4000 ")).count() == 0
    assert df.where(P.price_filter(None)).count() == 4


def test_finish_filter_rose_is_not_rose_gold(spark):
    df = spark.createDataFrame([("Rose Gold",), ("rose",), (None,)], "finish string")
    assert [r.finish for r in df.where(P.finish_filter("Rose")).collect()] == ["rose"]


@pytest.mark.parametrize("value,text", [
    (None, "0"), ("0", "0"), ("999", "999"), ("1000", "1,000"), ("1234567.5", "12,34,567.5"),
    ("₹1,200", "1,200"), ("-5", "5"), ("abc", "0"), ("12.3456", "12.346"), ("100000", "1,00,000"),
    ("1.2.3", "1.2"),
])
def test_format_price(spark, value, text):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(T.format_price("v").alias("t")).first().t == text


def test_text_helpers(spark):
    df = spark.createDataFrame([("Ann", None, "ann@x.com", 3, "gold", "", 0, "a<b&c>", "for-her")],
                               "f string, l string, e string, r int, fin string, len string, "
                               "stock int, m string, g string")
    r = df.select(T.customer_name("f", "l").alias("cn"), T.reviewer_name("f", "l", "e").alias("rn"),
                  T.stars("r").alias("st"), T.variant_label("fin", "len").alias("vl"),
                  T.stock_label("stock").alias("sl"), T.html_escape("m").alias("h"),
                  C.gift_title("g").alias("gt"), T.slug_title(F.lit("rose-gold-rings")).alias("slug"),
                  T.coupon_code(F.lit("  save10 ")).alias("cc"),
                  T.payment_label(F.lit("partial_refund")).alias("pl")).first()
    assert r.cn == "Guest" and r.rn == "Ann" and r.st == "★★★☆☆" and r.vl == "gold"
    assert r.sl == "OUT OF STOCK" and r.h == "a&lt;b&amp;c&gt;" and r.gt == "Gifts for Her"
    assert r.slug == "Rose Gold Rings" and r.cc == "SAVE10" and r.pl == "partial refund"


def test_cancel_window_boundary(spark):
    now = R.ts_literal("2024-01-04 00:00:00")
    df = spark.createDataFrame([
        (dt.datetime(2024, 1, 1, 0, 0, 0), "pending"),            # exactly 3.0 days
        (dt.datetime(2023, 12, 31, 23, 59, 59, 999000), "pending"),  # 3 days + 1 ms
        (dt.datetime(2024, 1, 2), "shipped"),
    ], "created_at timestamp_ntz, status string")
    assert [r.c for r in df.select(R.can_cancel(now).alias("c")).collect()] == [True, False, False]


COUPONS = [
    (1, "PCT", "percent", Decimal("10"), Decimal("100"), Decimal("50"), 1, None, None, None, 0),
    (2, "FLAT", "flat", Decimal("700"), None, Decimal("200"), 1, None, None, None, 0),
    (3, "ZERO", "percent", Decimal("50"), None, Decimal("0"), 1, None, None, None, 0),
    (4, "DATED", "percent", Decimal("10"), None, None, 1, dt.datetime(2020, 1, 1), None, 5, 5),
]
CSCHEMA = ("id int, code string, type string, value decimal(10,2), min_order decimal(10,2), "
           "max_discount decimal(10,2), active int, start_date timestamp_ntz, end_date timestamp_ntz, "
           "usage_limit int, used_count int")


@pytest.mark.parametrize("policy,expected", [
    # (request) -> (accepted, reason, discount, final)
    ("live", {1: (True, None, "50.00", "950.00"), 2: (True, None, "200.00", "300.00"),
              3: (True, None, "250.00", "250.00"), 4: (True, None, "50.00", "450.00"),
              5: (False, "min_order", "0.00", "50.00")}),
    ("order", {1: (True, None, "50.00", "950.00"), 2: (True, None, "700.00", "0.00"),
               3: (True, None, "250.00", "250.00"), 4: (False, "invalid_coupon", "0.00", "500.00"),
               5: (False, "min_order", "0.00", "50.00")}),
    ("gateway", {1: (True, None, "50.00", "950.00"), 2: (True, None, "700.00", "0.00"),
                 3: (True, None, "250.00", "250.00"), 4: (False, "invalid_coupon", "0.00", "500.00"),
                 5: (True, None, "5.00", "45.00")}),
])
def test_coupon_policies(spark, policy, expected):
    coupons = spark.createDataFrame(COUPONS, CSCHEMA)
    usages = spark.createDataFrame([(None, 99)], "coupon_id int, user_id long")
    req = spark.createDataFrame([(1, 7, "pct", Decimal("1000")), (2, 7, "FLAT", Decimal("500")),
                                 (3, 7, "zero", Decimal("500")), (4, 7, "DATED", Decimal("500")),
                                 (5, 7, "PCT", Decimal("50"))],
                                "request_id long, user_id long, code string, subtotal decimal(12,2)")
    out = Q.apply_coupons(req, coupons, usages, R.ts_literal("2024-01-01 00:00:00"), policy)
    got = {r.request_id: (r.accepted, r.reason, str(r.discount), str(r.final_amount)) for r in out.collect()}
    assert got == expected


def test_live_flat_coupon_can_go_negative(spark):
    coupons = spark.createDataFrame([(1, "BIG", "flat", Decimal("900"), None, None, 1, None, None, None, 0)],
                                    CSCHEMA)
    usages = spark.createDataFrame([], "coupon_id int, user_id long")
    req = spark.createDataFrame([(1, 7, "BIG", Decimal("500"))],
                                "request_id long, user_id long, code string, subtotal decimal(12,2)")
    r = Q.apply_coupons(req, coupons, usages, R.ts_literal("2024-01-01 00:00:00"), "live").first()
    assert str(r.final_amount) == "-400.00"


def test_not_in_null_hides_all_coupons(spark):
    coupons = spark.createDataFrame(COUPONS, CSCHEMA)
    usages = spark.createDataFrame([(None, 9), (1, 8)], "coupon_id int, user_id long")
    req = spark.createDataFrame([(9, 1), (9, 2), (8, 1), (8, 2)], "user_id long, coupon_id int")
    now = R.ts_literal("2024-01-01 00:00:00")
    live = {(r.user_id, r.coupon_id): r.available
            for r in Q.coupon_availability(req, coupons, usages, now, "live").collect()}
    assert live == {(9, 1): False, (9, 2): False, (8, 1): False, (8, 2): True}
    strict = {(r.user_id, r.coupon_id): r.available
              for r in Q.coupon_availability(req, coupons, usages, now, "strict").collect()}
    # strict needs both date bounds: none of these coupons has them
    assert set(strict.values()) == {False}


def test_review_stats_rounding(spark):
    products = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    ratings = ([(1, 4)] * 3 + [(1, 5)]            # 4.25 -> 4.3 (half-up), stars round(4.25) = 4
               + [(2, 4)] * 13 + [(2, 5)] * 7     # 4.35 -> 4.4 (half-up on the exact value)
               + [(3, 2)])
    reviews = spark.createDataFrame([(i, 1, p, r) for i, (p, r) in enumerate(ratings)],
                                    "id long, user_id long, product_id long, rating int")
    s = {r.product_id: r for r in V.review_stats({"products": products, "reviews": reviews}).collect()}
    assert str(s[1].average) == "4.3" and s[1].rounded_stars == 4
    assert s[1].summary == "4.3 / 5 · 4 reviews"
    assert str(s[2].average) == "4.4" and s[2].rounded_stars == 4
    assert s[3].summary == "2.0 / 5 · 1 review" and s[3].stars == "★★☆☆☆"
    assert s[4].summary == "No reviews yet" and s[4].stars == "★★★★★" and s[4].total == 0


def test_nested_pages_split_large_groups(spark):
    from shopframe.operators.paging import nested_pages
    df = spark.createDataFrame([(1, i) for i in range(7)] + [(2, 0)], "k long, v long")
    pages = nested_pages(df, "k", [F.col("v").asc()], ["v"], "vals", page_size=3).collect()
    got = sorted((r.k, r.page, [e.v for e in r.vals]) for r in pages)
    assert got == [(1, 1, [0, 1, 2]), (1, 2, [3, 4, 5]), (1, 3, [6]), (2, 1, [0])]


def test_number_rows_hot_group(spark):
    from shopframe.operators.paging import number_rows, running_sums
    rows = [(1, i, 1) for i in range(500)] + [(2, i, 2) for i in range(5)] + [(None, 0, 3)]
    df = spark.createDataFrame(rows, "g long, o long, v long")
    got = {(r.g, r.o): r.position for r in number_rows(df, [F.col("o").asc()], ["g"], num_partitions=8).collect()}
    assert all(got[(1, i)] == i + 1 for i in range(500)) and got[(None, 0)] == 1
    rs = {(r.g, r.o): r.v_cum for r in running_sums(df, ["g"], [F.col("o").asc()], ["v"], num_partitions=8).collect()}
    assert rs[(1, 499)] == 500 and rs[(2, 4)] == 10 and rs[(None, 0)] == 3


def test_write_result_and_json_rows(spark, tmp_path):
    from shopframe.sources import sinks as K
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    K.write_result(df, str(tmp_path / "out"), fmt="json")
    assert spark.read.parquet(str(tmp_path / "out" / "_total")).first().total == 2
    assert spark.read.json(str(tmp_path / "out" / "rows")).count() == 2
    js = sorted(r.json for r in K.to_json_rows(df).collect())
    assert js == ['{"id":1,"name":"a"}', '{"id":2}']
    tot = K.with_total(df).select("total_products").distinct().collect()
    assert [r.total_products for r in tot] == [2]

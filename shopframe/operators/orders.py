"""Order reads: admin list, order lines, nested user orders, admin detail,
receipts, cancellation window, status history (C4-C6, C16-C18, D10-D12,
E5, E11, E12, F4, G24).

Scale notes: the flat forms (``order_item_lines``, ``order_rollup``) are the
scalable outputs; order-level aggregates are decomposable and partially
aggregated before the shuffle on ``order_id``. The nested forms (the API's
response shape) nest an order's lines and history in pages of at most
ITEMS_PER_PAGE elements (``paging.nested_pages``): one row per (order, page),
so however many lines one order has, no group gathers more than a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pricing as R
from ..functions import text as T
from .paging import nested_pages

MONEY = R.MONEY
ITEMS_PER_PAGE = 1000
LINE_ORDER = ["product_id", "variant_id", "quantity", "price", "is_gift"]


def admin_order_list(t) -> DataFrame:
    """C4/H4/H5: every order with its display number, customer name ('Guest'
    when the user is missing or a name part is NULL), money with NULL as 0,
    newest first."""
    o = t["orders"]
    u = t["users"].select(F.col("id").alias("_uid"), "first_name", "last_name", "email")
    j = o.join(u, o["user_id"] == u["_uid"], "left")
    return j.select(
        "id", T.order_number().alias("order_number"),
        T.customer_name().alias("customer_name"), "email",
        F.coalesce("subtotal", F.lit(0).cast(MONEY)).alias("subtotal"),
        F.coalesce("discount", F.lit(0).cast(MONEY)).alias("discount"),
        F.coalesce("grand_total", F.lit(0).cast(MONEY)).alias("grand_total"),
        "coupon_code", "status", "payment_status", "created_at").orderBy(F.col("id").desc())


def recent_orders(t, n: int = 5) -> DataFrame:
    """E5: newest ``n`` orders with the fallback number and the user's names."""
    o = t["orders"].orderBy(F.col("id").desc()).limit(n)
    u = t["users"].select(F.col("id").alias("_uid"), "first_name", "last_name")
    return (o.join(u, o["user_id"] == u["_uid"], "left")
            .select("id", T.order_number().alias("order_number"),
                    F.coalesce("grand_total", F.lit(0).cast(MONEY)).alias("grand_total"),
                    "status", "first_name", "last_name")
            .orderBy(F.col("id").desc()))


def user_order_headers(t) -> DataFrame:
    """Orders of known users with the code of their coupon (left join:
    a deleted coupon gives NULL)."""
    o = t["orders"].where(F.col("user_id").isNotNull())
    c = t["coupons"].select(F.col("id").alias("_cid"), F.col("code").alias("coupon_code"))
    return (o.drop("coupon_code").join(c, o["coupon_id"] == c["_cid"], "left")
            .select("id", "user_id", "order_number", "created_at", "status", "payment_status",
                    "payment_method", "subtotal", "discount", "grand_total", "coupon_code"))


def order_item_lines(t) -> DataFrame:
    """Order lines with the live product name and image (lines of a
    deleted product vanish: inner join) and the variant's sku, finish and
    length (a deleted variant leaves NULLs: left join), line total and the
    'finish / length' label."""
    oi = t["order_items"]
    p = t["products"].select(F.col("id").alias("product_id"), F.col("name").alias("live_name"),
                             F.col("image1").alias("product_image"))
    v = t["product_variants"].select(F.col("id").alias("variant_id"), F.col("sku").alias("variant_sku"),
                                     "finish", "length_size")
    j = oi.join(p, "product_id", "inner").join(v, "variant_id", "left")
    return j.select(
        "order_id", "product_id", "variant_id", F.col("live_name").alias("product_name"),
        "product_image", F.col("variant_sku").alias("sku"), "finish", "length_size",
        "quantity", "price", "is_gift", R.line_total().alias("total"),
        T.variant_label().alias("variant"))


def order_rollup(t) -> DataFrame:
    """Per order: line count, items subtotal and whether a gift line
    exists (over the lines that survive the product join)."""
    return order_item_lines(t).groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("total").cast("decimal(22,2)").alias("items_total"),
        F.bool_or(F.col("is_gift") == 1).alias("has_gift"))


def _address_struct() -> Column:
    return F.struct("type", "name", "phone", "city", "state", "pincode", "country")


def _addresses_by_type(t) -> DataFrame:
    a = t["order_addresses"]
    return a.groupBy("order_id").agg(
        F.max(F.when(F.col("type") == "billing", _address_struct())).alias("billing_address"),
        F.max(F.when(F.col("type") == "shipping", _address_struct())).alias("shipping_address"))


def user_orders(t, now: Column, order: str = "id") -> DataFrame:
    """Each user's orders, nested: header + coupon code +
    ``items`` (name, image, variant label, qty, price) + billing and shipping
    address + ``can_cancel``; one row per (order, page of lines).
    ``order='id'`` is the observable order of the original (id ascending);
    ``'created_at'`` gives its SQL order."""
    h = user_order_headers(t)
    items = nested_pages(order_item_lines(t), "order_id", [F.col(c).asc_nulls_first() for c in LINE_ORDER],
                         ["product_name", "product_image", "variant", "quantity", "price"], "items",
                         ITEMS_PER_PAGE)
    j = (h.join(items, h["id"] == items["order_id"], "left").drop("order_id")
         .join(_addresses_by_type(t), h["id"] == F.col("order_id"), "left").drop("order_id")
         .withColumn("page", F.coalesce("page", F.lit(1)))
         .withColumn("items", F.coalesce("items", F.array().cast(
             "array<struct<pos:bigint,product_name:string,product_image:string,variant:string,"
             "quantity:int,price:decimal(12,2)>>")))
         .withColumn("can_cancel", R.can_cancel(now)))
    if order == "created_at":
        return j.orderBy("user_id", F.col("created_at").desc(), "id", "page")
    return j.orderBy("user_id", "id", "page")


def status_timeline(t) -> DataFrame:
    """Per order, status history ascending by time (id breaks ties),
    in pages of at most ITEMS_PER_PAGE entries (one row per order and page)."""
    h = t["order_status_history"]
    return nested_pages(h, "order_id", [F.col("created_at").asc(), F.col("id").asc()],
                        ["created_at", "id", "status", "comment"], "status_history", ITEMS_PER_PAGE)


def order_details(t) -> DataFrame:
    """C17: admin order detail: the header (C4), has_gift, the billing address
    and the lines with sku and total (one row per order and page of lines).
    Its history is ``status_timeline``."""
    head = admin_order_list(t)
    ol = order_item_lines(t)
    gift = ol.groupBy("order_id").agg(F.bool_or(F.col("is_gift") == 1).alias("has_gift"))
    lines = nested_pages(ol, "order_id", [F.col(c).asc_nulls_first() for c in LINE_ORDER],
                         ["product_name", "sku", "quantity", "price", "is_gift", "total"], "items",
                         ITEMS_PER_PAGE)
    bill = (t["order_addresses"].where(F.col("type") == "billing").groupBy("order_id")
            .agg(F.min(_address_struct()).alias("billing")))
    return (head.join(gift, head["id"] == gift["order_id"], "left").drop("order_id")
            .join(lines, head["id"] == lines["order_id"], "left").drop("order_id")
            .join(bill, head["id"] == bill["order_id"], "left").drop("order_id")
            .withColumn("has_gift", F.coalesce("has_gift", F.lit(False))))


def order_receipts(t) -> DataFrame:
    """Order-success receipt: order, one address (the least by type,
    i.e. billing before shipping, made deterministic) and lines (one row per
    order and page of lines; an order without lines has one row, items NULL)."""
    o = t["orders"].select("id", "order_number", "status", "payment_method", "subtotal",
                           "discount", "grand_total", "created_at")
    addr = t["order_addresses"].groupBy("order_id").agg(F.min(_address_struct()).alias("address"))
    lines = nested_pages(order_item_lines(t), "order_id", [F.col(c).asc_nulls_first() for c in LINE_ORDER],
                         ["product_name", "sku", "quantity", "price", "total"], "items", ITEMS_PER_PAGE)
    return (o.join(addr, o["id"] == addr["order_id"], "left").drop("order_id")
            .join(lines, o["id"] == lines["order_id"], "left").drop("order_id"))


def latest_status(history: DataFrame) -> DataFrame:
    """Current status per order = the status of the latest history row
    (created_at, then id)."""
    return history.groupBy("order_id").agg(
        F.max_by("status", F.struct("created_at", "id")).alias("current_status"),
        F.max("created_at").alias("status_at"))


def status_audit(t) -> DataFrame:
    """Orders whose stored status differs from the latest history row."""
    cur = latest_status(t["order_status_history"])
    o = t["orders"].select("id", "status")
    return (o.join(cur, o["id"] == cur["order_id"], "inner").drop("order_id")
            .withColumn("matches", F.col("status") == F.col("current_status")))

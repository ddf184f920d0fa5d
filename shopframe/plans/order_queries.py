"""Order, review and display-rule queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import pricing as R
from ..functions import text as T
from ..operators import catalog as C
from ..operators import orders as O
from ..operators import paging as G
from ..operators import reviews as V
from .registry import register

# "Now" of the order queries: orders dated 1998-07-31 are exactly 3.0 days old.
ORDERS_NOW = "1998-08-03 00:00:00"

# ---------------------------------------------------------------- orders ----


@register("user_order_headers", "C5", money=("subtotal", "discount", "grand_total"), sql="""
SELECT o.id, o.user_id, o.order_number, o.created_at, o.status, o.payment_status, o.payment_method,
       o.subtotal, o.discount, o.grand_total, c.code AS coupon_code
FROM shop_orders o LEFT JOIN coupons c ON c.id = o.coupon_id WHERE o.user_id IS NOT NULL
""")
def user_order_headers(t):
    return O.user_order_headers(t)


LINES_SQL = """
SELECT oi.order_id, oi.product_id, oi.variant_id, p.name AS product_name, p.image1 AS product_image,
       pv.sku, pv.finish, pv.length_size, oi.quantity, oi.price, oi.is_gift,
       CAST(oi.price * oi.quantity AS DECIMAL(22,2)) AS total,
       concat_ws(' / ', CASE WHEN pv.finish <> '' THEN pv.finish END,
                 CASE WHEN pv.length_size <> '' THEN pv.length_size END) AS variant
FROM order_items oi JOIN products p ON p.id = oi.product_id
LEFT JOIN product_variants pv ON pv.id = oi.variant_id
"""


@register("order_item_lines", "C6 D10 H7", money=("price", "total"), sql=LINES_SQL)
def order_item_lines(t):
    return O.order_item_lines(t)


@register("items_of_pending_orders", "A7", money=("price",), sql="""
SELECT oi.* FROM order_items oi
WHERE oi.order_id IN (SELECT id FROM shop_orders WHERE user_id IS NOT NULL AND status = 'pending')
""")
def items_of_pending_orders(t):
    """Children of many parents at once (the IN (?) batch fetch): a semi
    join of the order lines with the selected orders' ids."""
    o = t["orders"].where(F.col("user_id").isNotNull() & (F.col("status") == "pending"))
    return C.by_ids(t["order_items"], o, "order_id", "id")


@register("order_rollup", "D11 D12", money=("items_total",), sql=f"""
SELECT order_id, COUNT(*) AS n_items, CAST(SUM(total) AS DECIMAL(22,2)) AS items_total,
       bool_or(is_gift = 1) AS has_gift
FROM ({LINES_SQL}) l GROUP BY order_id
""")
def order_rollup(t):
    return O.order_rollup(t)


@register("user_orders_nested", "C16 F4 E12", money=("grand_total", "items_price_sum"), sql=f"""
WITH h AS (
  SELECT o.*, c.code AS cc FROM shop_orders o LEFT JOIN coupons c ON c.id = o.coupon_id
  WHERE o.user_id IS NOT NULL),
l AS (SELECT order_id, COUNT(*) AS n, SUM(price) AS ps, CAST(SUM(length(variant)) AS BIGINT) AS vl
      FROM ({LINES_SQL}) x GROUP BY order_id),
a AS (SELECT order_id, max(CASE WHEN type = 'billing' THEN name END) AS bname,
             max(CASE WHEN type = 'shipping' THEN name END) AS sname,
             max(CASE WHEN type = 'billing' THEN country END) AS bcountry
      FROM order_addresses GROUP BY order_id)
SELECT h.id, h.user_id, h.cc AS coupon_code, h.grand_total, coalesce(l.n, 0) AS n_items,
       l.ps AS items_price_sum, coalesce(l.vl, 0) AS variant_chars,
       CAST(greatest(ceil(coalesce(l.n, 0) / 1000), 1) AS BIGINT) AS n_pages, a.bname AS billing_name,
       a.sname AS shipping_name, a.bcountry AS billing_country,
       coalesce(h.created_at >= TIMESTAMP '{ORDERS_NOW}' - INTERVAL 3 DAY
                AND h.status IN ('pending', 'confirmed'), false) AS can_cancel
FROM h LEFT JOIN l ON l.order_id = h.id LEFT JOIN a ON a.order_id = h.id
""")
def user_orders_nested(t):
    """C16 nested orders (one row per order and page of lines), reported per
    order through aggregates over the pages (item count, price sum, label
    characters, page count) and the address structs."""
    u = O.user_orders(t, R.ts_literal(ORDERS_NOW))
    items = F.col("items")
    per_page = u.select(
        "id", "user_id", "coupon_code", "grand_total", "billing_address", "shipping_address", "can_cancel",
        F.size(items).cast("long").alias("_n"),
        F.aggregate(items, F.lit(None).cast("decimal(22,2)"),
                    lambda acc, i: (F.coalesce(acc, F.lit(0).cast("decimal(22,2)"))
                                    + i["price"]).cast("decimal(22,2)")).alias("_ps"),
        F.aggregate(items, F.lit(0).cast("long"),
                    lambda acc, i: acc + F.length(i["variant"]).cast("long")).alias("_vl"))
    return per_page.groupBy("id", "user_id", "coupon_code", "grand_total", "can_cancel").agg(
        F.sum("_n").cast("long").alias("n_items"), F.sum("_ps").cast("decimal(22,2)").alias("items_price_sum"),
        F.sum("_vl").cast("long").alias("variant_chars"), F.count(F.lit(1)).alias("n_pages"),
        F.first(F.col("billing_address.name")).alias("billing_name"),
        F.first(F.col("shipping_address.name")).alias("shipping_name"),
        F.first(F.col("billing_address.country")).alias("billing_country"))


# The nested lines and addresses again, element by element.
NESTED_SQL = f"""
SELECT row_number() OVER w AS pos, (row_number() OVER w - 1) // 1000 + 1 AS page, l.*
FROM ({LINES_SQL}) l WINDOW w AS (PARTITION BY order_id ORDER BY product_id NULLS FIRST, variant_id NULLS FIRST,
                                  quantity NULLS FIRST, price NULLS FIRST, is_gift NULLS FIRST)
"""


def _elements(pages, fields, name="items"):
    """One row per nested element, with its order, page and position."""
    return pages.select("id", "page", F.explode(name).alias("e")).select("id", "page", *[F.col(f"e.{f}").alias(f) for f in fields])


ADDRESS_FIELDS = ("type", "name", "phone", "city", "state", "pincode", "country")


@register("user_order_lines_nested", "C16 E12", money=("price",), sql=f"""
SELECT o.id, CAST(x.page AS BIGINT) AS page, CAST(x.pos AS BIGINT) AS pos, x.product_name, x.product_image, x.variant,
       x.quantity, x.price
FROM ({NESTED_SQL}) x JOIN shop_orders o ON o.id = x.order_id WHERE o.user_id IS NOT NULL
""")
def user_order_lines_nested(t):
    """Every field of the lines nested in C16, in their order."""
    return _elements(O.user_orders(t, R.ts_literal(ORDERS_NOW)),
                     ["pos", "product_name", "product_image", "variant", "quantity", "price"])


@register("user_order_addresses_nested", "C16", sql=f"""
SELECT o.id, a.kind, {", ".join(f"a.{c}" for c in ADDRESS_FIELDS)} FROM shop_orders o JOIN (
  SELECT order_id, type AS kind, unnest(max(struct_pack({", ".join(f"{c} := {c}" for c in ADDRESS_FIELDS)})))
  FROM order_addresses WHERE type IN ('billing', 'shipping') GROUP BY order_id, type) a ON a.order_id = o.id
WHERE o.user_id IS NOT NULL
""")
def user_order_addresses_nested(t):
    """Every field of the addresses nested in C16."""
    u = O.user_orders(t, R.ts_literal(ORDERS_NOW)).where("page = 1")
    both = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_address").alias("a")) for k in ("billing", "shipping")])
    return u.select("id", F.explode(both).alias("e")).where("e.a IS NOT NULL").select(
        "id", "e.kind", *[F.col(f"e.a.{c}").alias(c) for c in ADDRESS_FIELDS])


@register("order_detail_lines_nested", "C17", money=("price", "total"), sql=f"""
SELECT x.order_id AS id, CAST(x.page AS BIGINT) AS page, CAST(x.pos AS BIGINT) AS pos, x.product_name, x.sku, x.quantity,
       x.price, x.is_gift, x.total
FROM ({NESTED_SQL}) x JOIN shop_orders o ON o.id = x.order_id
""")
def order_detail_lines_nested(t):
    """Every field of the lines nested in C17, in their order."""
    return _elements(O.order_details(t).where("items IS NOT NULL"),
                     ["pos", "product_name", "sku", "quantity", "price", "is_gift", "total"])


@register("order_detail_billing_nested", "C17", sql=f"""
SELECT o.id, {", ".join(f"a.{c}" for c in ADDRESS_FIELDS)} FROM shop_orders o JOIN (
  SELECT order_id, unnest(min(struct_pack({", ".join(f"{c} := {c}" for c in ADDRESS_FIELDS)})))
  FROM order_addresses WHERE type = 'billing' GROUP BY order_id) a ON a.order_id = o.id
""")
def order_detail_billing_nested(t):
    """Every field of the billing address nested in C17."""
    d = O.order_details(t).where("billing IS NOT NULL").where("coalesce(page, 1) = 1")
    return d.select("id", *[F.col(f"billing.{c}").alias(c) for c in ADDRESS_FIELDS])


@register("order_receipt_lines_nested", "C18", money=("price", "total"), sql=f"""
SELECT x.order_id AS id, CAST(x.page AS BIGINT) AS page, CAST(x.pos AS BIGINT) AS pos, x.product_name, x.sku, x.quantity,
       x.price, x.total
FROM ({NESTED_SQL}) x JOIN shop_orders o ON o.id = x.order_id
""")
def order_receipt_lines_nested(t):
    """Every field of the lines nested in C18, in their order."""
    return _elements(O.order_receipts(t).where("items IS NOT NULL"), ["pos", "product_name", "sku", "quantity", "price", "total"])


@register("order_receipt_addresses_nested", "C18", sql=f"""
SELECT o.id, {", ".join(f"a.{c}" for c in ADDRESS_FIELDS)} FROM shop_orders o JOIN (
  SELECT order_id, unnest(min(struct_pack({", ".join(f"{c} := {c}" for c in ADDRESS_FIELDS)})))
  FROM order_addresses GROUP BY order_id) a ON a.order_id = o.id
""")
def order_receipt_addresses_nested(t):
    """Every field of the address nested in C18."""
    r = O.order_receipts(t).where("address IS NOT NULL").where("coalesce(page, 1) = 1")
    return r.select("id", *[F.col(f"address.{c}").alias(c) for c in ADDRESS_FIELDS])


@register("order_details_nested", "C17 D12 H5", money=("grand_total",), sql="""
WITH l AS (SELECT oi.order_id, COUNT(*) AS n, bool_or(oi.is_gift = 1) AS g,
                  COUNT(*) FILTER (WHERE pv.sku IS NULL) AS nosku, CAST(SUM(length(pv.sku)) AS BIGINT) AS skl
           FROM order_items oi JOIN products p ON p.id = oi.product_id
           LEFT JOIN product_variants pv ON pv.id = oi.variant_id GROUP BY oi.order_id),
b AS (SELECT order_id, min(name) AS bname FROM order_addresses WHERE type = 'billing' GROUP BY order_id)
SELECT o.id, coalesce(o.order_number, 'ORD-' || CAST(o.id AS VARCHAR)) AS order_number,
       coalesce(u.first_name || ' ' || u.last_name, 'Guest') AS customer_name,
       coalesce(o.grand_total, 0) AS grand_total,
       coalesce(l.n, 0) AS n_items, coalesce(l.g, false) AS has_gift, coalesce(l.nosku, 0) AS missing_skus,
       coalesce(l.skl, 0) AS sku_chars, b.bname AS billing_name
FROM shop_orders o LEFT JOIN users u ON u.id = o.user_id LEFT JOIN l ON l.order_id = o.id
LEFT JOIN b ON b.order_id = o.id
""")
def order_details_nested(t):
    """C17 admin detail pages, reported per order (item count, gift flag,
    missing / total sku characters, billing name)."""
    d = O.order_details(t)
    items = F.coalesce(F.col("items"), F.array())
    per_page = d.select(
        "id", "order_number", "customer_name", "grand_total", "has_gift", F.col("billing.name").alias("_bn"),
        F.size(items).cast("long").alias("_n"),
        F.size(F.filter(items, lambda i: i["sku"].isNull())).cast("long").alias("_nosku"),
        F.aggregate(items, F.lit(0).cast("long"),
                    lambda acc, i: acc + F.coalesce(F.length(i["sku"]), F.lit(0)).cast("long")).alias("_skl"))
    return per_page.groupBy("id", "order_number", "customer_name", "grand_total", "has_gift").agg(
        F.sum("_n").cast("long").alias("n_items"), F.sum("_nosku").cast("long").alias("missing_skus"),
        F.sum("_skl").cast("long").alias("sku_chars"), F.first("_bn").alias("billing_name"))


@register("order_status_timeline", "E11 C17", sql="""
SELECT order_id, CAST((row_number() OVER w - 1) // 1000 + 1 AS BIGINT) AS page,
       CAST(row_number() OVER w AS BIGINT) AS pos, status, comment, created_at
FROM order_status_history WINDOW w AS (PARTITION BY order_id ORDER BY created_at, id)
""")
def order_status_timeline(t):
    """The nested history pages flattened back to (order, page, pos)."""
    h = O.status_timeline(t)
    return (h.select("order_id", "page",
                     F.explode("status_history").alias("e"))
            .select("order_id", "page", F.col("e.pos").alias("pos"), F.col("e.status").alias("status"),
                    F.col("e.comment").alias("comment"), F.col("e.created_at").alias("created_at")))


@register("order_receipts", "C18", money=("grand_total", "items_total"), sql="""
WITH a AS (SELECT order_id, min(type) AS atype FROM order_addresses GROUP BY order_id),
l AS (SELECT oi.order_id, COUNT(*) AS n, SUM(oi.price * oi.quantity) AS tot
      FROM order_items oi JOIN products p ON p.id = oi.product_id GROUP BY oi.order_id)
SELECT o.id, o.order_number, o.status, o.grand_total, a.atype AS address_type,
       coalesce(l.n, 0) AS n_items, CAST(l.tot AS DECIMAL(22,2)) AS items_total
FROM shop_orders o LEFT JOIN a ON a.order_id = o.id LEFT JOIN l ON l.order_id = o.id
""")
def order_receipts(t):
    r = O.order_receipts(t)
    items = F.coalesce(F.col("items"), F.array())
    per_page = r.select("id", "order_number", "status", "grand_total",
                        F.col("address.type").alias("address_type"),
                        F.size(items).cast("long").alias("_n"),
                        F.aggregate(F.col("items"), F.lit(0).cast("decimal(22,2)"),
                                    lambda acc, i: (acc + i["total"]).cast("decimal(22,2)")).alias("_tot"))
    return per_page.groupBy("id", "order_number", "status", "grand_total", "address_type").agg(
        F.sum("_n").cast("long").alias("n_items"), F.sum("_tot").cast("decimal(22,2)").alias("items_total"))


@register("order_status_audit", "G24", sql="""
SELECT o.id, o.status, h.current_status, h.status_at, o.status = h.current_status AS matches
FROM shop_orders o JOIN (
  SELECT order_id, arg_max(status, (created_at, id)) AS current_status, max(created_at) AS status_at
  FROM order_status_history GROUP BY order_id) h ON h.order_id = o.id
""")
def order_status_audit(t):
    return O.status_audit(t)


@register("order_flags", "F3 F4 F5 F6 H17 H20", sql=f"""
SELECT id, CAST(round(grand_total * 100, 0) AS BIGINT) AS gateway_amount,
  coalesce(created_at >= TIMESTAMP '{ORDERS_NOW}' - INTERVAL 3 DAY AND status IN ('pending', 'confirmed'),
           false) AS can_cancel,
  coalesce(CASE WHEN id % 3 = 0 THEN 'paid' ELSE 'refunded' END <> 'paid' OR payment_status = 'paid',
           false) AS payment_change_allowed,
  coalesce(payment_status = 'paid', false) AS status_editable,
  regexp_replace(payment_status, '^([^_]*)_', '\\1 ') AS payment_label,
  CASE WHEN payment_status = 'paid' THEN '{T.PAID_NOTE}' WHEN payment_status = 'refunded'
       THEN '{T.REFUND_NOTE}' END AS payment_note,
  coalesce(payment_status = 'unpaid', false) AS can_pay_now
FROM shop_orders
""")
def order_flags(t):
    o = t["orders"].withColumn("new_payment_status",
                               F.when(F.col("id") % 3 == 0, "paid").otherwise("refunded"))
    return o.select(
        "id", R.gateway_amount("grand_total").alias("gateway_amount"),
        R.can_cancel(R.ts_literal(ORDERS_NOW)).alias("can_cancel"),
        R.payment_change_allowed().alias("payment_change_allowed"),
        R.status_editable().alias("status_editable"),
        T.payment_label().alias("payment_label"), T.payment_note().alias("payment_note"),
        T.can_pay_now().alias("can_pay_now"))


# --------------------------------------------------------------- reviews ----

@register("product_reviews", "C7 H2 H3 H6", sql="""
SELECT r.id, r.user_id, r.product_id, r.title, r.comment, r.rating, r.created_at,
  strftime(r.created_at, '%d %b %Y') AS created_at_formatted, u.first_name, u.last_name, u.email,
  coalesce(CASE WHEN trim(concat_ws(' ', u.first_name, u.last_name)) <> ''
                THEN trim(concat_ws(' ', u.first_name, u.last_name)) END,
           CASE WHEN split_part(u.email, '@', 1) <> '' THEN split_part(u.email, '@', 1) END,
           'Anonymous') AS user_name,
  repeat('★', r.rating) || repeat('☆', 5 - r.rating) AS stars
FROM reviews r JOIN users u ON u.id = r.user_id
""")
def product_reviews(t):
    return V.product_reviews(t)


ADMIN_REVIEWS_SQL = """
SELECT r.id, r.user_id, r.rating, r.title, r.comment, r.created_at, p.id AS product_id,
       p.name AS product_name, coalesce(p.name, 'Deleted') AS product_label
FROM reviews r LEFT JOIN products p ON p.id = r.product_id
"""


@register("admin_reviews", "C8", sql=ADMIN_REVIEWS_SQL)
def admin_reviews(t):
    return V.admin_reviews(t)


@register("admin_review_search", "B17 E8", sql=f"""
SELECT * FROM ({ADMIN_REVIEWS_SQL}) x
WHERE contains(lower(concat_ws(' ', coalesce(product_name, ''), coalesce(comment, ''))), 'ring')
  AND rating = 4
""")
def admin_review_search(t):
    return V.sort_reviews(V.search_reviews(V.admin_reviews(t), "Ring", 4), "high")


@register("review_eligibility", "C12 C13", sql="""
WITH req AS (SELECT DISTINCT user_id, product_id FROM wishlist),
bought AS (SELECT DISTINCT o.user_id, oi.product_id FROM shop_orders o
           JOIN order_items oi ON oi.order_id = o.id WHERE o.payment_status = 'paid')
SELECT req.user_id, req.product_id,
  CASE WHEN b.user_id IS NULL THEN 'purchase'
       WHEN EXISTS (SELECT 1 FROM reviews r WHERE r.user_id = req.user_id AND r.product_id = req.product_id)
       THEN 'already_reviewed' END AS reason,
  b.user_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM reviews r WHERE r.user_id = req.user_id
       AND r.product_id = req.product_id) AS can_review
FROM req LEFT JOIN bought b ON b.user_id = req.user_id AND b.product_id = req.product_id
""")
def review_eligibility(t):
    req = t["wishlist"].select("user_id", "product_id").distinct()
    return V.can_review(t, req)


@register("review_ownership", "C19", sql="""
SELECT q.* FROM review_edit_requests q
WHERE EXISTS (SELECT 1 FROM reviews r WHERE r.id = q.review_id AND r.user_id = q.user_id)
""")
def review_ownership(t):
    return V.owned_reviews(t, t["review_edit_requests"])


@register("review_stats", "D13 H2", sql="""
WITH a AS (SELECT product_id, COUNT(*) AS n, SUM(rating) AS s FROM reviews GROUP BY product_id)
SELECT p.id AS product_id, coalesce(a.n, 0) AS total,
  CASE WHEN a.n > 0 THEN CAST(floor((a.s * 20 + a.n) / (2 * a.n)) / 10 AS DECIMAL(4,1)) END AS average,
  CASE WHEN a.n > 0 THEN CAST(floor((a.s * 2 + a.n) / (2 * a.n)) AS INTEGER) END AS rounded_stars,
  CASE WHEN a.n > 0 THEN repeat('★', CAST(floor((a.s * 2 + a.n) / (2 * a.n)) AS INTEGER)) ||
       repeat('☆', 5 - CAST(floor((a.s * 2 + a.n) / (2 * a.n)) AS INTEGER)) ELSE '★★★★★' END AS stars,
  CASE WHEN a.n > 0 THEN CAST(CAST(floor((a.s * 20 + a.n) / (2 * a.n)) / 10 AS DECIMAL(4,1)) AS VARCHAR)
       || ' / 5 · ' || CAST(a.n AS VARCHAR) || ' review' || CASE WHEN a.n > 1 THEN 's' ELSE '' END
       ELSE 'No reviews yet' END AS summary
FROM products p LEFT JOIN a ON a.product_id = p.id
""", money=("average",))
def review_stats(t):
    return V.review_stats(t)


@register("review_pages", "E7 E9", sql="""
SELECT *, CAST((position - 1) // 5 + 1 AS BIGINT) AS page FROM (
  SELECT id, product_id, rating, created_at,
         row_number() OVER (PARTITION BY product_id ORDER BY rating DESC, id DESC) AS position
  FROM reviews) x
""")
def review_pages(t):
    r = t["reviews"].select("id", "product_id", "rating", "created_at")
    return G.number_rows(r, [F.col("rating").desc(), F.col("id").desc()], ["product_id"], page_size=5)


@register("order_list_pages", "E9", sql="""
SELECT id, status, CAST(row_number() OVER (ORDER BY id DESC) AS BIGINT) AS position,
       CAST((row_number() OVER (ORDER BY id DESC) - 1) // 10 + 1 AS BIGINT) AS page
FROM shop_orders
""")
def order_list_pages(t):
    o = t["orders"].select("id", "status")
    return G.number_rows(o, [F.col("id").desc()], page_size=10)


@register("subscriber_page_count", "E9", sql="""
SELECT CAST(ceil(COUNT(*) / 10) AS INTEGER) AS pages FROM newsletter_subscribers
""")
def subscriber_page_count(t):
    return G.page_count(t["newsletter_subscribers"], 10)


@register("subscriber_page_3", "E9", sql="""
SELECT id, email, subscribed_at FROM newsletter_subscribers ORDER BY id DESC LIMIT 10 OFFSET 20
""")
def subscriber_page_3(t):
    return G.page(t["newsletter_subscribers"].select("id", "email", "subscribed_at"),
                  [F.col("id").desc()], 3, 10)


# ---------------------------------------------------------- display rules ---

def _indian_sql(n: str) -> str:
    """DuckDB twin of the Indian digit grouping of a non-negative integer
    text (no look-ahead in DuckDB's regex): last three digits, then pairs."""
    head = f"substr({n}, 1, length({n}) - 3)"
    tail = f"right({n}, 3)"
    pairs = (f"regexp_replace(CASE WHEN length({head}) % 2 = 1 THEN '0' || {head} ELSE {head} END, "
             "'(\\d\\d)', '\\1,', 'g')")
    grouped = f"ltrim({pairs}, '0') || {tail}"
    return f"CASE WHEN length({n}) <= 3 THEN {n} ELSE {grouped} END"


FMT_SQL = """
CASE WHEN {v} IS NULL THEN '0' ELSE
  {int_grouped} ||
  CASE WHEN rtrim(lpad(CAST(CAST((round({v}, 3) - floor(round({v}, 3))) * 1000 AS BIGINT) AS VARCHAR),
                       3, '0'), '0') = '' THEN ''
       ELSE '.' || rtrim(lpad(CAST(CAST((round({v}, 3) - floor(round({v}, 3))) * 1000 AS BIGINT)
                                   AS VARCHAR), 3, '0'), '0') END
END"""


@register("price_labels", "H1", sql="""
SELECT id, price, {fmt} AS price_text FROM product_variants
""".format(fmt=FMT_SQL.format(
    v="price", int_grouped=_indian_sql("CAST(CAST(floor(round(price, 3)) AS BIGINT) AS VARCHAR)"))),
    money=("price",))
def price_labels(t):
    v = t["product_variants"]
    return v.select("id", "price", T.format_price("price").alias("price_text"))


@register("variant_text", "H7 H8 H9 H10 B26", sql="""
SELECT v.id,
  concat_ws(' / ', CASE WHEN v.finish <> '' THEN v.finish END,
            CASE WHEN v.length_size <> '' THEN v.length_size END) AS label,
  concat_ws(' | ', CASE WHEN v.finish <> '' THEN 'Finish: ' || v.finish END,
            CASE WHEN v.gemstones_colour <> '' THEN 'Stone: ' || v.gemstones_colour END,
            CASE WHEN v.length_size <> '' THEN 'L: ' || v.length_size END,
            CASE WHEN v.width <> '' THEN 'W: ' || v.width END,
            CASE WHEN v.thickness <> '' THEN 'T: ' || v.thickness END) AS description,
  concat_ws(' | ',
    CASE WHEN NOT coalesce(contains(lower(p.sub_category), 'ring'), false) AND v.length_size IS NOT NULL
         THEN 'Length: ' || v.length_size || ' cm' END,
    CASE WHEN v.width IS NOT NULL THEN 'Width: ' || v.width || ' cm' END,
    CASE WHEN v.thickness IS NOT NULL THEN 'Thickness: ' || v.thickness || ' cm' END) AS dimensions,
  CASE WHEN v.stock > 0 THEN 'IN STOCK' ELSE 'OUT OF STOCK' END AS stock_label
FROM product_variants v JOIN products p ON p.id = v.product_id
""")
def variant_text(t):
    v = t["product_variants"]
    p = t["products"].select(F.col("id").alias("pid"), P.is_ring().alias("is_ring"))
    j = v.join(p, v["product_id"] == p["pid"])
    return j.select("id", T.variant_label().alias("label"), T.variant_description().alias("description"),
                    T.dimension_line("is_ring").alias("dimensions"), T.stock_label().alias("stock_label"))


@register("page_titles", "H14 H18 B20", sql="""
SELECT id,
  array_to_string(list_transform(string_split(replace(lower(replace(collection_name, ' ', '-')), '-', ' '), ' '),
                  lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' ') AS collection_title,
  CASE gifting_category WHEN 'for-him' THEN 'Gifts for Him' WHEN 'for-her' THEN 'Gifts for Her' END
    AS gift_title,
  regexp_replace(lower(replace(collection_name, ' ', '-')) || ',' || category, '[^A-Za-z0-9,+\\-]', '', 'g')
    AS filter_value
FROM products
""")
def page_titles(t):
    p = t["products"]
    slug = P.collection_slug()
    return p.select("id", T.slug_title(slug).alias("collection_title"),
                    C.gift_title("gifting_category").alias("gift_title"),
                    P.sanitize_filter_col(F.concat(slug, F.lit(","), F.col("category")))
                    .alias("filter_value"))


@register("reviewer_labels", "H6 H16", sql="""
SELECT id,
  coalesce(CASE WHEN trim(concat_ws(' ', first_name, last_name)) <> ''
                THEN trim(concat_ws(' ', first_name, last_name)) END,
           CASE WHEN split_part(email, '@', 1) <> '' THEN split_part(email, '@', 1) END,
           'Anonymous') AS display_name,
  CASE WHEN coalesce(is_admin, 0) <> 0 THEN 'Admin' ELSE 'User' END AS role,
  coalesce(CASE WHEN provider <> '' THEN provider END, 'email') AS login_type
FROM users
""")
def reviewer_labels(t):
    u = t["users"]
    return u.select("id", T.reviewer_name().alias("display_name"), T.role_label().alias("role"),
                    T.login_label().alias("login_type"))


@register("address_lines", "H13", sql="""
SELECT order_id, type,
  concat_ws(', ', CASE WHEN city <> '' THEN city END, CASE WHEN state <> '' THEN state END,
            CASE WHEN pincode <> '' THEN pincode END) AS place,
  coalesce(country, 'India') AS country_label
FROM order_addresses
""")
def address_lines(t):
    a = t["order_addresses"]
    return a.select("order_id", "type", T.place_line().alias("place"),
                    F.coalesce("country", F.lit("India")).alias("country_label"))

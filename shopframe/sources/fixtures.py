"""Storefront tables derived from the driver's TPC-H-style test tables.

The original shop keeps its tables in MySQL; the tests have only the driver's
parquet tables (part, customer, orders, lineitem, events, conversations, ...).
This module gives each storefront table in its Spark schema by pure projection
of those tables (FIXTURES.md). It does none of an operator's work: operators
never rely on how these rows were made.

Each derivation is a list of ``(column, expression)`` pairs whose expression
text is valid in both Spark SQL and DuckDB, so the DuckDB oracle
(``shopframe.plans.registry.with_fixtures``) builds byte-identical inputs
from the same strings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values of the fixture (not derived from the test tables).
# Five coupons and three coupon usages; the NULL coupon_id in the usages is the
# row that tells NOT IN apart from NOT EXISTS.
COUPON_ROWS_SQL = """
    (1, 'SAVE10',  'percent', CAST(10 AS DECIMAL(10,2)),  CAST(100000 AS DECIMAL(10,2)), CAST(20000 AS DECIMAL(10,2)), 1,
        CAST('1995-01-01 00:00:00' AS TIMESTAMP), CAST('2002-12-31 23:59:59' AS TIMESTAMP), CAST(NULL AS INT), 0),
    (2, 'FLAT500', 'flat',    CAST(500 AS DECIMAL(10,2)), CAST(NULL AS DECIMAL(10,2)), CAST(NULL AS DECIMAL(10,2)), 1,
        CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), 100, 3),
    (3, 'OLD20',   'percent', CAST(20 AS DECIMAL(10,2)),  CAST(0 AS DECIMAL(10,2)),    CAST(0 AS DECIMAL(10,2)), 1,
        CAST('1995-01-01 00:00:00' AS TIMESTAMP), CAST('1997-12-31 23:59:59' AS TIMESTAMP), CAST(NULL AS INT), 0),
    (4, 'OFF',     'percent', CAST(5 AS DECIMAL(10,2)),   CAST(0 AS DECIMAL(10,2)),    CAST(NULL AS DECIMAL(10,2)), 0,
        CAST(NULL AS TIMESTAMP), CAST(NULL AS TIMESTAMP), CAST(NULL AS INT), 0),
    (5, 'FULL',    'flat',    CAST(100 AS DECIMAL(10,2)), CAST(200000 AS DECIMAL(10,2)),  CAST(50 AS DECIMAL(10,2)), 1,
        CAST('1995-01-01 00:00:00' AS TIMESTAMP), CAST(NULL AS TIMESTAMP), 10, 10)
"""
COUPON_COLUMNS = ["id", "code", "type", "value", "min_order", "max_discount", "active",
                  "start_date", "end_date", "usage_limit", "used_count"]
COUPON_USAGE_ROWS_SQL = "(1, CAST(7 AS BIGINT)), (2, CAST(8 AS BIGINT)), (CAST(NULL AS INT), CAST(9 AS BIGINT))"
COUPON_USAGE_COLUMNS = ["coupon_id", "user_id"]
# ---------------------------------------------------------------------------

# The product an event is about: one event in three runs over the whole
# catalog, the others meet on its first part, so that keys also repeat.
EVENT_PRODUCT = ("CASE WHEN event_id % 3 = 0 THEN CAST(floor(event_id / 5) AS BIGINT) + 1 "
                 "ELSE event_id % 200 END")
# The document whose text a review takes: over all documents.
EVENT_DOCUMENT = "CAST(floor(event_id / 10) AS BIGINT)"

USERS = ("customer", [
    ("id", "c_custkey"),
    ("first_name", "CASE WHEN c_custkey % 40 = 0 THEN NULL ELSE split_part(c_name, '#', 1) END"),
    ("last_name", "split_part(c_name, '#', 2)"),
    ("email", "lower(replace(c_name, '#', '.')) || '@example.com'"),
    ("provider", "CASE WHEN c_custkey % 4 = 0 THEN 'google' END"),
    ("is_admin", "CASE WHEN c_custkey % 97 = 0 THEN 1 ELSE 0 END"),
])

PRODUCTS = ("part", [
    ("id", "p_partkey"),
    ("name", "p_name"),
    ("description", "CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE 'About ' || p_name END"),
    ("category", "CASE p_partkey % 4 WHEN 0 THEN 'Men' WHEN 1 THEN 'women' WHEN 2 THEN 'Unisex' ELSE 'Kids' END"),
    ("sub_category", "lower(p_type)"),
    ("collection_name", "CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE replace(p_brand, '#', ' ') END"),
    ("metal", "CASE p_size % 3 WHEN 0 THEN 'gold' WHEN 1 THEN 'silver' ELSE 'platinum' END"),
    ("is_gifting", "CASE WHEN p_size % 2 = 0 THEN 1 ELSE 0 END"),
    ("gifting_category", "CASE p_size % 3 WHEN 0 THEN 'for-him' WHEN 1 THEN 'for-her' END"),
    ("image1", "'p' || CAST(p_partkey AS STRING) || '.jpg'"),
    ("image2", "CASE p_partkey % 3 WHEN 0 THEN 'p' || CAST(p_partkey AS STRING) || 'b.jpg' WHEN 1 THEN '' END"),
    ("image3", "CASE WHEN p_partkey % 5 = 0 THEN 'p' || CAST(p_partkey AS STRING) || 'c.jpg' END"),
    ("image4", "CASE WHEN p_partkey % 2 = 0 THEN 'p' || CAST(p_partkey AS STRING) || 'd.jpg' END"),
])

# ``k`` is the variant ordinal 0..3; a product has ``p_partkey % 5`` variants.
PRODUCT_VARIANTS = ("part", [
    ("id", "p_partkey * 10 + k"),
    ("product_id", "p_partkey"),
    ("sku", "'SKU-' || CAST(p_partkey * 10 + k AS STRING)"),
    ("price", "CAST(p_retailprice * (k + 1) * (p_partkey % 7 + 1) * 0.5 AS DECIMAL(10,2))"),
    ("stock", "(p_size * 7 + k * 13) % 20"),
    ("finish", "CASE (p_partkey + k) % 5 WHEN 0 THEN 'Silver' WHEN 1 THEN 'gold' WHEN 2 THEN 'Rose Gold' WHEN 3 THEN 'rose' END"),
    ("gemstones_colour", "CASE (p_partkey + k) % 4 WHEN 0 THEN 'Red' WHEN 1 THEN '' WHEN 2 THEN 'blue' END"),
    ("length_size", "CAST(p_size AS STRING)"),
    ("width", "CASE WHEN k % 2 = 0 THEN CAST(p_size % 5 + 1 AS STRING) || 'mm' ELSE '' END"),
    ("thickness", "CASE WHEN (p_partkey + k) % 3 = 0 THEN NULL ELSE CAST((p_partkey + k) % 3 AS STRING) || 'mm' END"),
])

CART_ITEMS = ("events", "event_type = 'click'", [
    ("id", "event_id"),
    ("user_id", "user_id"),
    ("variant_id", f"({EVENT_PRODUCT}) * 10 + event_id % 4"),
    ("quantity", "1 + event_id % 3"),
    ("is_gift", "CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END"),
])

CART_COMMANDS = ("events", "event_type = 'click'", [
    ("seq", "event_id"),
    ("ts", "ts"),
    ("user_id", "user_id"),
    ("variant_id", f"({EVENT_PRODUCT}) * 10 + event_id % 4"),
    ("op", "CASE event_id % 8 WHEN 6 THEN 'remove' WHEN 5 THEN 'update' ELSE 'add' END"),
    ("qty", "CAST(CASE WHEN event_id % 8 = 5 THEN (CASE WHEN event_id % 16 = 5 THEN -1 ELSE 2 END) ELSE event_id % 3 END AS INT)"),
    ("is_gift", "CASE WHEN event_id % 9 = 0 THEN 1 ELSE 0 END"),
])

WISHLIST_EVENTS = ("events", "event_type = 'view'", [
    ("event_id", "event_id"),
    ("ts", "ts"),
    ("user_id", "user_id"),
    ("product_id", EVENT_PRODUCT),
])

SHOP_ORDERS = ("orders", [
    ("id", "o_orderkey"),
    ("order_number", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'ORD-' || CAST(1700000000000 + o_orderkey AS STRING) END"),
    ("user_id", "CASE WHEN o_orderkey % 25 = 0 THEN NULL ELSE o_custkey END"),
    ("status", "CASE WHEN o_orderkey % 10 = 0 THEN 'cancelled' WHEN o_orderstatus = 'F' THEN 'delivered' "
               "WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'P' THEN 'confirmed' END"),
    ("payment_status", "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'paid' WHEN '2' THEN 'paid' "
                       "WHEN '3' THEN 'unpaid' WHEN '4' THEN 'failed' WHEN '5' THEN 'refunded' END"),
    ("payment_method", "CASE WHEN o_orderkey % 2 = 0 THEN 'cod' ELSE 'razorpay' END"),
    ("coupon_id", "CASE o_orderkey % 7 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 9 END"),
    ("coupon_code", "CASE o_orderkey % 7 WHEN 0 THEN 'SAVE10' WHEN 1 THEN 'FLAT500' WHEN 2 THEN 'GONE' END"),
    ("subtotal", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(12,2)) END"),
    ("discount", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(0 AS DECIMAL(12,2)) END"),
    ("grand_total", "CAST(o_totalprice AS DECIMAL(12,2))"),
    ("created_at", "o_orderdate"),
])

ORDER_ITEMS = ("lineitem", [
    ("order_id", "l_orderkey"),
    ("product_id", "l_partkey"),
    ("variant_id", "l_partkey * 10 + l_linenumber % 4"),
    ("product_name", "'item ' || CAST(l_partkey AS STRING)"),
    ("sku", "'SKU-' || CAST(l_partkey * 10 + l_linenumber % 4 AS STRING)"),
    ("quantity", "CAST(l_quantity AS INT)"),
    ("price", "CAST(l_extendedprice AS DECIMAL(12,2))"),
    ("is_gift", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END"),
])

# order_addresses: orders JOIN customer JOIN nation; billing for every order,
# shipping for even order keys.
ADDRESS_BILLING = [
    ("order_id", "o_orderkey"),
    ("type", "'billing'"),
    ("name", "c_name"),
    ("phone", "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE '98' || lpad(CAST(c_custkey AS STRING), 8, '0') END"),
    ("city", "'City ' || CAST(c_nationkey AS STRING)"),
    ("state", "n_name"),
    ("pincode", "lpad(CAST(c_custkey % 1000000 AS STRING), 6, '0')"),
    ("country", "CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'India' END"),
]
ADDRESS_SHIPPING = [
    ("order_id", "o_orderkey"),
    ("type", "'shipping'"),
    ("name", "c_name"),
    ("phone", "'97' || lpad(CAST(c_custkey AS STRING), 8, '0')"),
    ("city", "'Town ' || CAST(c_nationkey AS STRING)"),
    ("state", "n_name"),
    ("pincode", "lpad(CAST((c_custkey * 7) % 1000000 AS STRING), 6, '0')"),
    ("country", "'India'"),
]

STATUS_HISTORY_FIRST = [
    ("id", "2 * o_orderkey"),
    ("order_id", "o_orderkey"),
    ("status", "'pending'"),
    ("changed_by", "'system'"),
    ("comment", "'Order placed'"),
    ("created_at", "o_orderdate"),
]
STATUS_HISTORY_SECOND = [
    ("id", "2 * o_orderkey + 1"),
    ("order_id", "o_orderkey"),
    ("status", "CASE WHEN o_orderkey % 10 = 0 THEN 'cancelled' ELSE 'confirmed' END"),
    ("changed_by", "'admin'"),
    ("comment", "CASE WHEN o_orderkey % 8 = 1 THEN NULL ELSE 'Updated by admin' END"),
    ("created_at", "o_orderdate + INTERVAL '2' DAY"),
]

REVIEWS = [
    ("id", "event_id"),
    ("user_id", "user_id"),
    ("product_id", EVENT_PRODUCT),
    ("rating", "CAST(1 + (event_id * 7) % 5 AS INT)"),
    ("title", "split_part(text, chr(10), 1)"),
    ("comment", "text"),
    ("created_at", "ts"),
]

# Coupon quote requests: one per order, the typed code and the cart subtotal.
COUPON_REQUESTS = ("orders", [
    ("request_id", "o_orderkey"),
    ("user_id", "o_custkey"),
    ("code", "CASE o_orderkey % 6 WHEN 0 THEN 'save10' WHEN 1 THEN ' FLAT500' WHEN 2 THEN 'OLD20' "
             "WHEN 3 THEN 'off' WHEN 4 THEN 'FULL' END"),
    ("subtotal", "CAST(o_totalprice AS DECIMAL(12,2))"),
    ("ts", "o_orderdate"),
])

# Profile edits in two rounds. Odd users' turns come after all even ones'. In
# the first round every fifth user asks for the next user's e-mail, which some
# have given up by then; in the second some users ask for their own first one
# again, some for one that was free before.
PROFILE_UPDATES = ("customer", [
    ("seq", "CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 1000000000 END"),
    ("user_id", "c_custkey"),
    ("first_name", "CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE split_part(c_name, '#', 1) END"),
    ("last_name", "'L' || CAST(c_custkey AS STRING)"),
    ("email", "CASE WHEN c_custkey % 5 = 0 THEN 'CUSTOMER.' || lpad(CAST(c_custkey + 1 AS STRING), 9, '0') "
              "|| '@example.com' ELSE 'new' || CAST(c_custkey AS STRING) || '@example.com' END"),
])
PROFILE_UPDATES_AGAIN = ("c_custkey % 3 = 0", [
    ("seq", "2000000000 + c_custkey"), ("user_id", "c_custkey"),
    ("first_name", "CASE WHEN c_custkey % 11 = 0 THEN '' ELSE 'Again' END"),
    ("last_name", "'M' || CAST(c_custkey AS STRING)"),
    ("email", "CASE WHEN c_custkey % 6 = 0 THEN 'Customer.' || lpad(CAST(c_custkey AS STRING), 9, '0') || '@example.com' "
              "ELSE 'new' || CAST(c_custkey + 1 AS STRING) || '@example.com' END"),
])

# Review edit/delete requests: every fourth names another user's review.
REVIEW_EDIT_REQUESTS = ("events", "event_type = 'purchase'", [
    ("review_id", "event_id"),
    ("user_id", "CASE WHEN event_id % 4 = 0 THEN user_id + 1 ELSE user_id END"),
    ("op", "CASE WHEN event_id % 3 = 0 THEN 'delete' ELSE 'update' END"),
    ("rating", "CAST(1 + event_id % 5 AS INT)"),
    ("title", "'Edited ' || CAST(event_id AS STRING)"),
    ("comment", "CASE WHEN event_id % 2 = 0 THEN 'Edited comment' END"),
])

# Option choices on product pages (NULL = option not chosen).
VARIANT_CHOICES = ("events", "event_type = 'view'", [
    ("choice_id", "event_id"),
    ("product_id", EVENT_PRODUCT),
    ("finish", "CASE event_id % 3 WHEN 0 THEN 'gold' WHEN 1 THEN 'Rose Gold' END"),
    ("gemstone", "CASE WHEN event_id % 5 = 0 THEN 'Red' END"),
    ("size", "CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 50 AS STRING) END"),
])

# ---- request batches for the change operators (one row per request) ----
CHECKOUT_REQUESTS = [
    ("seq", "c_custkey"),
    ("user_id", "c_custkey"),
    ("billing_name", "CASE WHEN c_custkey % 9 = 0 THEN '' ELSE c_name END"),
    ("billing_phone", "CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE '98' || lpad(CAST(c_custkey AS STRING), 8, '0') END"),
    ("billing_email", "CASE WHEN c_custkey % 8 <> 0 THEN lower(split_part(c_name, '#', 1)) || CAST(c_custkey AS STRING) "
                      "|| '@example.com' END"),
    ("billing_address", "CAST(c_custkey % 90 + 1 AS STRING) || ' High Street'"),
    ("billing_city", "'City ' || CAST(c_nationkey AS STRING)"),
    ("billing_state", "'State'"),
    ("billing_pincode", "lpad(CAST(c_custkey % 1000000 AS STRING), 6, '0')"),
    ("coupon_code", "CASE c_custkey % 4 WHEN 0 THEN 'SAVE10' WHEN 1 THEN 'full' WHEN 2 THEN '' END"),
]
PAYMENT_CONFIRMATIONS = [
    ("order_id", "o_orderkey"),
    ("user_id", "o_custkey"),
    ("payment_id", "'pay_' || CAST(o_orderkey AS STRING)"),
]
CANCEL_REQUESTS = [
    ("seq", "o_orderkey"),
    ("order_id", "o_orderkey"),
    ("user_id", "CASE WHEN o_orderkey % 13 = 0 THEN o_custkey + 1 ELSE o_custkey END"),
    ("ts", "o_orderdate + INTERVAL '1' DAY * (o_orderkey % 5)"),
]
# A second request for some of the orders, a day before or after the first.
CANCEL_REPEATS = [
    ("seq", "o_orderkey + 2000000000"),
    ("order_id", "o_orderkey"),
    ("user_id", "o_custkey"),
    ("ts", "o_orderdate + INTERVAL '1' DAY * (o_orderkey % 5 + CASE WHEN o_orderkey % 12 = 1 THEN 1 ELSE -1 END)"),
]
STATUS_REQUESTS = [
    ("seq", "o_orderkey"),
    ("order_id", "o_orderkey"),
    ("status", "CASE WHEN o_orderkey % 8 = 0 THEN 'cancelled' ELSE 'shipped' END"),
    ("comment", "CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'note ' || CAST(o_orderkey AS STRING) END"),
]
PAYMENT_REQUESTS = [
    ("seq", "o_orderkey"),
    ("order_id", "o_orderkey"),
    ("payment_status", "CASE WHEN o_orderkey % 12 = 1 THEN 'paid' ELSE 'refunded' END"),
    ("comment", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'checked' END"),
]
ORDER_REQUESTS = [
    ("seq", "o_orderkey"),
    ("user_id", "o_custkey"),
    ("coupon_code", "CASE o_orderkey % 4 WHEN 0 THEN 'SAVE10' WHEN 1 THEN 'flat500' WHEN 2 THEN 'OLD20' END"),
    ("ship_name", "'Ship ' || CAST(o_custkey AS STRING)"),
    ("ship_phone", "CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '97' || lpad(CAST(o_custkey AS STRING), 8, '0') END"),
    ("ship_pincode", "'560001'"),
    ("bill_name", "'Bill ' || CAST(o_custkey AS STRING)"),
    ("bill_phone", "'96' || lpad(CAST(o_custkey AS STRING), 8, '0')"),
    ("bill_pincode", "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE '400001' END"),
    ("payment_method", "CASE WHEN o_orderkey % 20 = 3 THEN 'cod' END"),
    ("ship_email", "CASE WHEN o_orderkey % 30 = 3 THEN '' ELSE 'u' || CAST(o_custkey AS STRING) || '@example.com' END"),
    ("ship_address_line1", "CAST(o_custkey % 70 + 1 AS STRING) || ' Lake Road'"),
    ("ship_city", "'City ' || CAST(o_custkey % 25 AS STRING)"),
    ("ship_state", "CASE WHEN o_orderkey % 40 <> 13 THEN 'State ' || CAST(o_custkey % 9 AS STRING) END"),
    ("ship_country", "CASE o_orderkey % 3 WHEN 0 THEN 'Nepal' WHEN 1 THEN '' END"),
    ("bill_email", "CASE WHEN o_orderkey % 50 <> 3 THEN 'b' || CAST(o_custkey AS STRING) || '@example.com' END"),
    ("bill_address_line1", "CAST(o_custkey % 50 + 1 AS STRING) || ' Hill Road'"),
    ("bill_city", "'Town ' || CAST(o_custkey % 25 AS STRING)"),
    ("bill_state", "'State ' || CAST(o_custkey % 7 AS STRING)"),
    ("bill_country", "CASE WHEN o_orderkey % 60 = 3 THEN 'Bhutan' END"),
]
ORDER_REQUEST_ITEMS = [
    ("seq", "l_orderkey"),
    ("product_id", "l_partkey"),
    ("variant_id", "l_partkey * 10 + l_linenumber % 4"),
    ("price", "CAST(l_extendedprice AS DECIMAL(12,2))"),
    ("quantity", "CASE WHEN l_linenumber = 7 THEN 0 ELSE CAST(l_quantity AS INT) END"),
    ("product_name", "'piece ' || CAST(l_partkey AS STRING)"),
    ("sku", "CASE l_partkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'SKU-' || CAST(l_partkey * 10 + l_linenumber % 4 "
            "AS STRING) END"),
]
# What visitors typed: a part of the product's name, whole or cut short, its
# category, two letters, or a text with a wildcard.
SEARCH_REQUESTS = [
    ("query_id", "p_partkey"),
    ("q", "CASE p_partkey % 6 WHEN 0 THEN ' ' || upper(split_part(p_name, ' ', 1)) WHEN 1 THEN substr(p_name, 3, 6) "
          "WHEN 2 THEN substr(p_name, 1, 2) WHEN 3 THEN substr(p_name, 2, 3) || '%' || substr(p_name, 9, 2) "
          "WHEN 4 THEN p_name ELSE substr(p_name, 1, 1) END"),
]
NEWSLETTER_REQUESTS = [
    ("seq", "c_custkey"),
    ("email", "CASE c_custkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'user' || CAST(c_custkey % 150 AS STRING) || "
              "'@example.com' ELSE 'fan' || CAST(c_custkey % 700 AS STRING) || '@Example.com' END"),
]
REGISTRATIONS = [
    ("seq", "c_custkey"),
    ("first_name", "CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE 'F' || CAST(c_custkey AS STRING) END"),
    ("last_name", "'L' || CAST(c_custkey AS STRING)"),
    ("email", "CASE WHEN c_custkey % 3 = 0 THEN upper(lower(replace(c_name, '#', '.')) || '@example.com') "
              "ELSE 'member' || CAST(c_custkey % 400 AS STRING) || '@example.com' END"),
]
REVIEW_SUBMISSIONS = [
    ("seq", "event_id"),
    ("user_id", "user_id"),
    ("product_id", EVENT_PRODUCT),
    ("title", "'T' || CAST(event_id AS STRING)"),
    ("rating", "CAST(1 + event_id % 5 AS INT)"),
    ("comment", "'C' || CAST(event_id AS STRING)"),
]
PRODUCT_REQUESTS = [
    ("seq", "p_partkey"),
    ("id", "CASE WHEN p_partkey % 18 = 0 THEN NULL ELSE p_partkey END"),
    ("name", "'New ' || p_name"),
    ("description", "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'Edited' END"),
    ("category", "'Women'"),
    ("sub_category", "lower(p_type)"),
    ("collection_name", "NULL"),
    ("metal", "'gold'"),
    ("is_gifting", "1"),
    ("gifting_category", "'for-her'"),
    ("image1", "CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'n' || CAST(p_partkey AS STRING) || '.jpg' END"),
    ("image2", "NULL"),
    ("image3", "CASE WHEN p_partkey % 5 = 0 THEN 'x.jpg' END"),
    ("image4", "NULL"),
]
VARIANT_REQUESTS = [
    ("seq", "p_partkey"),
    ("id", "CASE WHEN p_partkey % 12 = 0 THEN NULL ELSE p_partkey * 10 END"),
    ("product_id", "CASE WHEN p_partkey % 30 = 6 THEN NULL ELSE p_partkey END"),
    ("sku", "CASE WHEN p_partkey % 24 = 0 THEN 'SKU-' || CAST(p_partkey * 10 + 1 AS STRING) "
            "ELSE 'NEW-' || CAST(p_partkey % 500 AS STRING) END"),
    ("price", "CAST(p_retailprice AS DECIMAL(10,2))"),
    ("stock", "CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END"),
    ("finish", "CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE 'gold' END"),
    ("gemstones_colour", "''"),
    ("length_size", "CAST(p_size AS STRING)"),
    ("width", "NULL"),
    ("thickness", "'2mm'"),
]
MESSAGE_EDITS = [
    ("seq", "conv_id * 100 + turn"),
    ("id", "conv_id * 100 + turn"),
    ("name", "CASE WHEN conv_id % 2 = 0 THEN NULL ELSE 'Edited ' || CAST(conv_id AS STRING) END"),
    ("email", "CASE WHEN conv_id % 2 = 0 THEN NULL ELSE 'e@example.com' END"),
    ("phone", "NULL"),
    ("message", "CASE WHEN conv_id % 2 = 0 THEN NULL ELSE 'edited text' END"),
    ("status", "CAST(0 AS INT)"),
]

# Delete requests (ids to delete) for subscribers, users, messages, products.
DELETE_REQUESTS = {
    "unsubscribe_requests": ("events", "event_type = 'signup' AND event_id % 4 = 0", "event_id"),
    "user_delete_requests": ("customer", "c_custkey % 50 = 7", "c_custkey"),
    "message_delete_requests": ("conversations", "role = 'user' AND (conv_id * 100 + turn) % 10 = 5",
                                "conv_id * 100 + turn"),
    "product_delete_requests": ("part", "p_partkey % 17 = 0", "p_partkey"),
}

NEWSLETTER = ("events", "event_type = 'signup'", [
    ("id", "event_id"),
    ("email", "'user' || CAST(user_id AS STRING) || '@example.com'"),
    ("subscribed_at", "ts"),
])

CONTACT_MESSAGES = ("conversations", "role = 'user'", [
    ("id", "conv_id * 100 + turn"),
    ("name", "'conv' || CAST(conv_id AS STRING)"),
    ("email", "'c' || CAST(conv_id AS STRING) || '@example.com'"),
    ("phone", "CASE conv_id % 3 WHEN 0 THEN CAST(9000000000 + conv_id AS STRING) WHEN 1 THEN '12-34' END"),
    ("message", "text"),
    ("status", "CAST(turn % 2 AS INT)"),
])


def _sel(pairs):
    return [f"{expr} AS {name}" for name, expr in pairs]


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_stream(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The same table as a file stream: files named ``<name>.parquet`` or
    ``<name>_<part>.parquet`` in the folder arrive as micro-batches."""
    schema = raw(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{{{name}.parquet,{name}_*.parquet}}")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(sf_dir.rstrip("/"))


def project(df: DataFrame, pairs, where: str | None = None) -> DataFrame:
    """Apply one of the derivations above to a (batch or streaming) frame."""
    if where:
        df = df.where(where)
    return df.selectExpr(*_sel(pairs))


def derive_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All storefront tables for one scale-factor folder (lazy DataFrames)."""
    r = lambda n: raw(spark, sf_dir, n)
    t: dict[str, DataFrame] = {}

    t["users"] = r("customer").selectExpr(*_sel(USERS[1]))
    t["products"] = r("part").selectExpr(*_sel(PRODUCTS[1]))
    # k < p_partkey % 5 variant ordinals, produced row-locally by a generator
    # (no join with a VALUES list needed).
    t["product_variants"] = (
        r("part")
        .withColumn("k", F.explode(F.filter(F.array(*[F.lit(i) for i in range(4)]),
                                            lambda k: k < F.col("p_partkey") % 5)))
        .selectExpr(*_sel(PRODUCT_VARIANTS[1]))
    )
    ev = r("events")
    t["cart_items"] = ev.where(CART_ITEMS[1]).selectExpr(*_sel(CART_ITEMS[2]))
    t["cart_commands"] = ev.where(CART_COMMANDS[1]).selectExpr(*_sel(CART_COMMANDS[2]))
    wl = ev.where(WISHLIST_EVENTS[1]).selectExpr(*_sel(WISHLIST_EVENTS[2]))
    t["wishlist_events"] = wl
    t["wishlist"] = (wl.groupBy("user_id", "product_id")
                     .agg(F.min("event_id").alias("id"))
                     .select("id", "user_id", "product_id"))
    t["orders"] = r("orders").selectExpr(*_sel(SHOP_ORDERS[1]))
    t["order_items"] = r("lineitem").selectExpr(*_sel(ORDER_ITEMS[1]))

    oc = (r("orders").select("o_orderkey", "o_custkey")
          .join(r("customer").select("c_custkey", "c_name", "c_nationkey"),
                F.col("o_custkey") == F.col("c_custkey"))
          .join(r("nation").select("n_nationkey", "n_name"),
                F.col("c_nationkey") == F.col("n_nationkey")))
    t["order_addresses"] = oc.selectExpr(*_sel(ADDRESS_BILLING)).unionByName(
        oc.where("o_orderkey % 2 = 0").selectExpr(*_sel(ADDRESS_SHIPPING)))

    o = r("orders").select("o_orderkey", "o_orderdate")
    t["order_status_history"] = o.selectExpr(*_sel(STATUS_HISTORY_FIRST)).unionByName(
        o.where("o_orderkey % 4 <> 0").selectExpr(*_sel(STATUS_HISTORY_SECOND)))

    # Wall-clock (NTZ) dates like every other storefront timestamp.
    t["coupons"] = (spark.sql(
        f"SELECT * FROM VALUES {COUPON_ROWS_SQL} AS c({', '.join(COUPON_COLUMNS)})")
        .withColumn("start_date", F.col("start_date").cast("timestamp_ntz"))
        .withColumn("end_date", F.col("end_date").cast("timestamp_ntz")))
    t["coupon_usages"] = spark.sql(
        f"SELECT * FROM VALUES {COUPON_USAGE_ROWS_SQL} AS u({', '.join(COUPON_USAGE_COLUMNS)})")

    purchases = ev.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    docs = r("documents").select("doc_id", "text")
    t["reviews"] = (purchases.join(docs, F.expr(EVENT_DOCUMENT) == F.col("doc_id"), "left")
                    .selectExpr(*_sel(REVIEWS)))
    t["profile_updates"] = r("customer").selectExpr(*_sel(PROFILE_UPDATES[1])).unionByName(
        r("customer").where(PROFILE_UPDATES_AGAIN[0]).selectExpr(*_sel(PROFILE_UPDATES_AGAIN[1])))
    t["review_edit_requests"] = ev.where(REVIEW_EDIT_REQUESTS[1]).selectExpr(*_sel(REVIEW_EDIT_REQUESTS[2]))
    t["variant_choices"] = ev.where(VARIANT_CHOICES[1]).selectExpr(*_sel(VARIANT_CHOICES[2]))
    cu, od, li, pa = r("customer"), r("orders"), r("lineitem"), r("part")
    t["checkout_requests"] = cu.selectExpr(*_sel(CHECKOUT_REQUESTS)).unionByName(
        cu.where("c_custkey % 10 = 0").selectExpr(*_sel(CHECKOUT_REQUESTS))
        .withColumn("seq", F.col("seq") + 1000000000))
    t["payment_confirmations"] = od.where("o_orderkey % 5 = 1").selectExpr(*_sel(PAYMENT_CONFIRMATIONS))
    t["cancel_requests"] = od.where("o_orderkey % 3 = 1").selectExpr(*_sel(CANCEL_REQUESTS))
    t["status_requests"] = od.where("o_orderkey % 4 = 0").selectExpr(*_sel(STATUS_REQUESTS))
    t["admin_cancel_requests"] = od.where("o_orderkey % 5 = 2").selectExpr("o_orderkey AS seq",
                                                                           "o_orderkey AS order_id")
    t["payment_requests"] = od.where("o_orderkey % 6 = 1").selectExpr(*_sel(PAYMENT_REQUESTS))
    t["order_requests"] = od.where("o_orderkey % 10 = 3").selectExpr(*_sel(ORDER_REQUESTS))
    t["order_request_items"] = li.where("l_orderkey % 10 = 3").selectExpr(*_sel(ORDER_REQUEST_ITEMS))
    t["search_requests"] = pa.selectExpr(*_sel(SEARCH_REQUESTS))
    t["newsletter_requests"] = cu.selectExpr(*_sel(NEWSLETTER_REQUESTS))
    t["registrations"] = cu.selectExpr(*_sel(REGISTRATIONS))
    t["review_submissions"] = ev.where("event_type = 'purchase'").selectExpr(*_sel(REVIEW_SUBMISSIONS))
    t["product_requests"] = (pa.where("p_partkey % 9 = 0").selectExpr(*_sel(PRODUCT_REQUESTS))
                             .withColumn("collection_name", F.col("collection_name").cast("string"))
                             .withColumn("image2", F.col("image2").cast("string"))
                             .withColumn("image4", F.col("image4").cast("string")))
    t["variant_requests"] = (pa.where("p_partkey % 6 = 0").selectExpr(*_sel(VARIANT_REQUESTS))
                             .withColumn("width", F.col("width").cast("string")))
    t["message_edits"] = (r("conversations").where("role = 'user' AND conv_id % 3 = 0")
                          .selectExpr(*_sel(MESSAGE_EDITS)).withColumn("phone", F.col("phone").cast("string")))
    t["coupon_requests"] = r("orders").selectExpr(*_sel(COUPON_REQUESTS[1]))
    for name, (src, cond, expr) in DELETE_REQUESTS.items():
        t[name] = r(src).where(cond).selectExpr(f"{expr} AS id")
    t["newsletter_subscribers"] = ev.where(NEWSLETTER[1]).selectExpr(*_sel(NEWSLETTER[2]))
    t["contact_messages"] = (r("conversations").where(CONTACT_MESSAGES[1])
                             .selectExpr(*_sel(CONTACT_MESSAGES[2])))
    return t


def duckdb_ctes() -> dict[str, str]:
    """The same derivations as DuckDB SELECTs over the raw views (oracle side)."""
    def s(pairs):
        return ", ".join(_sel(pairs))

    c = {}
    c["users"] = f"SELECT {s(USERS[1])} FROM customer"
    c["products"] = f"SELECT {s(PRODUCTS[1])} FROM part"
    c["product_variants"] = (f"SELECT {s(PRODUCT_VARIANTS[1])} FROM part "
                             "JOIN (VALUES (0), (1), (2), (3)) AS g(k) ON k < p_partkey % 5")
    c["cart_items"] = f"SELECT {s(CART_ITEMS[2])} FROM events WHERE {CART_ITEMS[1]}"
    c["cart_commands"] = f"SELECT {s(CART_COMMANDS[2])} FROM events WHERE {CART_COMMANDS[1]}"
    c["wishlist_events"] = f"SELECT {s(WISHLIST_EVENTS[2])} FROM events WHERE {WISHLIST_EVENTS[1]}"
    c["wishlist"] = (f"SELECT MIN(event_id) AS id, user_id, {EVENT_PRODUCT} AS product_id FROM events "
                     f"WHERE event_type = 'view' GROUP BY user_id, {EVENT_PRODUCT}")
    c["shop_orders"] = f"SELECT {s(SHOP_ORDERS[1])} FROM orders"
    c["order_items"] = f"SELECT {s(ORDER_ITEMS[1])} FROM lineitem"
    oc = ("FROM orders JOIN customer ON o_custkey = c_custkey "
          "JOIN nation ON c_nationkey = n_nationkey")
    c["order_addresses"] = (f"SELECT {s(ADDRESS_BILLING)} {oc} UNION ALL "
                            f"SELECT {s(ADDRESS_SHIPPING)} {oc} WHERE o_orderkey % 2 = 0")
    c["order_status_history"] = (f"SELECT {s(STATUS_HISTORY_FIRST)} FROM orders UNION ALL "
                                 f"SELECT {s(STATUS_HISTORY_SECOND)} FROM orders WHERE o_orderkey % 4 <> 0")
    c["coupons"] = f"SELECT * FROM (VALUES {COUPON_ROWS_SQL}) AS c({', '.join(COUPON_COLUMNS)})"
    c["coupon_usages"] = (f"SELECT * FROM (VALUES {COUPON_USAGE_ROWS_SQL}) "
                          f"AS u({', '.join(COUPON_USAGE_COLUMNS)})")
    c["reviews"] = (f"SELECT {s(REVIEWS)} FROM (SELECT event_id, user_id, ts FROM events "
                    f"WHERE event_type = 'purchase') e LEFT JOIN documents ON {EVENT_DOCUMENT} = doc_id")
    c["profile_updates"] = (f"SELECT {s(PROFILE_UPDATES[1])} FROM customer UNION ALL "
                            f"SELECT {s(PROFILE_UPDATES_AGAIN[1])} FROM customer WHERE {PROFILE_UPDATES_AGAIN[0]}")
    c["review_edit_requests"] = (f"SELECT {s(REVIEW_EDIT_REQUESTS[2])} FROM events "
                                 f"WHERE {REVIEW_EDIT_REQUESTS[1]}")
    c["variant_choices"] = f"SELECT {s(VARIANT_CHOICES[2])} FROM events WHERE {VARIANT_CHOICES[1]}"
    c["checkout_requests"] = (f"SELECT {s(CHECKOUT_REQUESTS)} FROM customer UNION ALL "
                              f"SELECT * REPLACE (seq + 1000000000 AS seq) FROM (SELECT {s(CHECKOUT_REQUESTS)} "
                              "FROM customer WHERE c_custkey % 10 = 0)")
    c["payment_confirmations"] = f"SELECT {s(PAYMENT_CONFIRMATIONS)} FROM orders WHERE o_orderkey % 5 = 1"
    c["cancel_requests"] = f"SELECT {s(CANCEL_REQUESTS)} FROM orders WHERE o_orderkey % 3 = 1"
    c["cancel_repeats"] = f"SELECT {s(CANCEL_REPEATS)} FROM orders WHERE o_orderkey % 6 = 1"
    c["status_requests"] = f"SELECT {s(STATUS_REQUESTS)} FROM orders WHERE o_orderkey % 4 = 0"
    c["admin_cancel_requests"] = ("SELECT o_orderkey AS seq, o_orderkey AS order_id FROM orders "
                                  "WHERE o_orderkey % 5 = 2")
    c["payment_requests"] = f"SELECT {s(PAYMENT_REQUESTS)} FROM orders WHERE o_orderkey % 6 = 1"
    c["search_requests"] = f"SELECT {s(SEARCH_REQUESTS)} FROM part"
    c["order_requests"] = f"SELECT {s(ORDER_REQUESTS)} FROM orders WHERE o_orderkey % 10 = 3"
    c["order_request_items"] = f"SELECT {s(ORDER_REQUEST_ITEMS)} FROM lineitem WHERE l_orderkey % 10 = 3"
    c["newsletter_requests"] = f"SELECT {s(NEWSLETTER_REQUESTS)} FROM customer"
    c["registrations"] = f"SELECT {s(REGISTRATIONS)} FROM customer"
    c["review_submissions"] = f"SELECT {s(REVIEW_SUBMISSIONS)} FROM events WHERE event_type = 'purchase'"
    c["product_requests"] = (f"SELECT * REPLACE (CAST(collection_name AS VARCHAR) AS collection_name, "
                             "CAST(image2 AS VARCHAR) AS image2, CAST(image4 AS VARCHAR) AS image4) FROM "
                             f"(SELECT {s(PRODUCT_REQUESTS)} FROM part WHERE p_partkey % 9 = 0)")
    c["variant_requests"] = (f"SELECT * REPLACE (CAST(width AS VARCHAR) AS width) FROM "
                             f"(SELECT {s(VARIANT_REQUESTS)} FROM part WHERE p_partkey % 6 = 0)")
    c["message_edits"] = (f"SELECT * REPLACE (CAST(phone AS VARCHAR) AS phone) FROM (SELECT {s(MESSAGE_EDITS)} "
                          "FROM conversations WHERE role = 'user' AND conv_id % 3 = 0)")
    c["coupon_requests"] = f"SELECT {s(COUPON_REQUESTS[1])} FROM orders"
    for name, (src, cond, expr) in DELETE_REQUESTS.items():
        c[name] = f"SELECT {expr} AS id FROM {src} WHERE {cond}"
    c["newsletter_subscribers"] = f"SELECT {s(NEWSLETTER[2])} FROM events WHERE {NEWSLETTER[1]}"
    c["contact_messages"] = (f"SELECT {s(CONTACT_MESSAGES[2])} FROM conversations "
                             f"WHERE {CONTACT_MESSAGES[1]}")
    return c

"""Change-application queries with their oracle SQL.

Each registered query reads a request batch derived from the test tables and
reports one of the operator's outputs (outcomes, or a table after the
change). The order-dependent cart fold's oracle is a recursive CTE replay; it
is also checked against a Python replay in tests/test_changes.py.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pricing as R
from ..operators import cart_fold as CF
from ..operators import changes as G
from ..operators import checkout as CO
from ..operators import reviews as V
from .registry import register

NOW = "2024-02-01 00:00:00"
ORDERS_NOW = "1998-08-03 00:00:00"


def _now():
    return R.ts_literal(NOW)


# ------------------------------------------------------------- carts --------

# Sequential replay of the cart rules as a recursive CTE: step k of a key
# applies its k-th command (by seq) to the state after step k-1.
CART_FOLD_SQL = """
WITH RECURSIVE
c AS (SELECT cc.seq, cc.user_id, cc.variant_id, cc.op, cc.qty, cc.is_gift, v.stock,
             row_number() OVER (PARTITION BY cc.user_id, cc.variant_id ORDER BY cc.seq) AS k
      FROM cart_commands cc LEFT JOIN product_variants v ON v.id = cc.variant_id),
i AS (SELECT user_id, variant_id, MIN(id) AS cid, arg_min(quantity, id) AS q, arg_min(is_gift, id) AS g
      FROM cart_items GROUP BY user_id, variant_id),
keys AS (SELECT DISTINCT user_id, variant_id FROM c),
f AS (
  SELECT k0.user_id, k0.variant_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq,
         CAST(NULL AS VARCHAR) AS op, CAST(NULL AS VARCHAR) AS reason, i.q AS qty, i.g AS gift,
         i.cid AS cid, CAST(NULL AS BIGINT) AS ins
  FROM keys k0 LEFT JOIN i ON i.user_id = k0.user_id AND i.variant_id = k0.variant_id
  UNION ALL
  SELECT f.user_id, f.variant_id, c.k, c.seq, c.op, (CASE c.op WHEN 'add' THEN (CASE WHEN c.qty < 1 THEN 'invalid_request' WHEN c.stock IS NULL THEN 'variant_not_found' WHEN f.qty IS NOT NULL AND f.qty + c.qty > c.stock THEN 'stock_limit' WHEN f.qty IS NULL AND c.qty > c.stock THEN 'insufficient_stock' END) WHEN 'update' THEN (CASE WHEN f.qty IS NULL OR c.stock IS NULL THEN 'not_found' WHEN f.qty + c.qty < 1 THEN 'below_minimum' WHEN f.qty + c.qty > c.stock THEN 'stock_limit' END) WHEN 'remove' THEN (CASE WHEN f.qty IS NULL THEN 'not_found' END) ELSE 'unknown_op' END),
    CASE WHEN (CASE c.op WHEN 'add' THEN (CASE WHEN c.qty < 1 THEN 'invalid_request' WHEN c.stock IS NULL THEN 'variant_not_found' WHEN f.qty IS NOT NULL AND f.qty + c.qty > c.stock THEN 'stock_limit' WHEN f.qty IS NULL AND c.qty > c.stock THEN 'insufficient_stock' END) WHEN 'update' THEN (CASE WHEN f.qty IS NULL OR c.stock IS NULL THEN 'not_found' WHEN f.qty + c.qty < 1 THEN 'below_minimum' WHEN f.qty + c.qty > c.stock THEN 'stock_limit' END) WHEN 'remove' THEN (CASE WHEN f.qty IS NULL THEN 'not_found' END) ELSE 'unknown_op' END) IS NOT NULL THEN f.qty WHEN c.op = 'add' THEN coalesce(f.qty, 0) + c.qty
         WHEN c.op = 'update' THEN f.qty + c.qty END,
    CASE WHEN (CASE c.op WHEN 'add' THEN (CASE WHEN c.qty < 1 THEN 'invalid_request' WHEN c.stock IS NULL THEN 'variant_not_found' WHEN f.qty IS NOT NULL AND f.qty + c.qty > c.stock THEN 'stock_limit' WHEN f.qty IS NULL AND c.qty > c.stock THEN 'insufficient_stock' END) WHEN 'update' THEN (CASE WHEN f.qty IS NULL OR c.stock IS NULL THEN 'not_found' WHEN f.qty + c.qty < 1 THEN 'below_minimum' WHEN f.qty + c.qty > c.stock THEN 'stock_limit' END) WHEN 'remove' THEN (CASE WHEN f.qty IS NULL THEN 'not_found' END) ELSE 'unknown_op' END) IS NULL AND c.op = 'add' AND f.qty IS NULL THEN c.is_gift
         WHEN (CASE c.op WHEN 'add' THEN (CASE WHEN c.qty < 1 THEN 'invalid_request' WHEN c.stock IS NULL THEN 'variant_not_found' WHEN f.qty IS NOT NULL AND f.qty + c.qty > c.stock THEN 'stock_limit' WHEN f.qty IS NULL AND c.qty > c.stock THEN 'insufficient_stock' END) WHEN 'update' THEN (CASE WHEN f.qty IS NULL OR c.stock IS NULL THEN 'not_found' WHEN f.qty + c.qty < 1 THEN 'below_minimum' WHEN f.qty + c.qty > c.stock THEN 'stock_limit' END) WHEN 'remove' THEN (CASE WHEN f.qty IS NULL THEN 'not_found' END) ELSE 'unknown_op' END) IS NULL AND c.op = 'remove' THEN NULL ELSE f.gift END,
    CASE WHEN (CASE c.op WHEN 'add' THEN (CASE WHEN c.qty < 1 THEN 'invalid_request' WHEN c.stock IS NULL THEN 'variant_not_found' WHEN f.qty IS NOT NULL AND f.qty + c.qty > c.stock THEN 'stock_limit' WHEN f.qty IS NULL AND c.qty > c.stock THEN 'insufficient_stock' END) WHEN 'update' THEN (CASE WHEN f.qty IS NULL OR c.stock IS NULL THEN 'not_found' WHEN f.qty + c.qty < 1 THEN 'below_minimum' WHEN f.qty + c.qty > c.stock THEN 'stock_limit' END) WHEN 'remove' THEN (CASE WHEN f.qty IS NULL THEN 'not_found' END) ELSE 'unknown_op' END) IS NULL AND ((c.op = 'add' AND f.qty IS NULL) OR c.op = 'remove') THEN NULL ELSE f.cid END,
    CASE WHEN (CASE c.op WHEN 'add' THEN (CASE WHEN c.qty < 1 THEN 'invalid_request' WHEN c.stock IS NULL THEN 'variant_not_found' WHEN f.qty IS NOT NULL AND f.qty + c.qty > c.stock THEN 'stock_limit' WHEN f.qty IS NULL AND c.qty > c.stock THEN 'insufficient_stock' END) WHEN 'update' THEN (CASE WHEN f.qty IS NULL OR c.stock IS NULL THEN 'not_found' WHEN f.qty + c.qty < 1 THEN 'below_minimum' WHEN f.qty + c.qty > c.stock THEN 'stock_limit' END) WHEN 'remove' THEN (CASE WHEN f.qty IS NULL THEN 'not_found' END) ELSE 'unknown_op' END) IS NULL AND c.op = 'add' AND f.qty IS NULL THEN c.seq
         WHEN (CASE c.op WHEN 'add' THEN (CASE WHEN c.qty < 1 THEN 'invalid_request' WHEN c.stock IS NULL THEN 'variant_not_found' WHEN f.qty IS NOT NULL AND f.qty + c.qty > c.stock THEN 'stock_limit' WHEN f.qty IS NULL AND c.qty > c.stock THEN 'insufficient_stock' END) WHEN 'update' THEN (CASE WHEN f.qty IS NULL OR c.stock IS NULL THEN 'not_found' WHEN f.qty + c.qty < 1 THEN 'below_minimum' WHEN f.qty + c.qty > c.stock THEN 'stock_limit' END) WHEN 'remove' THEN (CASE WHEN f.qty IS NULL THEN 'not_found' END) ELSE 'unknown_op' END) IS NULL AND c.op = 'remove' THEN NULL ELSE f.ins END
  FROM f JOIN c ON c.user_id = f.user_id AND c.variant_id = f.variant_id AND c.k = f.k + 1)
"""


@register("cart_command_outcomes", "G1 G2 G3", sql=CART_FOLD_SQL + """
SELECT seq, user_id, variant_id, op, reason IS NULL AS accepted, reason, qty AS quantity_after
FROM f WHERE k > 0
""")
def cart_command_outcomes(t):
    """Outcome (accepted / reason / quantity after) of every cart command."""
    _, out = CF.apply_cart_commands(t["cart_items"], t["cart_commands"], t["product_variants"])
    return out


@register("cart_command_outcomes_split", "G1 G2 G3", sql=CART_FOLD_SQL + """
SELECT seq, user_id, variant_id, op, reason IS NULL AS accepted, reason, qty AS quantity_after
FROM f WHERE k > 0
""")
def cart_command_outcomes_split(t):
    """The same fold with every key of more than 3 commands split into
    ordered chunks replayed in parallel (the hot-key path)."""
    _, out = CF.apply_cart_commands(t["cart_items"], t["cart_commands"], t["product_variants"],
                                    hot_threshold=3, max_chunks=4)
    return out


CART_AFTER_SQL = CART_FOLD_SQL + """,
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, variant_id ORDER BY k DESC) AS rn
                        FROM f) WHERE rn = 1),
addressed AS (SELECT min(c.id) AS id FROM cart_items c
              WHERE EXISTS (SELECT 1 FROM keys WHERE keys.user_id = c.user_id AND keys.variant_id = c.variant_id)
              GROUP BY c.user_id, c.variant_id)
SELECT coalesce(cid, (SELECT max(id) FROM cart_items) + ins) AS id, user_id, variant_id, qty AS quantity,
       gift AS is_gift
FROM last WHERE qty IS NOT NULL
UNION ALL
SELECT id, user_id, variant_id, CAST(quantity AS BIGINT), CAST(is_gift AS INTEGER)
FROM cart_items WHERE id NOT IN (SELECT id FROM addressed)
"""


@register("cart_after_commands", "G1 G2 G3", sql=CART_AFTER_SQL)
def cart_after_commands(t):
    """The cart table after the command batch."""
    new, _ = CF.apply_cart_commands(t["cart_items"], t["cart_commands"], t["product_variants"])
    return new


# ----------------------------------------------------------- wishlist -------

@register("wishlist_after_toggles", "G4", sql="""
WITH a AS (SELECT user_id, product_id, COUNT(*) AS n, MAX(event_id) AS last FROM wishlist_events
           GROUP BY user_id, product_id),
j AS (SELECT coalesce(w.user_id, a.user_id) AS user_id, coalesce(w.product_id, a.product_id) AS product_id,
             w.id, coalesce(a.n, 0) AS n, a.last FROM wishlist w FULL OUTER JOIN a
             ON a.user_id = w.user_id AND a.product_id = w.product_id)
SELECT CASE WHEN n = 0 THEN id ELSE (SELECT max(id) FROM wishlist) + last END AS id, user_id, product_id
FROM j WHERE (id IS NOT NULL) <> (n % 2 = 1)
""")
def wishlist_after_toggles(t):
    tog = t["wishlist_events"].select(F.col("event_id").alias("seq"), "user_id", "product_id")
    new, _ = G.toggle_wishlist(t["wishlist"], tog)
    return new


@register("wishlist_toggle_outcomes", "G4", sql="""
SELECT e.event_id AS seq, e.user_id, e.product_id,
  CASE WHEN (w.id IS NOT NULL) <> (row_number() OVER (PARTITION BY e.user_id, e.product_id
            ORDER BY e.event_id) % 2 = 0) THEN 'removed' ELSE 'added' END AS action
FROM wishlist_events e LEFT JOIN wishlist w ON w.user_id = e.user_id AND w.product_id = e.product_id
""")
def wishlist_toggle_outcomes(t):
    tog = t["wishlist_events"].select(F.col("event_id").alias("seq"), "user_id", "product_id")
    _, out = G.toggle_wishlist(t["wishlist"], tog)
    return out


# --------------------------------------------------------- newsletter -------

SUB_SQL = """
WITH r AS (SELECT *, seq = MIN(seq) OVER (PARTITION BY lower(email)) AS first FROM newsletter_requests)
SELECT seq, email,
  CASE WHEN email IS NULL OR email = '' THEN 'email_required'
       WHEN lower(email) IN (SELECT lower(email) FROM newsletter_subscribers) OR NOT first
       THEN 'already_subscribed' END AS reason
FROM r
"""


@register("newsletter_subscribe_outcomes", "G5", sql=f"""
SELECT seq, email, reason IS NULL AS accepted, reason FROM ({SUB_SQL}) x
""")
def newsletter_subscribe_outcomes(t):
    _, out = G.subscribe(t["newsletter_subscribers"], t["newsletter_requests"], _now())
    return out


@register("newsletter_after_subscribe", "G5", sql=f"""
SELECT id, email, subscribed_at FROM newsletter_subscribers UNION ALL
SELECT (SELECT max(id) FROM newsletter_subscribers) + seq, email, TIMESTAMP '{NOW}'
FROM ({SUB_SQL}) x WHERE reason IS NULL
""")
def newsletter_after_subscribe(t):
    new, _ = G.subscribe(t["newsletter_subscribers"], t["newsletter_requests"], _now())
    return new


@register("newsletter_after_unsubscribe", "G6", sql="""
SELECT * FROM newsletter_subscribers WHERE id NOT IN (SELECT id FROM unsubscribe_requests)
""")
def newsletter_after_unsubscribe(t):
    return G.unsubscribe(t["newsletter_subscribers"], t["unsubscribe_requests"])


# ------------------------------------------------------------ reviews -------

REV_SQL = """
WITH bought AS (SELECT DISTINCT o.user_id, oi.product_id FROM shop_orders o
                JOIN order_items oi ON oi.order_id = o.id WHERE o.payment_status = 'paid'),
s AS (SELECT *, seq = MIN(seq) OVER (PARTITION BY user_id, product_id) AS first FROM review_submissions)
SELECT s.*, CASE WHEN NOT EXISTS (SELECT 1 FROM bought b WHERE b.user_id = s.user_id
                                  AND b.product_id = s.product_id) THEN 'purchase'
                 WHEN EXISTS (SELECT 1 FROM reviews r WHERE r.user_id = s.user_id AND r.product_id = s.product_id)
                      OR NOT first THEN 'already_reviewed' END AS reason
FROM s
"""


@register("review_submit_outcomes", "G7 C12 C13", sql=f"""
SELECT seq, user_id, product_id, reason IS NULL AS accepted, reason FROM ({REV_SQL}) x
""")
def review_submit_outcomes(t):
    _, out = G.submit_reviews(t["reviews"], t["review_submissions"], V.paid_purchases(t), _now())
    return out


@register("reviews_after_submit", "G7", sql=f"""
SELECT id, user_id, product_id, rating, title, comment, created_at FROM reviews UNION ALL
SELECT (SELECT max(id) FROM reviews) + seq, user_id, product_id, rating, title, comment, TIMESTAMP '{NOW}'
FROM ({REV_SQL}) x WHERE reason IS NULL
""")
def reviews_after_submit(t):
    new, _ = G.submit_reviews(t["reviews"], t["review_submissions"], V.paid_purchases(t), _now())
    return new


EDIT_SQL = """
WITH ok AS (SELECT q.* FROM review_edit_requests q JOIN reviews r ON r.id = q.review_id AND r.user_id = q.user_id),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY review_id DESC) AS rn
                        FROM ok) WHERE rn = 1)
SELECT r.id, r.user_id, r.product_id,
  CASE WHEN l.op = 'update' THEN l.rating ELSE r.rating END AS rating,
  CASE WHEN l.op = 'update' THEN l.title ELSE r.title END AS title,
  CASE WHEN l.op = 'update' THEN l.comment ELSE r.comment END AS comment, r.created_at
FROM reviews r LEFT JOIN last l ON l.review_id = r.id WHERE l.op IS NULL OR l.op <> 'delete'
"""


@register("reviews_after_owner_edits", "G8 C19", sql=EDIT_SQL)
def reviews_after_owner_edits(t):
    req = t["review_edit_requests"].withColumn("seq", F.col("review_id"))
    new, _ = G.edit_reviews(t["reviews"], req)
    return new


@register("reviews_after_admin_edits", "G8", sql=EDIT_SQL.replace(
    "JOIN reviews r ON r.id = q.review_id AND r.user_id = q.user_id",
    "JOIN reviews r ON r.id = q.review_id"))
def reviews_after_admin_edits(t):
    req = t["review_edit_requests"].withColumn("seq", F.col("review_id"))
    new, _ = G.edit_reviews(t["reviews"], req, admin=True)
    return new


# -------------------------------------------------------------- users -------

REG_SQL = """
WITH ok AS (SELECT seq, email FROM registrations WHERE trim(first_name) <> '' AND trim(last_name) <> ''
            AND trim(email) <> '')
SELECT seq, email,
  CASE WHEN seq NOT IN (SELECT seq FROM ok) THEN 'missing_fields'
       WHEN lower(email) IN (SELECT lower(email) FROM users)
            OR EXISTS (SELECT 1 FROM ok WHERE lower(ok.email) = lower(r.email) AND ok.seq < r.seq)
       THEN 'email_taken' END AS reason,
  first_name, last_name
FROM registrations r
"""


@register("registration_outcomes", "G9 B22", sql=f"""
SELECT seq, email, reason IS NULL AS accepted, reason FROM ({REG_SQL}) x
""")
def registration_outcomes(t):
    _, out = G.register_users(t["users"], t["registrations"])
    return out


@register("users_after_registration", "G9", sql=f"""
SELECT id, first_name, last_name, email, provider, is_admin FROM users UNION ALL
SELECT (SELECT max(id) FROM users) + seq, first_name, last_name, email, CAST(NULL AS VARCHAR), 0
FROM ({REG_SQL}) x WHERE reason IS NULL
""")
def users_after_registration(t):
    new, _ = G.register_users(t["users"], t["registrations"])
    return new


@register("users_after_social_sign_in", "G9", sql="""
WITH r AS (SELECT *, seq = MIN(seq) OVER (PARTITION BY lower(email)) AS first FROM registrations)
SELECT id, first_name, last_name, email, provider, is_admin FROM users UNION ALL
SELECT (SELECT max(id) FROM users) + seq, first_name, last_name, email, 'google', 0 FROM r
WHERE first AND lower(email) NOT IN (SELECT lower(email) FROM users)
""")
def users_after_social_sign_in(t):
    return G.social_sign_in(t["users"], t["registrations"])


# Step by step: request k meets the addresses that request k - 1 left.
UEDIT_SQL = """
WITH RECURSIVE req AS (
  SELECT *, lower(email) AS e, row_number() OVER (ORDER BY seq) AS k,
         coalesce(first_name, '') <> '' AND coalesce(last_name, '') <> '' AND coalesce(email, '') <> '' AS filled
  FROM profile_updates),
steps AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS reason,
         (SELECT map(list(id ORDER BY id), list(lower(email) ORDER BY id)) FROM users) AS book
  UNION ALL
  SELECT k, seq, reason, CASE WHEN reason IS NULL THEN map(map_keys(book), list_transform(map_entries(book),
           lambda x: CASE WHEN x.key = user_id THEN e ELSE x.value END)) ELSE book END
  FROM (SELECT r.k, r.seq, r.user_id, r.e, s.book, CASE WHEN NOT r.filled THEN 'missing_fields'
          WHEN len(list_filter(map_entries(s.book), lambda x: x.value = r.e AND x.key <> r.user_id)) > 0
          THEN 'email_taken' END AS reason
        FROM steps s JOIN req r ON r.k = s.k + 1) z),
r AS (SELECT req.*, reason FROM req JOIN steps USING (k)),
stands AS (SELECT * FROM r WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1)
"""


@register("user_edit_outcomes", "G10 B22 B27", sql=UEDIT_SQL + """
SELECT seq, user_id, reason IS NULL AS accepted, reason FROM r
""")
def user_edit_outcomes(t):
    _, out = G.edit_users(t["users"], t["profile_updates"])
    return out


@register("users_after_edit", "G10", sql=UEDIT_SQL + """
SELECT u.id, CASE WHEN r.user_id IS NOT NULL THEN r.first_name ELSE u.first_name END AS first_name,
       CASE WHEN r.user_id IS NOT NULL THEN r.last_name ELSE u.last_name END AS last_name,
       CASE WHEN r.user_id IS NOT NULL THEN r.email ELSE u.email END AS email, u.provider, u.is_admin
FROM users u LEFT JOIN stands r ON r.user_id = u.id
WHERE u.id NOT IN (SELECT id FROM user_delete_requests)
""")
def users_after_edit(t):
    new, _ = G.edit_users(t["users"], t["profile_updates"])
    return G.delete_users(new, t["user_delete_requests"])


@register("users_after_admin_edit", "G10", sql="""
SELECT u.id, CASE WHEN p.user_id IS NOT NULL THEN p.first_name ELSE u.first_name END AS first_name,
       CASE WHEN p.user_id IS NOT NULL THEN p.last_name ELSE u.last_name END AS last_name,
       CASE WHEN p.user_id IS NOT NULL THEN p.email ELSE u.email END AS email, u.provider, u.is_admin
FROM users u LEFT JOIN (SELECT user_id, arg_max(first_name, seq) AS first_name, arg_max(last_name, seq) AS last_name,
                               arg_max(email, seq) AS email FROM profile_updates GROUP BY user_id) p ON p.user_id = u.id
""")
def users_after_admin_edit(t):
    """G10 admin path: edits apply as given (no blank or e-mail checks)."""
    new, _ = G.edit_users(t["users"], t["profile_updates"], admin=True)
    return new


# ------------------------------------------------------------ catalog -------

@register("products_after_upsert", "G11", sql="""
WITH u AS (SELECT * FROM product_requests WHERE id IS NOT NULL)
SELECT p.id,
  CASE WHEN u.id IS NOT NULL THEN u.name ELSE p.name END AS name,
  CASE WHEN u.id IS NOT NULL THEN u.description ELSE p.description END AS description,
  CASE WHEN u.id IS NOT NULL THEN u.category ELSE p.category END AS category,
  CASE WHEN u.id IS NOT NULL THEN u.sub_category ELSE p.sub_category END AS sub_category,
  CASE WHEN u.id IS NOT NULL THEN u.collection_name ELSE p.collection_name END AS collection_name,
  CASE WHEN u.id IS NOT NULL THEN u.metal ELSE p.metal END AS metal,
  p.is_gifting, p.gifting_category,
  coalesce(u.image1, p.image1) AS image1, coalesce(u.image2, p.image2) AS image2,
  coalesce(u.image3, p.image3) AS image3, coalesce(u.image4, p.image4) AS image4
FROM products p LEFT JOIN u ON u.id = p.id
UNION ALL
SELECT (SELECT max(id) FROM products) + seq, name, description, category, sub_category, collection_name,
       metal, is_gifting, gifting_category, image1, image2, image3, image4
FROM product_requests WHERE id IS NULL AND name <> ''
""")
def products_after_upsert(t):
    return G.upsert_products(t["products"], t["product_requests"])


@register("products_after_delete", "G12", sql="""
SELECT * FROM products WHERE id NOT IN (SELECT id FROM product_delete_requests)
""")
def products_after_delete(t):
    p, _ = G.delete_products(t["products"], t["product_variants"], t["product_delete_requests"])
    return p


@register("variants_after_product_delete", "G12", sql="""
SELECT * FROM product_variants WHERE product_id NOT IN (SELECT id FROM product_delete_requests)
""", money=("price",))
def variants_after_product_delete(t):
    _, v = G.delete_products(t["products"], t["product_variants"], t["product_delete_requests"])
    return v


VREQ_SQL = """
WITH r AS (SELECT * REPLACE (CASE WHEN trim(finish) <> '' THEN finish END AS finish,
                             CASE WHEN trim(gemstones_colour) <> '' THEN gemstones_colour END AS gemstones_colour,
                             CASE WHEN trim(length_size) <> '' THEN length_size END AS length_size,
                             CASE WHEN trim(width) <> '' THEN width END AS width,
                             CASE WHEN trim(thickness) <> '' THEN thickness END AS thickness,
                             coalesce(stock, 0) AS stock),
                  product_id IS NOT NULL AND coalesce(price, 0) <> 0 AND coalesce(sku, '') <> '' AS need
           FROM variant_requests),
ins AS (SELECT *, CASE WHEN NOT need THEN 'missing_fields'
                       WHEN sku IN (SELECT sku FROM product_variants)
                         OR seq <> MIN(seq) FILTER (need) OVER (PARTITION BY sku) THEN 'duplicate_sku' END AS reason
        FROM r WHERE id IS NULL),
upd AS (SELECT *, CASE WHEN NOT need THEN 'missing_fields' END AS reason FROM r WHERE id IS NOT NULL)
"""


@register("variant_upsert_outcomes", "G13 B25", sql=VREQ_SQL + """
SELECT seq, id, sku, reason, reason IS NULL AS accepted FROM ins UNION ALL
SELECT seq, id, sku, reason, reason IS NULL AS accepted FROM upd
""")
def variant_upsert_outcomes(t):
    _, out = G.upsert_variants(t["product_variants"], t["variant_requests"], api=True)
    return out


@register("variants_after_upsert", "G13", money=("price",), sql=VREQ_SQL + """
SELECT v.id, v.product_id, v.sku,
  CASE WHEN u.id IS NOT NULL THEN u.price ELSE v.price END AS price,
  CASE WHEN u.id IS NOT NULL THEN u.stock ELSE v.stock END AS stock,
  CASE WHEN u.id IS NOT NULL THEN u.finish ELSE v.finish END AS finish,
  CASE WHEN u.id IS NOT NULL THEN u.gemstones_colour ELSE v.gemstones_colour END AS gemstones_colour,
  CASE WHEN u.id IS NOT NULL THEN u.length_size ELSE v.length_size END AS length_size,
  CASE WHEN u.id IS NOT NULL THEN u.width ELSE v.width END AS width,
  CASE WHEN u.id IS NOT NULL THEN u.thickness ELSE v.thickness END AS thickness
FROM product_variants v LEFT JOIN (SELECT * FROM upd WHERE reason IS NULL) u ON u.id = v.id
UNION ALL
SELECT (SELECT max(id) FROM product_variants) + seq, product_id, sku, price, stock, finish, gemstones_colour,
       length_size, width, thickness FROM ins WHERE reason IS NULL
""")
def variants_after_upsert(t):
    new, _ = G.upsert_variants(t["product_variants"], t["variant_requests"], api=True)
    return new


ADMIN_VREQ_SQL = """
WITH r AS (SELECT *, product_id IS NOT NULL AND coalesce(price, 0) <> 0 AS need FROM variant_requests),
ins AS (SELECT *, CASE WHEN NOT need THEN 'missing_fields'
                       WHEN sku IN (SELECT sku FROM product_variants)
                         OR seq <> MIN(seq) FILTER (need) OVER (PARTITION BY sku) THEN 'duplicate_sku' END AS reason
        FROM r WHERE id IS NULL),
upd AS (SELECT *, CASE WHEN NOT need THEN 'missing_fields' END AS reason FROM r WHERE id IS NOT NULL)
"""


@register("variants_after_admin_upsert", "G13 B25", money=("price",), sql=ADMIN_VREQ_SQL + """
SELECT v.id, v.product_id, v.sku,
  CASE WHEN u.id IS NOT NULL THEN u.price ELSE v.price END AS price,
  CASE WHEN u.id IS NOT NULL THEN u.stock ELSE v.stock END AS stock,
  CASE WHEN u.id IS NOT NULL THEN u.finish ELSE v.finish END AS finish,
  CASE WHEN u.id IS NOT NULL THEN u.gemstones_colour ELSE v.gemstones_colour END AS gemstones_colour,
  CASE WHEN u.id IS NOT NULL THEN u.length_size ELSE v.length_size END AS length_size,
  CASE WHEN u.id IS NOT NULL THEN u.width ELSE v.width END AS width,
  CASE WHEN u.id IS NOT NULL THEN u.thickness ELSE v.thickness END AS thickness
FROM product_variants v LEFT JOIN (SELECT * FROM upd WHERE reason IS NULL) u ON u.id = v.id
UNION ALL
SELECT (SELECT max(id) FROM product_variants) + seq, product_id, sku, price, stock, finish, gemstones_colour,
       length_size, width, thickness FROM ins WHERE reason IS NULL
""")
def variants_after_admin_upsert(t):
    """G13 admin path: product and price required, sku not; values as given."""
    new, _ = G.upsert_variants(t["product_variants"], t["variant_requests"], api=False)
    return new


# ----------------------------------------------------------- messages -------

@register("message_validation", "B21", sql="""
SELECT id, CASE WHEN coalesce(name, '') = '' OR coalesce(email, '') = '' OR coalesce(message, '') = ''
                THEN 'missing_fields'
                WHEN coalesce(phone, '') <> '' AND NOT coalesce(regexp_matches(phone, '^[0-9]{10}$'), false)
                THEN 'bad_phone'
                WHEN NOT coalesce(regexp_matches(trim(email), '^\\S+@\\S+\\.\\S+$'), false) THEN 'bad_email'
           END AS reason
FROM contact_messages
""")
def message_validation(t):
    return G.validate_messages(t["contact_messages"]).select("id", "reason")


@register("messages_after_edit", "G14", sql="""
SELECT m.id,
  CASE WHEN e.id IS NOT NULL AND NOT (e.name IS NULL AND e.email IS NULL AND e.phone IS NULL AND e.message IS NULL)
       THEN e.name ELSE m.name END AS name,
  CASE WHEN e.id IS NOT NULL AND NOT (e.name IS NULL AND e.email IS NULL AND e.phone IS NULL AND e.message IS NULL)
       THEN e.email ELSE m.email END AS email,
  CASE WHEN e.id IS NOT NULL AND NOT (e.name IS NULL AND e.email IS NULL AND e.phone IS NULL AND e.message IS NULL)
       THEN e.phone ELSE m.phone END AS phone,
  CASE WHEN e.id IS NOT NULL AND NOT (e.name IS NULL AND e.email IS NULL AND e.phone IS NULL AND e.message IS NULL)
       THEN e.message ELSE m.message END AS message,
  CASE WHEN e.id IS NOT NULL THEN e.status ELSE m.status END AS status
FROM contact_messages m LEFT JOIN message_edits e ON e.id = m.id
WHERE m.id NOT IN (SELECT id FROM message_delete_requests)
""")
def messages_after_edit(t):
    m = G.edit_messages(t["contact_messages"], t["message_edits"])
    return G.delete_messages(m, t["message_delete_requests"])


@register("messages_after_insert", "G14 B21", sql="""
SELECT id, name, email, phone, message, status FROM contact_messages UNION ALL
SELECT (SELECT max(id) FROM contact_messages) + id, trim(name), trim(email),
       CASE WHEN coalesce(phone, '') <> '' THEN trim(phone) END, trim(message), 1
FROM contact_messages
WHERE NOT (coalesce(name, '') = '' OR coalesce(email, '') = '' OR coalesce(message, '') = '')
  AND NOT (coalesce(phone, '') <> '' AND NOT coalesce(regexp_matches(phone, '^[0-9]{10}$'), false))
  AND coalesce(regexp_matches(trim(email), '^\\S+@\\S+\\.\\S+$'), false)
""")
def messages_after_insert(t):
    m = t["contact_messages"]
    new, _ = G.insert_messages(m, m.withColumn("seq", F.col("id")))
    return new


# ---------------------------------------------------------- checkout --------

CART_SQL = """
SELECT ci.user_id, ci.id AS cart_id, ci.quantity, ci.is_gift, v.id AS variant_id, v.price, v.stock, v.sku,
       p.id AS product_id, p.name
FROM cart_items ci JOIN product_variants v ON v.id = ci.variant_id JOIN products p ON p.id = v.product_id
"""
COD_SQL = f"""
WITH chk AS (SELECT user_id, COUNT(*) AS nl, bool_and(stock >= quantity) AS ok,
                    arg_min(name, cart_id) FILTER (WHERE stock < quantity) AS short
             FROM ({CART_SQL}) c GROUP BY user_id),
r AS (SELECT q.*, chk.ok, chk.short,
        CASE WHEN coalesce(q.billing_name, '') = '' OR coalesce(q.billing_phone, '') = '' THEN 'invalid_billing'
             WHEN coalesce(chk.nl, 0) = 0 THEN 'cart_empty' END AS r0
      FROM checkout_requests q LEFT JOIN chk ON chk.user_id = q.user_id),
e AS (SELECT user_id, MIN(seq) AS eff FROM r WHERE r0 IS NULL GROUP BY user_id)
SELECT r.seq, r.user_id,
  CASE WHEN r.r0 IS NOT NULL THEN r.r0 WHEN NOT coalesce(r.ok, true) THEN 'Insufficient stock for ' || r.short
       WHEN r.seq > e.eff THEN 'cart_empty' END AS reason
FROM r LEFT JOIN e ON e.user_id = r.user_id
"""


# Step by step: request k meets the stock and the carts that request k - 1 left.
COD_STEPS_SQL = f"""
WITH RECURSIVE cart AS ({CART_SQL}),
li AS (SELECT user_id, list({{'v': variant_id, 'q': CAST(quantity AS BIGINT), 'n': name}} ORDER BY cart_id) AS ls
       FROM cart GROUP BY user_id),
req AS (SELECT q.seq, q.user_id, coalesce(q.billing_name, '') <> '' AND coalesce(q.billing_phone, '') <> '' AS bill,
               li.ls, row_number() OVER (ORDER BY q.seq) AS k
        FROM checkout_requests q LEFT JOIN li ON li.user_id = q.user_id),
steps AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS user_id,
         CAST(NULL AS VARCHAR) AS reason,
         (SELECT map(list(id ORDER BY id), list(CAST(stock AS BIGINT) ORDER BY id)) FROM product_variants
          WHERE id IN (SELECT variant_id FROM cart)) AS rem, CAST([] AS BIGINT[]) AS gone
  UNION ALL
  SELECT k, seq, user_id, reason,
         CASE WHEN reason IS NULL THEN map(map_keys(rem), list_transform(map_entries(rem), lambda e:
           e.value - coalesce(list_sum(list_transform(list_filter(ls, lambda x: x.v = e.key), lambda x: x.q)), 0)))
         ELSE rem END,
         CASE WHEN reason IS NULL THEN list_append(gone, user_id) ELSE gone END
  FROM (SELECT r.k, r.seq, r.user_id, r.ls, s.rem, s.gone,
               CASE WHEN NOT r.bill THEN 'invalid_billing'
                    WHEN r.ls IS NULL OR list_contains(s.gone, r.user_id) THEN 'cart_empty'
                    WHEN len(list_filter(r.ls, lambda x: x.q > s.rem[x.v])) > 0
                    THEN 'Insufficient stock for ' || list_filter(r.ls, lambda x: x.q > s.rem[x.v])[1].n END AS reason
        FROM steps s JOIN req r ON r.k = s.k + 1) z)
SELECT seq, user_id, reason FROM steps WHERE k > 0
"""


@register("cod_checkout_outcomes", "G15 F7 B24", sql=f"""
SELECT seq, user_id, reason IS NULL AS accepted, reason FROM ({COD_SQL}) x
""")
def cod_checkout_outcomes(t):
    """Each cart on its own against the stock at the start of the batch."""
    return CO.checkout(t, t["checkout_requests"], _now(), "cod", stock_policy="opening")["outcomes"]


@register("cod_checkout_fcfs_outcomes", "G15 F7", sql=f"""
SELECT seq, user_id, reason IS NULL AS accepted, reason FROM ({COD_STEPS_SQL}) x
""")
def cod_checkout_fcfs_outcomes(t):
    """COD checkouts served first-come-first-served across users against
    the stock earlier accepted carts left."""
    return CO.checkout(t, t["checkout_requests"], _now(), "cod")["outcomes"]


@register("stock_after_cod_checkout", "G15 G23", sql=f"""
WITH ok AS (SELECT user_id FROM ({COD_STEPS_SQL}) x WHERE reason IS NULL),
d AS (SELECT variant_id, SUM(quantity) AS q FROM ({CART_SQL}) c WHERE user_id IN (SELECT user_id FROM ok)
      GROUP BY variant_id)
SELECT v.id, CAST(v.stock - coalesce(d.q, 0) AS INTEGER) AS stock
FROM product_variants v LEFT JOIN d ON d.variant_id = v.id
""")
def stock_after_cod_checkout(t):
    res = CO.checkout(t, t["checkout_requests"], _now(), "cod")
    return CO.apply_stock_deltas(t["product_variants"], res["stock_deltas"]).select("id", "stock")


@register("cod_checkout_orders", "G15", money=("total", "grand_total"), sql=f"""
SELECT (SELECT max(id) FROM shop_orders) + x.seq AS id, x.user_id, 'pending' AS status, 'unpaid' AS payment_status,
       CAST(SUM(c.price * c.quantity) AS DECIMAL(12,2)) AS total,
       CAST(SUM(c.price * c.quantity) AS DECIMAL(12,2)) AS grand_total, COUNT(*) AS n_items
FROM ({COD_STEPS_SQL}) x JOIN ({CART_SQL}) c ON c.user_id = x.user_id WHERE x.reason IS NULL
GROUP BY x.seq, x.user_id
""")
def cod_checkout_orders(t):
    res = CO.checkout(t, t["checkout_requests"], _now(), "cod")
    n = res["order_items"].groupBy("order_id").agg(F.count(F.lit(1)).alias("n_items"))
    o = res["orders"]
    return o.join(n, o["id"] == n["order_id"]).select("id", "user_id", "status", "payment_status",
                                                      "total", "grand_total", "n_items")


@register("cod_checkout_items", "G15", money=("price",), sql=f"""
SELECT (SELECT max(id) FROM shop_orders) + x.seq AS order_id, c.product_id, c.variant_id, c.name AS product_name,
       CAST(NULL AS VARCHAR) AS sku, c.quantity, CAST(c.price AS DECIMAL(12,2)) AS price, c.is_gift
FROM ({COD_STEPS_SQL}) x JOIN ({CART_SQL}) c ON c.user_id = x.user_id WHERE x.reason IS NULL
""")
def cod_checkout_items(t):
    """Every written column of the new orders' items."""
    return CO.checkout(t, t["checkout_requests"], _now(), "cod")["order_items"]


ADDRESS_SQL = """
       'billing' AS type, q.billing_name AS name, q.billing_phone AS phone, q.billing_email AS email,
       q.billing_address AS address_line1, q.billing_city AS city, q.billing_state AS state, q.billing_pincode AS pincode,
       'India' AS country
"""


@register("cod_checkout_addresses", "G15", sql=f"""
SELECT (SELECT max(id) FROM shop_orders) + x.seq AS order_id, {ADDRESS_SQL}
FROM ({COD_STEPS_SQL}) x JOIN checkout_requests q ON q.seq = x.seq WHERE x.reason IS NULL
""")
def cod_checkout_addresses(t):
    return CO.checkout(t, t["checkout_requests"], _now(), "cod")["order_addresses"]


GATEWAY_OK_SQL = f"""
SELECT q.* FROM checkout_requests q JOIN (SELECT user_id, bool_and(stock >= quantity) AS ok FROM ({CART_SQL}) c
                                          GROUP BY user_id) k ON k.user_id = q.user_id AND k.ok
WHERE coalesce(q.coupon_code, '') = '' OR EXISTS (SELECT 1 FROM coupons c WHERE lower(c.code) = lower(trim(q.coupon_code))
      AND c.active = 1 AND (c.usage_limit IS NULL OR c.used_count < c.usage_limit))
"""


@register("gateway_checkout_items", "G16", money=("price",), sql=f"""
SELECT (SELECT max(id) FROM shop_orders) + q.seq AS order_id, c.product_id, c.variant_id, c.name AS product_name, c.sku,
       c.quantity, CAST(c.price AS DECIMAL(12,2)) AS price, c.is_gift
FROM ({GATEWAY_OK_SQL}) q JOIN ({CART_SQL}) c ON c.user_id = q.user_id
""")
def gateway_checkout_items(t):
    """Every written column of the gateway orders' items, the SKU included."""
    return CO.checkout(t, t["checkout_requests"], _now(), "gateway")["order_items"]


@register("gateway_checkout_addresses", "G16", sql=f"""
SELECT (SELECT max(id) FROM shop_orders) + q.seq AS order_id, {ADDRESS_SQL} FROM ({GATEWAY_OK_SQL}) q
""")
def gateway_checkout_addresses(t):
    return CO.checkout(t, t["checkout_requests"], _now(), "gateway")["order_addresses"]


@register("gateway_checkout_orders", "G16 F1", money=("subtotal", "discount", "grand_total"), sql=f"""
WITH chk AS (SELECT user_id, COUNT(*) AS nl, bool_and(stock >= quantity) AS ok,
                    CAST(SUM(price * quantity) AS DECIMAL(12,2)) AS sub FROM ({CART_SQL}) c GROUP BY user_id),
r AS (SELECT q.*, chk.sub FROM checkout_requests q JOIN chk ON chk.user_id = q.user_id WHERE chk.ok),
fc AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY lower(c.code) ORDER BY c.id) AS rk
                      FROM coupons c WHERE c.active = 1 AND (c.usage_limit IS NULL OR c.used_count < c.usage_limit))
       WHERE rk = 1),
q AS (SELECT r.*, fc.id AS cid,
        CAST(CASE WHEN fc.type = 'percent' THEN least(round(r.sub * fc.value * CAST(0.01 AS DECIMAL(3,2)), 2),
                  CASE WHEN fc.max_discount IS NOT NULL AND fc.max_discount <> 0 THEN fc.max_discount
                  ELSE 999999 END) ELSE fc.value END AS DECIMAL(12,2)) AS disc
      FROM r LEFT JOIN fc ON lower(trim(r.coupon_code)) = lower(fc.code)
      WHERE (coalesce(r.coupon_code, '') = '' OR fc.id IS NOT NULL))
SELECT (SELECT max(id) FROM shop_orders) + seq AS id, user_id, 'pending_payment' AS status,
       CASE WHEN coalesce(coupon_code, '') <> '' THEN cid END AS coupon_id,
       sub AS subtotal, CASE WHEN coalesce(coupon_code, '') <> '' THEN disc ELSE 0 END AS discount,
       greatest(CAST(sub - CASE WHEN coalesce(coupon_code, '') <> '' THEN disc ELSE 0 END AS DECIMAL(12,2)),
                0) AS grand_total
FROM q
""")
def gateway_checkout_orders(t):
    o = CO.checkout(t, t["checkout_requests"], _now(), "gateway")["orders"]
    return o.select("id", "user_id", "status", "coupon_id", "subtotal", "discount", "grand_total")


@register("stock_after_payments", "G17 G23", sql="""
WITH d AS (SELECT oi.variant_id, SUM(oi.quantity) AS q FROM order_items oi
           WHERE oi.order_id IN (SELECT order_id FROM payment_confirmations) GROUP BY oi.variant_id)
SELECT v.id, CAST(v.stock - coalesce(d.q, 0) AS INTEGER) AS stock
FROM product_variants v LEFT JOIN d ON d.variant_id = v.id
""")
def stock_after_payments(t):
    res = CO.confirm_payments(t, t["payment_confirmations"])
    return CO.apply_stock_deltas(t["product_variants"], res["stock_deltas"]).select("id", "stock")


@register("orders_after_payments", "G17", sql="""
SELECT o.id, CASE WHEN p.order_id IS NOT NULL THEN 'confirmed' ELSE o.status END AS status,
       CASE WHEN p.order_id IS NOT NULL THEN 'paid' ELSE o.payment_status END AS payment_status, p.payment_id
FROM shop_orders o LEFT JOIN (SELECT order_id, max(payment_id) AS payment_id FROM payment_confirmations
                              GROUP BY order_id) p ON p.order_id = o.id
""")
def orders_after_payments(t):
    return CO.confirm_payments(t, t["payment_confirmations"])["orders"].select("id", "status", "payment_status",
                                                                                "payment_id")


ORDER_CREATE_SQL = f"""
WITH agg AS (SELECT seq, COUNT(*) AS n, bool_and(price IS NOT NULL AND quantity > 0) AS ok,
                    CAST(SUM(CAST(price * quantity AS DECIMAL(22,2))) AS DECIMAL(12,2)) AS sub
             FROM order_request_items GROUP BY seq),
fc AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY lower(c.code) ORDER BY c.id) AS rk
                      FROM coupons c WHERE c.active = 1
                        AND (c.start_date IS NULL OR c.start_date <= TIMESTAMP '{ORDERS_NOW}')
                        AND (c.end_date IS NULL OR c.end_date >= TIMESTAMP '{ORDERS_NOW}')
                        AND (c.usage_limit IS NULL OR c.used_count < c.usage_limit)) WHERE rk = 1),
r AS (SELECT q.*, agg.n, agg.ok, agg.sub, fc.id AS cid, fc.usage_limit, fc.used_count,
        CASE WHEN coalesce(agg.n, 0) = 0 OR NOT agg.ok THEN 'invalid_items'
             WHEN coalesce(q.coupon_code, '') <> '' AND fc.id IS NULL THEN 'invalid_coupon'
             WHEN coalesce(q.coupon_code, '') <> '' AND EXISTS (SELECT 1 FROM coupon_usages u
                  WHERE u.coupon_id = fc.id AND u.user_id = q.user_id) THEN 'already_used'
             WHEN coalesce(q.coupon_code, '') <> '' AND coalesce(agg.sub, 0) < coalesce(fc.min_order, 0)
                  THEN 'min_order'
             WHEN coalesce(q.ship_name, '') = '' OR coalesce(q.ship_phone, '') = '' OR coalesce(q.ship_pincode, '') = ''
               OR coalesce(q.bill_name, '') = '' OR coalesce(q.bill_phone, '') = ''
               OR coalesce(q.bill_pincode, '') = '' THEN 'invalid_address' END AS r0
      FROM order_requests q LEFT JOIN agg ON agg.seq = q.seq
      LEFT JOIN fc ON lower(trim(coalesce(q.coupon_code, ''))) = lower(fc.code)),
cand AS (SELECT * FROM r WHERE r0 IS NULL AND coalesce(coupon_code, '') <> ''),
one AS (SELECT * FROM cand a WHERE NOT EXISTS (SELECT 1 FROM cand b WHERE b.cid = a.cid AND b.user_id = a.user_id
                                               AND b.seq < a.seq)),
rk AS (SELECT cid, user_id, seq, usage_limit IS NOT NULL
              AND row_number() OVER (PARTITION BY cid ORDER BY seq) > usage_limit - used_count AS over FROM one)
SELECT r.seq, r.user_id, r.cid, CASE WHEN r.r0 IS NOT NULL THEN r.r0
         WHEN rk.over THEN 'usage_limit' WHEN r.seq > rk.seq THEN 'already_used' END AS reason
FROM r LEFT JOIN rk ON rk.cid = r.cid AND rk.user_id = r.user_id AND r.r0 IS NULL AND coalesce(r.coupon_code, '') <> ''
"""


@register("order_create_outcomes", "G18 B23 F1", sql=f"""
SELECT seq, user_id, reason IS NULL AS accepted, reason FROM ({ORDER_CREATE_SQL}) x
""")
def order_create_outcomes(t):
    return CO.create_orders(t, t["order_requests"], t["order_request_items"],
                            R.ts_literal(ORDERS_NOW))["outcomes"]


def _created(t, table):
    return CO.create_orders(t, t["order_requests"], t["order_request_items"], R.ts_literal(ORDERS_NOW))[table]


@register("order_create_orders", "G18 F2", money=("subtotal",), sql=f"""
SELECT (SELECT max(id) FROM shop_orders) + x.seq AS id, x.user_id, 'pending' AS status, 'unpaid' AS payment_status,
       coalesce(q.payment_method, 'razorpay') AS payment_method,
       CASE WHEN coalesce(q.coupon_code, '') <> '' THEN x.cid END AS coupon_id, i.sub AS subtotal
FROM ({ORDER_CREATE_SQL}) x JOIN order_requests q ON q.seq = x.seq
JOIN (SELECT seq, CAST(SUM(CAST(price * quantity AS DECIMAL(22,2))) AS DECIMAL(12,2)) AS sub FROM order_request_items
      GROUP BY seq) i ON i.seq = x.seq WHERE x.reason IS NULL
""")
def order_create_orders(t):
    return _created(t, "orders").select("id", "user_id", "status", "payment_status", "payment_method", "coupon_id", "subtotal")


@register("order_create_items", "G18", money=("price", "total"), sql=f"""
SELECT (SELECT max(id) FROM shop_orders) + x.seq AS order_id, i.product_id,
       CASE WHEN i.variant_id <> 0 THEN i.variant_id END AS variant_id, i.product_name,
       CASE WHEN i.sku <> '' THEN i.sku END AS sku, CAST(i.quantity AS INTEGER) AS quantity, i.price,
       CAST(i.price * i.quantity AS DECIMAL(12,2)) AS total
FROM ({ORDER_CREATE_SQL}) x JOIN order_request_items i ON i.seq = x.seq WHERE x.reason IS NULL
""")
def order_create_items(t):
    """Every written column of the created orders' items."""
    return _created(t, "order_items")


@register("order_create_addresses", "G18", sql=f"""
WITH ok AS (SELECT q.*, (SELECT max(id) FROM shop_orders) + q.seq AS order_id
            FROM ({ORDER_CREATE_SQL}) x JOIN order_requests q ON q.seq = x.seq WHERE x.reason IS NULL)
SELECT order_id, 'shipping' AS type, ship_name AS name, ship_phone AS phone, CASE WHEN ship_email <> '' THEN ship_email END AS email,
       ship_address_line1 AS address_line1, ship_city AS city, ship_state AS state, ship_pincode AS pincode,
       CASE WHEN ship_country <> '' THEN ship_country ELSE 'India' END AS country FROM ok
UNION ALL
SELECT order_id, 'billing', bill_name, bill_phone, CASE WHEN bill_email <> '' THEN bill_email END, bill_address_line1,
       bill_city, bill_state, bill_pincode, CASE WHEN bill_country <> '' THEN bill_country ELSE 'India' END FROM ok
""")
def order_create_addresses(t):
    """Every written column of both addresses."""
    return _created(t, "order_addresses")


@register("coupons_after_order_create", "G18", sql=f"""
WITH k AS (SELECT cid, COUNT(*) AS n FROM ({ORDER_CREATE_SQL}) x
           WHERE reason IS NULL AND cid IS NOT NULL AND seq IN (SELECT seq FROM order_requests
             WHERE coalesce(coupon_code, '') <> '') GROUP BY cid)
SELECT c.id, c.code, CAST(c.used_count + coalesce(k.n, 0) AS INTEGER) AS used_count
FROM coupons c LEFT JOIN k ON k.cid = c.id
""")
def coupons_after_order_create(t):
    c = CO.create_orders(t, t["order_requests"], t["order_request_items"],
                         R.ts_literal(ORDERS_NOW))["coupons"]
    return c.select("id", "code", "used_count")


CANCEL_SQL = f"""
SELECT q.seq, q.order_id, q.user_id,
  CASE WHEN o.user_id IS NULL OR o.user_id <> q.user_id THEN 'not_found'
       WHEN o.created_at < TIMESTAMP '{ORDERS_NOW}' - INTERVAL 3 DAY THEN 'window_expired'
       WHEN o.status NOT IN ('pending', 'confirmed') THEN 'not_cancellable' END AS reason
FROM cancel_requests q LEFT JOIN shop_orders o ON o.id = q.order_id
"""


@register("customer_cancel_outcomes", "G19 F4", sql=f"""
SELECT seq, order_id, user_id, reason IS NULL AS accepted, reason FROM ({CANCEL_SQL}) x
""")
def customer_cancel_outcomes(t):
    return CO.customer_cancel(t, t["cancel_requests"], R.ts_literal(ORDERS_NOW))["outcomes"]


@register("stock_after_customer_cancel", "G19 G23", sql=f"""
WITH d AS (SELECT variant_id, SUM(quantity) AS q FROM order_items
           WHERE order_id IN (SELECT order_id FROM ({CANCEL_SQL}) x WHERE reason IS NULL) GROUP BY variant_id)
SELECT v.id, CAST(v.stock + coalesce(d.q, 0) AS INTEGER) AS stock
FROM product_variants v LEFT JOIN d ON d.variant_id = v.id
""")
def stock_after_customer_cancel(t):
    res = CO.customer_cancel(t, t["cancel_requests"], R.ts_literal(ORDERS_NOW))
    return CO.apply_stock_deltas(t["product_variants"], res["stock_deltas"]).select("id", "stock")


@register("stock_after_customer_cancel_paid_only", "G19 G23", sql=f"""
WITH d AS (SELECT variant_id, SUM(quantity) AS q FROM order_items
           WHERE order_id IN (SELECT x.order_id FROM ({CANCEL_SQL}) x JOIN shop_orders o ON o.id = x.order_id
                              WHERE x.reason IS NULL AND o.payment_status = 'paid') GROUP BY variant_id)
SELECT v.id, CAST(v.stock + coalesce(d.q, 0) AS INTEGER) AS stock
FROM product_variants v LEFT JOIN d ON d.variant_id = v.id
""")
def stock_after_customer_cancel_paid_only(t):
    """G19 restocking paid orders only."""
    res = CO.customer_cancel(t, t["cancel_requests"], R.ts_literal(ORDERS_NOW), restock="paid")
    return CO.apply_stock_deltas(t["product_variants"], res["stock_deltas"]).select("id", "stock")


@register("stock_after_customer_cancel_taken_only", "G19 G23", sql=f"""
WITH d AS (SELECT variant_id, SUM(quantity) AS q FROM order_items
           WHERE order_id IN (SELECT x.order_id FROM ({CANCEL_SQL}) x JOIN shop_orders o ON o.id = x.order_id
                              WHERE x.reason IS NULL AND (o.payment_status = 'paid' OR o.payment_method = 'cod'))
           GROUP BY variant_id)
SELECT v.id, CAST(v.stock + coalesce(d.q, 0) AS INTEGER) AS stock
FROM product_variants v LEFT JOIN d ON d.variant_id = v.id
""")
def stock_after_customer_cancel_taken_only(t):
    """G19 with the corrected restock rule: only orders that took stock."""
    res = CO.customer_cancel(t, t["cancel_requests"], R.ts_literal(ORDERS_NOW), restock="taken")
    return CO.apply_stock_deltas(t["product_variants"], res["stock_deltas"]).select("id", "stock")


@register("stock_after_admin_cancel_taken", "G20 G23", sql="""
WITH d AS (SELECT variant_id, SUM(quantity) AS q FROM order_items WHERE order_id IN (
             SELECT o.id FROM shop_orders o JOIN admin_cancel_requests q ON q.order_id = o.id
             WHERE o.status <> 'cancelled' AND (o.payment_status = 'paid' OR o.payment_method = 'cod')) GROUP BY variant_id)
SELECT v.id, CAST(v.stock + coalesce(d.q, 0) AS INTEGER) AS stock
FROM product_variants v LEFT JOIN d ON d.variant_id = v.id
""")
def stock_after_admin_cancel_taken(t):
    """G20 with the corrected restock rule."""
    res = CO.admin_cancel(t, t["admin_cancel_requests"], _now(), restock_cod=True)
    return CO.apply_stock_deltas(t["product_variants"], res["stock_deltas"]).select("id", "stock")


@register("orders_after_admin_cancel", "G20", sql="""
SELECT o.id, CASE WHEN q.order_id IS NOT NULL THEN 'cancelled' ELSE o.status END AS status,
       CASE WHEN q.order_id IS NOT NULL AND o.status <> 'cancelled' AND o.payment_status = 'paid' THEN 'refunded'
            ELSE o.payment_status END AS payment_status
FROM shop_orders o LEFT JOIN admin_cancel_requests q ON q.order_id = o.id
""")
def orders_after_admin_cancel(t):
    res = CO.admin_cancel(t, t["admin_cancel_requests"], _now())
    return res["orders"].select("id", "status", "payment_status")


@register("stock_after_admin_cancel", "G20 G23", sql="""
WITH d AS (SELECT variant_id, SUM(quantity) AS q FROM order_items WHERE order_id IN (
             SELECT o.id FROM shop_orders o JOIN admin_cancel_requests q ON q.order_id = o.id
             WHERE o.status <> 'cancelled' AND o.payment_status = 'paid') GROUP BY variant_id)
SELECT v.id, CAST(v.stock + coalesce(d.q, 0) AS INTEGER) AS stock
FROM product_variants v LEFT JOIN d ON d.variant_id = v.id
""")
def stock_after_admin_cancel(t):
    res = CO.admin_cancel(t, t["admin_cancel_requests"], _now())
    return CO.apply_stock_deltas(t["product_variants"], res["stock_deltas"]).select("id", "stock")


@register("status_history_after_admin_updates", "G21", sql=f"""
SELECT order_id, status, changed_by, CAST(NULL AS VARCHAR) AS comment, created_at FROM order_status_history
UNION ALL
SELECT q.order_id, q.status, 'admin', CASE WHEN q.comment <> '' THEN q.comment END, TIMESTAMP '{NOW}'
FROM status_requests q JOIN shop_orders o ON o.id = q.order_id
""")
def status_history_after_admin_updates(t):
    res = CO.admin_set_status(t, t["status_requests"], _now())
    h = t["order_status_history"].select("order_id", "status", "changed_by",
                                         F.lit(None).cast("string").alias("comment"), "created_at")
    return h.unionByName(res["status_history"])


@register("stock_after_admin_status", "G21 G23", sql="""
WITH d AS (SELECT variant_id, SUM(quantity) AS q FROM order_items WHERE order_id IN (
             SELECT o.id FROM shop_orders o JOIN status_requests q ON q.order_id = o.id
             WHERE q.status = 'cancelled' AND o.status <> 'cancelled' AND o.payment_status = 'paid')
           GROUP BY variant_id)
SELECT v.id, CAST(v.stock + coalesce(d.q, 0) AS INTEGER) AS stock
FROM product_variants v LEFT JOIN d ON d.variant_id = v.id
""")
def stock_after_admin_status(t):
    res = CO.admin_set_status(t, t["status_requests"], _now())
    return CO.apply_stock_deltas(t["product_variants"], res["stock_deltas"]).select("id", "stock")


@register("payment_update_outcomes", "G22 F5", sql="""
SELECT q.seq, q.order_id,
  CASE WHEN o.id IS NULL THEN 'not_found' WHEN o.payment_status <> 'paid' AND q.payment_status = 'paid'
       THEN 'gateway_only' END IS NULL AS accepted,
  CASE WHEN o.id IS NULL THEN 'not_found' WHEN o.payment_status <> 'paid' AND q.payment_status = 'paid'
       THEN 'gateway_only' END AS reason
FROM payment_requests q LEFT JOIN shop_orders o ON o.id = q.order_id
""")
def payment_update_outcomes(t):
    return CO.admin_set_payment(t, t["payment_requests"], _now())["outcomes"]


@register("stock_ledger", "G23", sql=f"""
WITH d AS (
  SELECT variant_id, -SUM(quantity) AS q FROM order_items
  WHERE order_id IN (SELECT order_id FROM payment_confirmations) GROUP BY variant_id
  UNION ALL
  SELECT variant_id, SUM(quantity) FROM order_items
  WHERE order_id IN (SELECT order_id FROM ({CANCEL_SQL}) x WHERE reason IS NULL) GROUP BY variant_id),
s AS (SELECT variant_id, SUM(q) AS q FROM d GROUP BY variant_id)
SELECT v.id, CAST(v.stock + coalesce(s.q, 0) AS INTEGER) AS stock
FROM product_variants v LEFT JOIN s ON s.variant_id = v.id
""")
def stock_ledger(t):
    """Σ of signed deltas from payment confirmations (G17) and customer
    cancellations (G19) applied in one grouped pass."""
    pay = CO.confirm_payments(t, t["payment_confirmations"])["stock_deltas"]
    can = CO.customer_cancel(t, t["cancel_requests"], R.ts_literal(ORDERS_NOW))["stock_deltas"]
    return CO.apply_stock_deltas(t["product_variants"], pay.unionByName(can)).select("id", "stock")

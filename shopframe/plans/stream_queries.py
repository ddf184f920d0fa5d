"""Streaming queries: each runs its stream over everything
available and reports the final table; the oracle is the batch semantics."""

from __future__ import annotations

from ..streaming import streams as S
from .registry import register_session, tables


def _register_stream(name, ops, sql, fn):
    register_session(name, ops, sql=sql)(fn)


from .change_queries import CART_AFTER_SQL  # noqa: E402

_register_stream("stream_cart_state", "S1 G1 G2 G3", CART_AFTER_SQL,
                 lambda spark, d: S.cart_state_stream(spark, d, tables(spark, d)))

_register_stream("stream_wishlist_state", "S2 G4", """
WITH a AS (SELECT user_id, product_id, COUNT(*) AS n, MAX(event_id) AS last FROM wishlist_events
           GROUP BY user_id, product_id),
j AS (SELECT coalesce(w.user_id, a.user_id) AS user_id, coalesce(w.product_id, a.product_id) AS product_id,
             w.id, coalesce(a.n, 0) AS n, a.last FROM wishlist w FULL OUTER JOIN a
             ON a.user_id = w.user_id AND a.product_id = w.product_id)
SELECT CASE WHEN n = 0 THEN id ELSE (SELECT max(id) FROM wishlist) + last END AS id, user_id, product_id
FROM j WHERE (id IS NOT NULL) <> (n % 2 = 1)
""", lambda spark, d: S.wishlist_state_stream(spark, d, tables(spark, d)))

_register_stream("stream_subscriber_dedup", "S3 G5", """
SELECT lower(email) AS email_key, MIN(id) AS id, arg_min(email, id) AS email,
       arg_min(subscribed_at, id) AS subscribed_at
FROM newsletter_subscribers GROUP BY lower(email)
""", S.subscriber_dedup_stream)

_register_stream("stream_latest_status", "S4 G24", """
SELECT order_id, arg_max(status, (created_at, id)) AS current_status, max(created_at) AS status_at
FROM order_status_history GROUP BY order_id
""", S.latest_status_stream)

_register_stream("stream_valid_cancellations", "S5 F4", """
WITH asked AS (SELECT seq, order_id, user_id, ts FROM cancel_requests
               UNION ALL SELECT seq, order_id, user_id, ts FROM cancel_repeats)
SELECT arg_min(q.seq, (q.ts, q.seq)) AS seq, q.order_id, arg_min(q.user_id, (q.ts, q.seq)) AS user_id, min(q.ts) AS ts,
       any_value(o.created_at) AS created_at
FROM asked q JOIN shop_orders o ON o.id = q.order_id
WHERE q.ts BETWEEN o.created_at AND o.created_at + INTERVAL 3 DAY
  AND o.user_id = q.user_id AND o.status IN ('pending', 'confirmed')
GROUP BY q.order_id
""", S.valid_cancellations_stream)

_register_stream("stream_most_carted", "S6 D6", """
SELECT p.id, p.name, p.image1, CAST(SUM(ci.quantity) AS BIGINT) AS total_added
FROM cart_items ci JOIN product_variants v ON v.id = ci.variant_id JOIN products p ON p.id = v.product_id
GROUP BY p.id, p.name, p.image1 ORDER BY total_added DESC, p.id LIMIT 5
""", lambda spark, d: S.most_carted_stream(spark, d, tables(spark, d)))

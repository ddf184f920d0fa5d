"""Checkout and order lifecycle as batch change operators.

Each operator takes the current tables and a DataFrame of requests and
returns the rows to write (new orders, items, addresses, history rows, stock
deltas, cart keys to clear) plus one outcome per request. Everything is joins
and grouped aggregates keyed by user, order or variant; stock changes are
emitted as signed deltas and applied once by ``apply_stock_deltas`` (a grouped
sum, so a hot variant costs one partial row per map task).

Concurrency: the original serialises writers with row locks. A batch has no
locks: COD checkouts are served exactly first-come-first-served across users
(``contention.serve_in_order``); with ``stock_policy='opening'``, and always at
the gateway, each cart is checked on its own against the stock at the start of
the batch. Several requests for the same user or order are resolved first-come
by ``seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pricing as R
from ..session import materialize
from . import carts as K
from . import coupons as Q
from .changes import _first_per_key, _id_base, _js_truthy
from .contention import serve_in_order
from .paging import number_rows

MONEY = R.MONEY


def _epoch_ms(ts: Column) -> Column:
    """Milliseconds since the epoch of a wall-clock (NTZ) instant."""
    return F.timestamp_diff("MILLISECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), ts)


def apply_stock_deltas(variants: DataFrame, deltas: DataFrame) -> DataFrame:
    """Stock + sum of signed deltas per variant (variants without a
    delta keep their stock)."""
    d = deltas.groupBy("variant_id").agg(F.sum("delta").alias("_d"))
    j = variants.join(d, variants["id"] == d["variant_id"], "left").drop("variant_id")
    return j.withColumn("stock", (F.col("stock") + F.coalesce(F.col("_d"), F.lit(0))).cast("int")).drop("_d")


def _items_of_orders(order_items: DataFrame, orders: DataFrame, sign: int, each: bool = False) -> DataFrame:
    """Stock deltas of the given orders' lines (sign -1 sells, +1 restocks),
    once per order or, with ``each``, once per row of ``orders``."""
    if each:
        n = orders.groupBy("order_id").agg(F.count(F.lit(1)).alias("_times"))
        return order_items.join(n, "order_id").select(
            "variant_id", (F.col("quantity") * F.col("_times") * sign).cast("long").alias("delta"))
    o = orders.select(F.col("order_id")).distinct()
    return (order_items.join(o, "order_id", "left_semi")
            .select("variant_id", (F.col("quantity") * sign).cast("long").alias("delta")))


def _cart_check(lines: DataFrame) -> DataFrame:
    """Per requesting user: cart emptiness, F7 stock check, subtotal."""
    short = F.col("stock") < F.col("quantity")
    return lines.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("_lines"),
        F.bool_and(~short).alias("_stock_ok"),
        F.min_by(F.when(short, F.col("name")), F.when(short, F.col("cart_id"))).alias("_short"),
        F.sum(R.line_total("price", "quantity")).cast(MONEY).alias("subtotal"))


def _given(df: DataFrame, name: str) -> Column:
    """A request's optional text column, null where the batch has none."""
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def _or_null(c: Column) -> Column:
    return F.when(_js_truthy(c), c)


def _resolve_first(requests: DataFrame, key: str) -> DataFrame:
    return _first_per_key(requests, [key])


def checkout(t, requests: DataFrame, now: Column, mode: str = "cod",
             stock_policy: str | None = None) -> dict[str, DataFrame]:
    """G15 (``mode='cod'``) and G16 (``mode='gateway'``).

    ``requests``: (seq, user_id, billing_name, billing_phone, billing_city,
    billing_state, billing_pincode[, billing_email, billing_address,
    coupon_code]). Checks: billing name and
    phone (B24, COD only), non-empty cart, every line within stock (F7).
    Per user, the earliest request that passes billing and cart checks
    meets the stock check; later requests find the cart cleared
    ('cart_empty') when it succeeded, or fail the stock check too.

    ``stock_policy='fcfs'`` (the default of COD) serves the carts in ``seq``
    order against the stock the earlier accepted carts left
    (``serve_in_order``), as the original's row locks do, so no stock
    falls below 0. ``'opening'`` (the default of the gateway, which takes no
    stock) checks each cart on its own against the stock at the start of the
    batch.

    COD: order pending / unpaid, stock -= quantities, cart cleared, history
    'pending' by system. Gateway: coupon quoted under the gateway policy,
    order pending_payment / pending with an order number, no stock change, no
    history, cart kept (cleared on payment, G17), so a user may place several.
    A COD order carries ``total`` and no subtotal, a gateway order the
    opposite. Returns a dict of frames: outcomes,
    orders, order_items, order_addresses, status_history, stock_deltas,
    cleared_carts."""
    stock_policy = stock_policy or ("fcfs" if mode == "cod" else "opening")
    # The requesting users' cart lines feed the checks and the new order
    # items: computed once.
    sku = ("sku",) if "sku" in t["product_variants"].columns else ()
    cart = materialize(K.cart_view(t, requests.select("user_id"), sku))
    chk = _cart_check(cart)
    j = requests.join(chk, "user_id", "left")
    bill_ok = _js_truthy(F.col("billing_name")) & _js_truthy(F.col("billing_phone"))
    billing_bad = (~bill_ok) if mode == "cod" else F.lit(False)
    j = j.withColumn("_reason0", F.when(billing_bad, "invalid_billing")
                     .when(F.coalesce(F.col("_lines"), F.lit(0)) == 0, "cart_empty"))
    if stock_policy == "fcfs":
        passing = materialize(j.where(F.col("_reason0").isNull()).select("seq", "user_id"))
        served = serve_in_order(passing, cart.select("user_id", "cart_id", "variant_id", "quantity", "name", "stock"))
        j = j.join(served.select("seq", F.col("reason").alias("_served")), "seq", "left")
        reason = F.coalesce(F.col("_reason0"), F.col("_served"))
    else:
        # Per user, the earliest request that passes the billing and cart
        # checks meets the stock check (a grouped min, joined back). A gateway
        # order keeps the cart, so each of the user's requests stands.
        eff = j.where(F.col("_reason0").isNull()).groupBy("user_id").agg(F.min("seq").alias("_eff_seq"))
        j = j.join(eff, "user_id", "left")
        later = F.col("seq") > F.col("_eff_seq") if mode == "cod" else F.lit(False)
        reason = (F.when(F.col("_reason0").isNotNull(), F.col("_reason0"))
                  .when(~F.coalesce(F.col("_stock_ok"), F.lit(True)), F.concat(F.lit("Insufficient stock for "), F.col("_short")))
                  .when(later, F.lit("cart_empty")))
    j = j.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    base = _id_base(t["orders"])
    # One row per request: the decisions feed every output frame.
    j = materialize(j.withColumn("order_id", base + F.col("seq")))
    acc = j.where("accepted")

    if mode == "gateway":
        quotes = Q.apply_coupons(
            acc.select(F.col("seq").alias("request_id"), "user_id",
                       F.coalesce(F.col("coupon_code"), F.lit("")).alias("code"), "subtotal"),
            t["coupons"], t["coupon_usages"], now, "gateway")
        acc = acc.join(quotes.select(F.col("request_id").alias("seq"), F.col("coupon_id"),
                                     F.col("accepted").alias("_cpn_ok"), "discount"), "seq", "left")
        has_code = _js_truthy(F.col("coupon_code"))
        # A typed code that is not valid fails the whole order (as the original throws).
        bad_coupon = acc.where(has_code & ~F.col("_cpn_ok")).select("seq")
        acc = materialize(acc.join(bad_coupon, "seq", "left_anti"))
        discount = F.when(has_code, F.col("discount")).otherwise(F.lit(0).cast(MONEY))
        orders = acc.select(
            F.col("order_id").alias("id"),
            F.concat(F.lit("ORD-"), _epoch_ms(now).cast("string"),
                     F.lit("-"), F.col("seq").cast("string")).alias("order_number"),
            "user_id", F.lit("pending_payment").alias("status"), F.lit("pending").alias("payment_status"),
            F.lit("razorpay").alias("payment_method"),
            F.when(has_code, F.col("coupon_id")).alias("coupon_id"),
            F.when(has_code, F.col("coupon_code")).alias("coupon_code"),
            F.lit(None).cast(MONEY).alias("total"),
            F.col("subtotal").cast(MONEY).alias("subtotal"), discount.cast(MONEY).alias("discount"),
            R.grand_total(F.col("subtotal"), discount).alias("grand_total"), now.alias("created_at"))
        outcomes = (j.join(bad_coupon.withColumn("_bad", F.lit(True)), "seq", "left")
                    .withColumn("reason", F.when(F.col("_bad").isNotNull(), F.lit("invalid_coupon"))
                                .otherwise(F.col("reason")))
                    .withColumn("accepted", F.col("reason").isNull()))
    else:
        orders = acc.select(
            F.col("order_id").alias("id"), F.lit(None).cast("string").alias("order_number"), "user_id",
            F.lit("pending").alias("status"), F.lit("unpaid").alias("payment_status"),
            F.lit("cod").alias("payment_method"), F.lit(None).cast("int").alias("coupon_id"),
            F.lit(None).cast("string").alias("coupon_code"), F.col("subtotal").cast(MONEY).alias("total"),
            F.lit(None).cast(MONEY).alias("subtotal"), F.lit(None).cast(MONEY).alias("discount"), F.col("subtotal").cast(MONEY).alias("grand_total"),
            now.alias("created_at"))
        outcomes = j
    ok_users = orders.select("user_id", F.col("id").alias("order_id"))
    lines = cart.join(ok_users, "user_id")
    # A gateway order's items freeze the SKU as well.
    items = lines.select("order_id", "product_id", "variant_id", F.col("name").alias("product_name"),
                         (_given(cart, "sku") if mode == "gateway" else F.lit(None).cast("string")).alias("sku"),
                         "quantity", F.col("price").cast(MONEY).alias("price"), "is_gift")
    addresses = acc.join(orders.select(F.col("id").alias("order_id")), "order_id", "left_semi").select(
        "order_id", F.lit("billing").alias("type"), F.col("billing_name").alias("name"),
        F.col("billing_phone").alias("phone"), _given(requests, "billing_email").alias("email"),
        _given(requests, "billing_address").alias("address_line1"), F.col("billing_city").alias("city"),
        F.col("billing_state").alias("state"), F.col("billing_pincode").alias("pincode"),
        F.lit("India").alias("country"))
    history = orders.select(F.col("id").alias("order_id"), F.col("status"),
                            F.lit("system").alias("changed_by"), now.alias("created_at"))
    if mode != "cod":
        history = history.where(F.lit(False))
    if mode == "cod":
        deltas = items.select("variant_id", (-F.col("quantity")).cast("long").alias("delta"))
        cleared = ok_users.select("user_id")
    else:
        deltas = items.select("variant_id", F.lit(0).cast("long").alias("delta")).where(F.lit(False))
        cleared = ok_users.select("user_id").where(F.lit(False))
    return {
        "outcomes": outcomes.select("seq", "user_id", "accepted", "reason"),
        "orders": orders, "order_items": items, "order_addresses": addresses,
        "status_history": history, "stock_deltas": deltas, "cleared_carts": cleared,
    }


def commit_checkout(tables, requests: DataFrame, now: Column, mode: str = "cod") -> DataFrame:
    """G15/G16 on a ``sources.tableset.TableSet``: orders, items, addresses,
    history, stock and cart change together, or not at all. Needs the tables
    that ``checkout`` reads and writes; returns the outcomes."""
    at = tables.manifest()
    t = tables.load(at)
    res = checkout(t, requests, now, mode)
    outcomes = materialize(res["outcomes"])
    first = _id_base(t["order_status_history"])
    history = res["status_history"].withColumn("id", first + F.col("order_id")).withColumn("comment", F.lit(None).cast("string"))

    def like(name):
        """The rows for a stored table, in its columns; absent ones are null."""
        rows = history if name == "order_status_history" else res[name]
        return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                             for f in t[name].schema.fields])
    append = {n: like(n) for n in ("orders", "order_items", "order_addresses", "order_status_history") if n in t}
    replace = {}
    if mode == "cod":
        replace["product_variants"] = apply_stock_deltas(t["product_variants"], res["stock_deltas"]).select(
            *t["product_variants"].columns)
        replace["cart_items"] = t["cart_items"].join(res["cleared_carts"], "user_id", "left_anti").select(*t["cart_items"].columns)
    tables.commit(replace, append, at["version"])
    return outcomes


def confirm_payments(t, payments: DataFrame) -> dict[str, DataFrame]:
    """Verified gateway payments (order_id, user_id, payment_id): order
    -> paid / confirmed, stock -= the order's quantities, the payer's cart
    cleared. Unknown orders are rejected ('not_found')."""
    o = t["orders"].select(F.col("id").alias("order_id"))
    p = payments.join(o.withColumn("_ok", F.lit(True)), "order_id", "left")
    outcomes = p.select("order_id", "user_id", F.col("_ok").isNotNull().alias("accepted"))
    ok = p.where(F.col("_ok").isNotNull()).select("order_id", "user_id", "payment_id").distinct()
    upd = ok.groupBy("order_id").agg(F.max("payment_id").alias("payment_id"), F.lit(True).alias("_paid"))
    orders = (t["orders"].join(upd, t["orders"]["id"] == upd["order_id"], "left").drop("order_id")
              .withColumn("payment_status", F.when(F.col("_paid").isNotNull(), F.lit("paid"))
                          .otherwise(F.col("payment_status")))
              .withColumn("status", F.when(F.col("_paid").isNotNull(), F.lit("confirmed"))
                          .otherwise(F.col("status"))).drop("_paid"))
    deltas = _items_of_orders(t["order_items"], upd, -1)
    return {"outcomes": outcomes, "orders": orders, "stock_deltas": deltas,
            "cleared_carts": ok.select("user_id").distinct()}


def _order_state(t, requests: DataFrame) -> DataFrame:
    """First request per order joined to the order's current state."""
    o = t["orders"].select(F.col("id").alias("order_id"), F.col("user_id").alias("_owner"),
                           F.col("status").alias("_status"), F.col("payment_status").alias("_pay"),
                           F.col("payment_method").alias("_method"), F.col("created_at").alias("_created"))
    return _resolve_first(requests, "order_id").join(o, "order_id", "left")


def _took_stock() -> Column:
    """Whether an order's stock was taken: when it was paid, or placed COD."""
    return F.coalesce((F.col("_pay") == "paid") | (F.col("_method") == "cod"), F.lit(False))


def _apply_order_updates(orders: DataFrame, upd: DataFrame) -> DataFrame:
    """Overwrite status / payment_status of the orders named in ``upd``
    (order_id, new_status, new_payment_status; NULL = unchanged)."""
    j = orders.join(upd, orders["id"] == upd["order_id"], "left").drop("order_id")
    return (j.withColumn("status", F.coalesce("new_status", "status"))
            .withColumn("payment_status", F.coalesce("new_payment_status", "payment_status"))
            .drop("new_status", "new_payment_status"))


def customer_cancel(t, requests: DataFrame, now: Column, restock: str = "all") -> dict:
    """Customer cancellations (seq, order_id, user_id): the order must be
    the user's ('not_found'), at most 3.0 days old ('window_expired') and
    pending or confirmed ('not_cancellable'). Accepted: status cancelled,
    history row by 'user', every line restocked; the original restocks even
    orders whose stock was never taken (order-create path, unpaid gateway
    orders). ``restock='taken'`` restocks only orders that took stock (paid, or
    COD), ``'paid'`` only paid ones."""
    s = _order_state(t, requests)
    reason = (F.when(F.col("_owner").isNull() | (F.col("_owner") != F.col("user_id")), "not_found")
              .when(F.col("_created") < now - F.expr(f"INTERVAL {R.CANCEL_WINDOW_DAYS} DAYS"), "window_expired")
              .when(~F.col("_status").isin(*R.CANCELLABLE_STATUSES), "not_cancellable"))
    # The first request that holds cancels; the order is cancelled for later ones.
    holds = s.where(reason.isNull()).groupBy("order_id").agg(F.min("seq").alias("_first_ok"))
    s = s.join(holds, "order_id", "left")
    reason = F.coalesce(reason, F.when(F.col("seq") > F.col("_first_ok"), "not_cancellable"))
    s = s.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    acc = s.where("accepted")
    upd = acc.select("order_id", F.lit("cancelled").alias("new_status"),
                     F.lit(None).cast("string").alias("new_payment_status"))
    returned = {"all": acc, "taken": acc.where(_took_stock()), "paid": acc.where(F.col("_pay") == "paid")}[restock]
    return {
        "outcomes": s.select("seq", "order_id", "user_id", "accepted", "reason"),
        "orders": _apply_order_updates(t["orders"], upd),
        "status_history": acc.select("order_id", F.lit("cancelled").alias("status"),
                                     F.lit("user").alias("changed_by"), now.alias("created_at")),
        "stock_deltas": _items_of_orders(t["order_items"], returned, +1),
    }


def admin_cancel(t, requests: DataFrame, now: Column, restock_cod: bool = False) -> dict:
    """Admin cancellations (seq, order_id). Already cancelled -> success
    without change (idempotent); restock only when paid, as the original, or
    with ``restock_cod`` also when placed COD, whose stock was taken at
    checkout; paid -> refunded; history 'Cancelled by admin'. Unknown order ->
    'not_found'."""
    s = _order_state(t, requests)
    reason = F.when(F.col("_status").isNull(), "not_found")
    s = s.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    act = s.where(F.col("accepted") & F.col("_is_first") & (F.col("_status") != "cancelled"))
    upd = act.select("order_id", F.lit("cancelled").alias("new_status"),
                     F.when(F.col("_pay") == "paid", F.lit("refunded")).alias("new_payment_status"))
    return {
        "outcomes": s.select("seq", "order_id", "accepted", "reason"),
        "orders": _apply_order_updates(t["orders"], upd),
        "status_history": act.select("order_id", F.lit("cancelled").alias("status"),
                                     F.lit("admin").alias("changed_by"),
                                     F.lit("Cancelled by admin").alias("comment"), now.alias("created_at")),
        "stock_deltas": _items_of_orders(
            t["order_items"], act.where(_took_stock() if restock_cod else F.col("_pay") == "paid"), +1),
    }


def admin_set_status(t, requests: DataFrame, now: Column) -> dict:
    """Admin status changes (seq, order_id, status, comment), applied in
    ``seq`` order: the last one stands and each writes a history row. Every
    move of a paid order from another status to 'cancelled' restocks it
    (payment status untouched)."""
    s = _order_state(t, requests)
    reason = F.when(F.col("_status").isNull(), "not_found")
    s = s.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    acc = s.where("accepted")
    w = Window.partitionBy("order_id").orderBy("seq")
    acc = acc.withColumn("_before", F.coalesce(F.lag("status").over(w), F.col("_status")))
    upd = acc.groupBy("order_id").agg(F.max_by("status", "seq").alias("new_status")).select(
        "order_id", "new_status", F.lit(None).cast("string").alias("new_payment_status"))
    restock = acc.where((F.col("status") == "cancelled") & (F.col("_before") != "cancelled")
                        & (F.col("_pay") == "paid"))
    return {
        "outcomes": s.select("seq", "order_id", "accepted", "reason"),
        "orders": _apply_order_updates(t["orders"], upd),
        "status_history": acc.select("order_id", "status", F.lit("admin").alias("changed_by"),
                                     F.when(_js_truthy(F.col("comment")), F.col("comment")).alias("comment"),
                                     now.alias("created_at")),
        "stock_deltas": _items_of_orders(t["order_items"], restock, +1, each=True),
    }


def admin_set_payment(t, requests: DataFrame, now: Column) -> dict:
    """Admin payment-status changes (seq, order_id, payment_status,
    comment), applied in ``seq`` order: 'paid' only while the order is paid
    ('gateway_only'), any other at any time. Accepted ones append a
    payment-history row and the last of them stands."""
    s = _order_state(t, requests).withColumnRenamed("payment_status", "new_payment_status")
    # Any other status leaves 'paid' for good within the batch.
    left = (s.where((F.col("new_payment_status") != "paid") & F.col("_status").isNotNull())
            .groupBy("order_id").agg(F.min("seq").alias("_left_paid")))
    s = s.join(left, "order_id", "left")
    now_paid = F.when(F.coalesce(F.col("seq") > F.col("_left_paid"), F.lit(False)), F.lit("other")).otherwise(F.col("_pay"))
    s = s.withColumn("_now", now_paid)
    allowed = R.payment_change_allowed("_now", "new_payment_status")
    reason = (F.when(F.col("_status").isNull(), "not_found")
              .when(~allowed, "gateway_only"))
    s = s.withColumn("reason", reason).withColumn("accepted", F.col("reason").isNull())
    acc = s.where("accepted")
    upd = acc.groupBy("order_id").agg(F.max_by("new_payment_status", "seq").alias("new_payment_status")).select(
        "order_id", F.lit(None).cast("string").alias("new_status"), "new_payment_status")
    return {
        "outcomes": s.select("seq", "order_id", "accepted", "reason"),
        "orders": _apply_order_updates(t["orders"], upd),
        "payment_history": acc.select("order_id", F.col("new_payment_status").alias("payment_status"),
                                      F.lit("admin").alias("changed_by"),
                                      F.when(_js_truthy(F.col("comment")), F.col("comment")).alias("comment"),
                                      now.alias("created_at")),
    }


def create_orders(t, requests: DataFrame, items: DataFrame, now: Column) -> dict:
    """API order creation with submitted items and a coupon lock.

    ``requests``: (seq, user_id, coupon_code, ship_name, ship_phone,
    ship_pincode, bill_name, bill_phone, bill_pincode[, payment_method, and per
    address email, address_line1, city, state, country]); ``items``: (seq,
    product_id, variant_id, price, quantity[, product_name, sku]). An address
    without a country is in India. B23: at least one item, every
    price present and quantity > 0 ('invalid_items'); both addresses need
    name, phone and pincode ('invalid_address'); the coupon is quoted under
    the 'order' policy ('invalid_coupon' / 'already_used' / 'min_order').
    A user's later orders with a coupon that an earlier one of the batch used
    are 'already_used', and usage limits hold across the batch: the first
    orders of each user with a limited coupon are ranked by seq and only the
    first ``usage_limit - used_count`` keep it ('usage_limit'). Accepted
    orders: pending / unpaid, the request's payment method ('razorpay' where
    it names none), one usage row each,
    used_count + n per coupon, two addresses, history; no stock change."""
    agg = items.groupBy("seq").agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_and(F.col("price").isNotNull() & (F.col("quantity") > 0)).alias("_items_ok"),
        F.sum((F.col("price") * F.col("quantity")).cast("decimal(22,2)")).alias("_sub"))
    r = requests.join(agg, "seq", "left")
    addr_ok = (_js_truthy(F.col("ship_name")) & _js_truthy(F.col("ship_phone")) & _js_truthy(F.col("ship_pincode"))
               & _js_truthy(F.col("bill_name")) & _js_truthy(F.col("bill_phone"))
               & _js_truthy(F.col("bill_pincode")))
    has_code = _js_truthy(F.col("coupon_code"))
    quotes = Q.apply_coupons(
        r.select(F.col("seq").alias("request_id"), "user_id",
                 F.coalesce("coupon_code", F.lit("")).alias("code"),
                 F.coalesce("_sub", F.lit(0)).cast(MONEY).alias("subtotal")),
        t["coupons"], t["coupon_usages"], now, "order")
    r = r.join(quotes.select(F.col("request_id").alias("seq"), F.col("coupon_id").alias("_cid"),
                             F.col("reason").alias("_creason"), F.col("discount").alias("_disc")), "seq", "left")
    reason0 = (F.when(F.coalesce(F.col("_n"), F.lit(0)) == 0, "invalid_items")
               .when(~F.col("_items_ok"), "invalid_items")
               .when(has_code & F.col("_creason").isNotNull(), F.col("_creason"))
               .when(~addr_ok, "invalid_address"))
    r = r.withColumn("_reason0", reason0)
    # Coupon lock across the batch: the first otherwise-valid order of each
    # (coupon, user) is ranked where the coupon has a limit. A popular coupon
    # may carry a large share of the orders: the rank uses the skew-safe
    # numbering (range partitions + offsets), not a one-task window.
    c = t["coupons"].select(F.col("id").alias("_cid"), "usage_limit", "used_count")
    cand = r.where(F.col("_reason0").isNull() & has_code)
    firsts = materialize(cand.groupBy("_cid", "user_id").agg(F.min("seq").alias("_first_use")).join(c, "_cid"))
    limited = firsts.where(F.col("usage_limit").isNotNull()).select(F.col("_first_use").alias("seq"), "_cid", "usage_limit",
                                                                    "used_count")
    over = (number_rows(limited, [F.col("seq").asc()], ["_cid"])
            .where(F.col("position") > F.col("usage_limit") - F.col("used_count"))
            .select(F.col("seq").alias("_first_use"), F.lit(True).alias("_over")))
    uses = firsts.select("_cid", "user_id", "_first_use").join(over, "_first_use", "left")
    r = r.join(uses, ["_cid", "user_id"], "left")
    locked = F.when(has_code & F.coalesce(F.col("_over"), F.lit(False)), "usage_limit").when(
        has_code & (F.col("seq") > F.col("_first_use")), "already_used")
    r = materialize(r.withColumn("reason", F.coalesce(F.col("_reason0"), locked))
                    .withColumn("accepted", F.col("reason").isNull()))
    method = F.coalesce(F.col("payment_method"), F.lit("razorpay")) if "payment_method" in requests.columns \
        else F.lit("razorpay")
    base = _id_base(t["orders"])
    acc = r.where("accepted").withColumn("order_id", base + F.col("seq"))
    disc = F.when(has_code, F.col("_disc")).otherwise(F.lit(0).cast(MONEY))
    orders = acc.select(
        F.col("order_id").alias("id"),
        F.concat(F.lit("ORD-"), _epoch_ms(now).cast("string"),
                 F.lit("-"), F.col("seq").cast("string")).alias("order_number"),
        "user_id", F.lit("pending").alias("status"), F.lit("unpaid").alias("payment_status"),
        method.alias("payment_method"), F.when(has_code, F.col("_cid")).alias("coupon_id"),
        F.when(has_code, F.col("coupon_code")).alias("coupon_code"),
        F.col("_sub").cast(MONEY).alias("subtotal"), disc.cast(MONEY).alias("discount"),
        R.grand_total(F.col("_sub"), disc).alias("grand_total"), now.alias("created_at"))
    used = acc.where(has_code).select(F.col("_cid").alias("coupon_id"), "user_id", "order_id")
    per_coupon = used.groupBy("coupon_id").agg(F.count(F.lit(1)).alias("_k"))
    coupons = (t["coupons"].join(per_coupon, t["coupons"]["id"] == per_coupon["coupon_id"], "left")
               .drop("coupon_id")
               .withColumn("used_count", (F.col("used_count") + F.coalesce(F.col("_k"), F.lit(0))).cast("int"))
               .drop("_k"))
    lines = items.join(acc.select("seq", "order_id"), "seq").select(
        "order_id", "product_id", F.when(F.col("variant_id") != 0, F.col("variant_id")).alias("variant_id"),
        _given(items, "product_name").alias("product_name"), _or_null(_given(items, "sku")).alias("sku"),
        F.col("quantity").cast("int").alias("quantity"), F.col("price").cast(MONEY).alias("price"),
        R.line_total("price", "quantity").alias("total"))

    def address(kind, prefix):
        def given(name):
            return _given(requests, f"{prefix}_{name}")
        return acc.select(
            "order_id", F.lit(kind).alias("type"), *[given(c).alias(c) for c in ("name", "phone")],
            _or_null(given("email")).alias("email"),
            *[given(c).alias(c) for c in ("address_line1", "city", "state", "pincode")],
            F.coalesce(_or_null(given("country")), F.lit("India")).alias("country"))

    addrs = address("shipping", "ship").unionByName(address("billing", "bill"))
    return {
        "outcomes": r.select("seq", "user_id", "accepted", "reason"),
        "orders": orders, "order_items": lines, "order_addresses": addrs, "coupon_usages": used,
        "coupons": coupons,
        "status_history": acc.select("order_id", F.lit("pending").alias("status"),
                                     F.lit("user").alias("changed_by"), now.alias("created_at")),
    }

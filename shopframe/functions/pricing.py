"""Pricing and lifecycle rules as Column expressions.

Money is DECIMAL throughout (the original does money math on doubles); a
percentage is applied as ``amount * value * 0.01`` and rounded half-up to two
places when the quote is made.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

POLICIES = ("live", "strict", "order", "gateway")
# Caps the original applies when a percent coupon has no cap.
GATEWAY_DEFAULT_CAP = 999999
CANCEL_WINDOW_DAYS = 3
CANCELLABLE_STATUSES = ("pending", "confirmed")
MONEY = "decimal(12,2)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ts_literal(ts: str) -> Column:
    """A wall-clock instant as TIMESTAMP_NTZ (the storefront's time type)."""
    return F.to_timestamp_ntz(F.lit(ts))


def coupon_valid(policy: str, now: Column, prefix: str = "") -> Column:
    """Is the coupon row usable at ``now`` under ``policy``.

    live: active only. strict: active and ``now BETWEEN start AND end`` (a NULL
    bound makes it invalid). order: active, NULL bounds open, usage_limit
    checked. gateway: active and usage_limit checked, dates ignored."""
    c = lambda n: F.col(prefix + n)
    active = c("active") == 1
    under_limit = c("usage_limit").isNull() | (c("used_count") < c("usage_limit"))
    if policy == "live":
        cond = active
    elif policy == "strict":
        cond = active & now.between(c("start_date"), c("end_date"))
    elif policy == "order":
        cond = (active & (c("start_date").isNull() | (c("start_date") <= now))
                & (c("end_date").isNull() | (c("end_date") >= now)) & under_limit)
    elif policy == "gateway":
        cond = active & under_limit
    else:
        raise ValueError(f"unknown coupon policy {policy!r}")
    return F.coalesce(cond, F.lit(False))


def _truthy(col: Column) -> Column:
    """A JS-truthy cap: non-NULL and non-zero (a 0 cap counts as none)."""
    return col.isNotNull() & (col != 0)


def coupon_discount(policy: str, subtotal: Column, prefix: str = "") -> Column:
    """discount amount of a (valid) coupon on ``subtotal``."""
    c = lambda n: F.col(prefix + n)
    pct = F.round(subtotal * c("value") * F.lit(0.01).cast("decimal(3,2)"), 2)
    cap = c("max_discount")
    is_pct = c("type") == "percent"
    if policy in ("live", "strict", "order"):
        pct_disc = F.when(_truthy(cap), F.least(pct, cap)).otherwise(pct)
    else:  # gateway: missing cap becomes 999999
        pct_disc = F.least(pct, F.when(_truthy(cap), cap).otherwise(F.lit(GATEWAY_DEFAULT_CAP)))
    flat = c("value")
    if policy == "live":  # the live route caps flat coupons too
        flat = F.when(_truthy(cap), F.least(flat, cap)).otherwise(flat)
    return F.when(is_pct, pct_disc).otherwise(flat).cast(MONEY)


def final_amount(policy: str, subtotal: Column, discount: Column) -> Column:
    """subtotal - discount, clamped at 0 except in the live policy."""
    raw = (subtotal - discount).cast(MONEY)
    return raw if policy == "live" else F.greatest(raw, F.lit(0).cast(MONEY))


def min_order_ok(policy: str, subtotal: Column, prefix: str = "") -> Column:
    """minimum-order rule (NULL minimum = 0; the gateway has none)."""
    if policy == "gateway":
        return F.lit(True)
    return subtotal >= F.coalesce(F.col(prefix + "min_order"), F.lit(0))


def grand_total(subtotal="subtotal", discount="discount") -> Column:
    """max(subtotal - discount, 0)."""
    return F.greatest((_c(subtotal) - _c(discount)).cast(MONEY), F.lit(0).cast(MONEY))


def gateway_amount(total="grand_total") -> Column:
    """amount in the smallest currency unit, round(total * 100)."""
    return F.round(_c(total) * 100, 0).cast("bigint")


def can_cancel(now: Column, created="created_at", status="status") -> Column:
    """customer may cancel within 3.0 days (inclusive) of ordering while
    the order is pending or confirmed."""
    within = _c(created) >= now - F.expr(f"INTERVAL {CANCEL_WINDOW_DAYS} DAYS")
    return F.coalesce(within & _c(status).isin(*CANCELLABLE_STATUSES), F.lit(False))


def payment_change_allowed(current="payment_status", requested="new_payment_status") -> Column:
    """an admin may not set 'paid' unless the order is already paid."""
    return F.coalesce((_c(requested) != "paid") | (_c(current) == "paid"), F.lit(False))


def status_editable(payment="payment_status") -> Column:
    """order status is editable only once the order is paid."""
    return F.coalesce(_c(payment) == "paid", F.lit(False))


def line_total(price="price", qty="quantity") -> Column:
    """Price * quantity."""
    return (_c(price) * _c(qty)).cast("decimal(22,2)")

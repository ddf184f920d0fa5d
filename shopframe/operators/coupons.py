"""Coupons: availability (C10/C11) and quotes under four policies (F1).

Requests are DataFrames, so all checkouts of a batch are quoted in one job:
requests ⋈ coupons on the case-insensitive code (an equi join; the coupon
table is a dimension table) and ⋈ the user's usage rows on
(user_id, coupon_id). Usage rows are reduced to distinct pairs and to a
per-user "has a NULL coupon id" flag first (partial aggregation), so a user
with very many usages is one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pricing as R

REASON_INVALID = "invalid_coupon"
REASON_USED = "already_used"
REASON_MIN_ORDER = "min_order"
REASON_BAD_REQUEST = "invalid_request"


def _usage_pairs(usages: DataFrame) -> DataFrame:
    return (usages.where(F.col("coupon_id").isNotNull())
            .select("user_id", "coupon_id").distinct().withColumn("_used", F.lit(True)))


def _null_usage_users(usages: DataFrame) -> DataFrame:
    return (usages.groupBy("user_id")
            .agg(F.bool_or(F.col("coupon_id").isNull()).alias("_has_null_usage")))


def coupon_availability(requests: DataFrame, coupons: DataFrame, usages: DataFrame,
                        now: Column, policy: str = "live") -> DataFrame:
    """Is coupon ``coupon_id`` listed as available to ``user_id``.

    ``requests``: (user_id, coupon_id) pairs to evaluate (a user's listing is
    that user paired with each coupon id). ``policy='live'`` is the mounted
    route: active, NULL-open dates, and ``id NOT IN (the user's usage
    coupon ids)`` with SQL's null-aware rule: one NULL coupon id among the
    user's usages hides every coupon. ``policy='strict'``: active, ``now
    BETWEEN start AND end`` (NULL bound = not available), under the usage
    limit, and NOT EXISTS a usage row of that coupon and user.
    """
    c = coupons.select(F.col("id").alias("coupon_id"), "active", "start_date", "end_date",
                       "usage_limit", "used_count", F.col("code"))
    if policy == "live":
        valid = (c["active"] == 1) & (c["start_date"].isNull() | (c["start_date"] <= now)) & \
                (c["end_date"].isNull() | (c["end_date"] >= now))
    elif policy == "strict":
        valid = R.coupon_valid("strict", now) & \
                (F.col("usage_limit").isNull() | (F.col("used_count") < F.col("usage_limit")))
    else:
        raise ValueError(policy)
    r = requests.select("user_id", "coupon_id")
    j = (r.join(c, "coupon_id", "left")
         .join(_usage_pairs(usages), ["user_id", "coupon_id"], "left")
         .join(_null_usage_users(usages), "user_id", "left"))
    not_used = F.col("_used").isNull()
    if policy == "live":
        not_used = not_used & ~F.coalesce(F.col("_has_null_usage"), F.lit(False))
    return j.select("user_id", "coupon_id", "code",
                    F.coalesce(valid & not_used, F.lit(False)).alias("available"))


def apply_coupons(requests: DataFrame, coupons: DataFrame, usages: DataFrame, now: Column,
                  policy: str = "live") -> DataFrame:
    """quote every request (request_id, user_id, code, subtotal).

    The coupon is looked up by case-insensitive code among coupons valid
    under ``policy`` (lowest id if a code repeats). Output per request:
    coupon_id, accepted, reason, discount (0 when rejected) and final_amount
    (the subtotal when rejected). Policy differences are in
    ``shopframe.functions.pricing``."""
    valid = coupons.where(R.coupon_valid(policy, now))
    # The lowest-id valid coupon per code: a grouped min_by, no window.
    first = (valid.groupBy(F.lower("code").alias("_code"))
             .agg(F.min_by(F.struct(F.col("id").alias("coupon_id"), "type", "value", "min_order",
                                    "max_discount"), F.col("id")).alias("_c"))
             .select("_code", "_c.*"))
    req = requests.withColumn("_code", F.lower(F.trim("code")))
    j = req.join(first, "_code", "left")
    if policy in ("strict", "order"):
        j = j.join(_usage_pairs(usages), ["user_id", "coupon_id"], "left")
        used = F.coalesce(F.col("_used"), F.lit(False))
    else:
        used = F.lit(False)
    sub = F.col("subtotal")
    if policy == "strict":
        bad_request = F.col("code").isNull() | (F.col("code") == "") | sub.isNull() | (sub == 0)
    else:
        bad_request = F.lit(False)
    reason = (F.when(bad_request, REASON_BAD_REQUEST)
              .when(F.col("coupon_id").isNull(), REASON_INVALID)
              .when(used, REASON_USED)
              .when(~R.min_order_ok(policy, sub), REASON_MIN_ORDER))
    disc = R.coupon_discount(policy, sub)
    zero = F.lit(0).cast(R.MONEY)
    return (j.withColumn("reason", reason)
            .withColumn("accepted", F.col("reason").isNull())
            .withColumn("discount", F.when(F.col("accepted"), disc).otherwise(zero))
            .withColumn("final_amount",
                        F.when(F.col("accepted"), R.final_amount(policy, sub, F.col("discount")))
                        .otherwise(sub.cast(R.MONEY)))
            .select("request_id", "user_id", F.col("code"),
                    F.when(F.col("accepted"), F.col("coupon_id")).alias("coupon_id"),
                    "accepted", "reason", "discount", "final_amount"))

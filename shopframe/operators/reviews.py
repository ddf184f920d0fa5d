"""Reviews: product review lists, admin list, eligibility, statistics and
sorting (C7, C8, C12, C13, C19, D13, E7, E8, B17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T

NO_REVIEWS = "No reviews yet"


def product_reviews(t) -> DataFrame:
    """Reviews with their author (inner join: a review of a
    deleted user vanishes), date text, reviewer display name and stars."""
    r = t["reviews"]
    u = t["users"].select(F.col("id").alias("_uid"), "first_name", "last_name", "email")
    return (r.join(u, r["user_id"] == u["_uid"], "inner").drop("_uid")
            .select("id", "user_id", "product_id", "title", "comment", "rating", "created_at",
                    T.date_text("created_at").alias("created_at_formatted"),
                    "first_name", "last_name", "email",
                    T.reviewer_name().alias("user_name"), T.stars("rating").alias("stars")))


def admin_reviews(t) -> DataFrame:
    """Every review with its product (left join); ``product_id`` is the
    joined product's id, so it is NULL for a deleted product, whose name
    displays as 'Deleted'."""
    r = t["reviews"]
    p = t["products"].select(F.col("id").alias("_pid"), F.col("name").alias("product_name"))
    j = r.join(p, r["product_id"] == p["_pid"], "left")
    cols = [c for c in r.columns if c != "product_id"]
    return j.select(*cols, F.col("_pid").alias("product_id"), "product_name",
                    F.coalesce("product_name", F.lit("Deleted")).alias("product_label"))


def paid_purchases(t) -> DataFrame:
    """Distinct (user_id, product_id) pairs bought in a paid order."""
    o = t["orders"].where(F.col("payment_status") == "paid").select(F.col("id").alias("order_id"), "user_id")
    oi = t["order_items"].select("order_id", "product_id")
    return o.join(oi, "order_id", "inner").select("user_id", "product_id").distinct()


def can_review(t, requests: DataFrame) -> DataFrame:
    """For (user_id, product_id) requests: bought in a paid order
    (else reason 'purchase'), and not reviewed yet (else 'already_reviewed')."""
    bought = paid_purchases(t).withColumn("_bought", F.lit(True))
    reviewed = (t["reviews"].select("user_id", "product_id").distinct()
                .withColumn("_reviewed", F.lit(True)))
    j = (requests.join(bought, ["user_id", "product_id"], "left")
         .join(reviewed, ["user_id", "product_id"], "left"))
    reason = (F.when(F.col("_bought").isNull(), "purchase")
              .when(F.col("_reviewed").isNotNull(), "already_reviewed"))
    return (j.withColumn("reason", reason)
            .withColumn("can_review", F.col("reason").isNull())
            .drop("_bought", "_reviewed"))


def owned_reviews(t, requests: DataFrame) -> DataFrame:
    """The requests (review_id, user_id) that name a review of that user."""
    r = t["reviews"].select(F.col("id").alias("review_id"), "user_id")
    return requests.join(r, ["review_id", "user_id"], "left_semi")


def review_stats(t) -> DataFrame:
    """Per product: review count, average to one decimal (half-up,
    computed from integers), rounded stars (JS Math.round) and the summary
    text; a product without reviews says 'No reviews yet' and shows five
    full stars."""
    agg = t["reviews"].groupBy("product_id").agg(
        F.count(F.lit(1)).alias("total"), F.sum("rating").cast("bigint").alias("_sum"))
    p = t["products"].select(F.col("id").alias("product_id"))
    j = p.join(agg, "product_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    n, s = F.col("total"), F.col("_sum")
    avg10 = F.floor((s * 20 + n) / (n * 2))  # round(10 * s / n) half-up
    avg = (avg10 / 10).cast("decimal(4,1)")
    rounded = F.floor((s * 2 + n) / (n * 2)).cast("int")
    text = F.concat(avg.cast("string"), F.lit(" / 5 · "), n.cast("string"),
                    F.lit(" review"), F.when(n > 1, F.lit("s")).otherwise(F.lit("")))
    return j.select(
        "product_id", "total",
        F.when(n > 0, avg).alias("average"),
        F.when(n > 0, rounded).alias("rounded_stars"),
        F.when(n > 0, T.stars(rounded)).otherwise(F.lit(T.STAR_FULL * 5)).alias("stars"),
        F.when(n > 0, text).otherwise(F.lit(NO_REVIEWS)).alias("summary"))


def sort_reviews(df: DataFrame, mode: str = "rating_desc") -> DataFrame:
    """E7 (product page) and E8 (admin): rating_desc (default) / rating_asc /
    newest / oldest; admin names latest / oldest (``admin_oldest`` here), by
    id, and high / low. The review id (newest first) breaks ties so the order
    is total."""
    m = {"high": "rating_desc", "low": "rating_asc"}.get(mode, mode)
    keys = {
        "rating_desc": [F.col("rating").desc()],
        "rating_asc": [F.col("rating").asc()],
        "newest": [F.col("created_at").desc()],
        "oldest": [F.col("created_at").asc()],
        "latest": [F.col("id").desc()],
        "admin_oldest": [F.col("id").asc()],
    }[m]
    return df.orderBy(*keys, F.col("id").desc())


def search_reviews(df: DataFrame, q: str | None = None, rating: int | None = None) -> DataFrame:
    """Admin review search over product name and comment (the reviewer
    name is never loaded by the admin list), plus rating equality."""
    cond = P.admin_text_search(["product_name", "comment"], q)
    if rating is not None:
        cond = cond & (F.col("rating") == rating)
    return df.where(cond)

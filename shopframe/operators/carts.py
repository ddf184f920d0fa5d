"""Cart and wishlist reads.

Every per-user page query becomes one job over all users: the user id is a
grouping or join key. Aggregates are decomposable (sum / count / bool_or /
min_by), so Spark combines them map-side and a user or a variant holding a
large share of rows costs one partial row per map task, not a hot reducer.
The catalog (variants ⋈ products) is joined first, so the big cart table is
shuffled once, on ``variant_id``; AQE splits a skewed variant partition or
broadcasts the catalog when its runtime size allows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import pricing as R
from ..functions import text as T


def catalog_lines(t, variant_cols=("price", "stock", "finish", "length_size", "width", "thickness")):
    v = t["product_variants"].select(F.col("id").alias("variant_id"), F.col("product_id"),
                                     *variant_cols)
    p = t["products"].select(F.col("id").alias("product_id"), "name", "image1")
    return v.join(p, "product_id", "inner")


CART_VARIANT_COLS = ("price", "stock", "finish", "length_size", "width", "thickness")


def cart_view(t, users: DataFrame | None = None, extra: tuple[str, ...] = ()) -> DataFrame:
    """Cart lines with the live variant price and product name (and
    ``extra`` columns of the variant); a line whose variant or product is gone
    vanishes (inner joins). ``users`` (a frame with ``user_id``) restricts to
    some users via a semi join."""
    ci = t["cart_items"]
    if users is not None:
        ci = ci.join(users.select("user_id").distinct(), "user_id", "left_semi")
    ci = ci.select(F.col("id").alias("cart_id"), "user_id", "variant_id", "quantity", "is_gift")
    return ci.join(catalog_lines(t, (*CART_VARIANT_COLS, *extra)), "variant_id", "inner").select(
        "user_id", "cart_id", "quantity", "is_gift", "variant_id", *CART_VARIANT_COLS, "product_id", "name", "image1",
        *extra)


def admin_cart_view(t) -> DataFrame:
    """The admin's view of users' carts, with gemstone colour, newest
    line first."""
    lines = catalog_lines(t, ("finish", "gemstones_colour", "length_size", "width", "thickness",
                              "price"))
    ci = t["cart_items"].select(F.col("id").alias("cart_item_id"), "user_id", "variant_id", "quantity")
    return (ci.join(lines, "variant_id", "inner")
            .select("user_id", "cart_item_id", "quantity", "product_id", "name", "image1",
                    "variant_id", "finish", "gemstones_colour", "length_size", "width",
                    "thickness", "price")
            .orderBy("user_id", F.col("cart_item_id").desc()))


def cart_lines_checked(t) -> DataFrame:
    """D9/H19 per line: line total, in-stock flag and at-stock-limit flag."""
    return (cart_view(t)
            .withColumn("line_total", R.line_total("price", "quantity"))
            .withColumn("in_stock", F.col("stock") >= F.col("quantity"))
            .withColumn("at_stock_limit", T.at_stock_limit("quantity", "stock")))


def cart_totals(t) -> DataFrame:
    """Per user subtotal, stock-issue flag and line count."""
    return cart_lines_checked(t).groupBy("user_id").agg(
        F.sum("line_total").cast("decimal(22,2)").alias("subtotal"),
        F.bool_or(~F.col("in_stock")).alias("has_stock_issue"),
        F.count(F.lit(1)).alias("line_count"))


def stock_feasibility(t) -> DataFrame:
    """a checkout is rejected as a whole when any line asks for more than
    the stock; the message names the first short line (lowest cart id)."""
    lines = cart_view(t)
    short = F.col("stock") < F.col("quantity")
    agg = lines.groupBy("user_id").agg(
        F.bool_and(~short).alias("accepted"),
        F.min_by(F.when(short, F.col("name")), F.when(short, F.col("cart_id"))).alias("_short_name"),
        F.sum(R.line_total("price", "quantity")).cast("decimal(22,2)").alias("subtotal"))
    return agg.select(
        "user_id", "accepted", "subtotal",
        F.when(~F.col("accepted"), F.concat(F.lit("Insufficient stock for "),
                                            F.col("_short_name"))).alias("message"))


def most_carted(t, n: int = 5) -> DataFrame:
    """Products by total quantity in carts, top ``n`` (id breaks ties)."""
    ci = t["cart_items"].groupBy("variant_id").agg(F.sum("quantity").alias("q"))
    v = t["product_variants"].select(F.col("id").alias("variant_id"), "product_id")
    per_product = ci.join(v, "variant_id").groupBy("product_id").agg(F.sum("q").alias("total_added"))
    p = t["products"].select("id", "name", "image1")
    return (per_product.join(p, per_product["product_id"] == p["id"]).drop("product_id")
            .orderBy(F.col("total_added").desc(), F.col("id").asc()).limit(n))


def most_wishlisted(t, n: int = 5) -> DataFrame:
    """Products by wishlist count, top ``n`` (id breaks ties)."""
    w = t["wishlist"].groupBy("product_id").agg(F.count("id").alias("total_added"))
    p = t["products"].select("id", "name", "image1")
    return (w.join(p, w["product_id"] == p["id"]).drop("product_id")
            .orderBy(F.col("total_added").desc(), F.col("id").asc()).limit(n))


def admin_wishlist_view(t) -> DataFrame:
    """users' wishlists with product card columns, newest entry first."""
    w = t["wishlist"].select(F.col("id").alias("wishlist_id"), "user_id", "product_id")
    p = t["products"].select(F.col("id").alias("product_id"), "name", "image1")
    return (w.join(p, "product_id", "inner")
            .select("user_id", "wishlist_id", F.col("product_id").alias("id"), "name", "image1")
            .orderBy("user_id", F.col("wishlist_id").desc()))


def wishlist_cards(t) -> DataFrame:
    """Per user, wishlisted products with MIN(variant price); a product
    without variants vanishes."""
    mins = t["product_variants"].groupBy("product_id").agg(F.min("price").alias("price"))
    p = t["products"].select(F.col("id").alias("product_id"), "name", "image1")
    cards = p.join(mins, "product_id", "inner")
    w = t["wishlist"].select("user_id", "product_id")
    return w.join(cards, "product_id", "inner").select(
        "user_id", F.col("product_id").alias("id"), "name", "image1", "price")


def wishlist_preview(t, k: int = 4) -> DataFrame:
    """First ``k`` wishlist cards per user (product id order). The
    ``row_number <= k`` filter becomes a WindowGroupLimit that runs before
    the shuffle, so a user with a huge wishlist sends at most k rows per task."""
    w = Window.partitionBy("user_id").orderBy("id")
    return (wishlist_cards(t).withColumn("position", F.row_number().over(w))
            .where(F.col("position") <= k))


def flag_wishlisted(products: DataFrame, wishlist: DataFrame) -> DataFrame:
    """C14: for each (user, product) pair of a listing, is it in the wishlist.
    ``products``: (user_id, product_id) pairs shown to users; one left join
    replaces the page's one-request-per-card checks."""
    w = wishlist.select("user_id", "product_id").distinct().withColumn("_in", F.lit(True))
    return (products.join(w, ["user_id", "product_id"], "left")
            .withColumn("in_wishlist", F.coalesce("_in", F.lit(False))).drop("_in"))

"""Admin dashboard reads: stats, lists, top-k, searches (A3, A4, B9,
B13-B18, B27, D5, E6, H11-H17).

The dashboard's browser-side searches become column predicates applied to
the list frames, so they run where the data is, not on a fetched copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T

MONEY = "decimal(22,2)"


def dashboard_stats(t) -> DataFrame:
    """Total orders, total users, pending orders and revenue (paid and
    not cancelled; 0 when none) in one pass: orders and users are narrowed to
    flag columns, unioned and aggregated once (no scalar subqueries, no
    join of one-row frames)."""
    o = t["orders"].select(
        F.lit(1).alias("is_order"), F.lit(0).alias("is_user"),
        (F.col("status") == "pending").cast("int").alias("is_pending"),
        F.when((F.col("payment_status") == "paid") & (F.col("status") != "cancelled"),
               F.col("grand_total")).alias("revenue"))
    u = t["users"].select(F.lit(0).alias("is_order"), F.lit(1).alias("is_user"),
                          F.lit(0).alias("is_pending"), F.lit(None).cast("decimal(12,2)").alias("revenue"))
    return o.unionByName(u).agg(
        F.sum("is_order").cast("bigint").alias("total_orders"),
        F.sum("is_user").cast("bigint").alias("total_users"),
        F.coalesce(F.sum("is_pending"), F.lit(0)).cast("bigint").alias("pending_orders"),
        F.coalesce(F.sum("revenue"), F.lit(0)).cast(MONEY).alias("total_revenue"))


def out_of_stock(t) -> DataFrame:
    """Variants with stock exactly 0 and their product, newest product first."""
    v = t["product_variants"].where(P.out_of_stock()).select("product_id", "sku", "stock")
    p = t["products"].select("id", "name")
    return (v.join(p, v["product_id"] == p["id"], "inner")
            .select("id", "name", "sku", "stock").orderBy(F.col("id").desc()))


def list_users(t) -> DataFrame:
    """Users newest first (by id) with role and login labels; the
    password column is never loaded."""
    u = t["users"]
    return (u.withColumn("role", T.role_label()).withColumn("login_type", T.login_label())
            .orderBy(F.col("id").desc()))


def recent_users(t, n: int = 5) -> DataFrame:
    """Newest ``n`` users."""
    return t["users"].select("id", "first_name", "last_name", "email").orderBy(F.col("id").desc()).limit(n)


def user_directory(t) -> DataFrame:
    """A4: id, names and e-mail of every user."""
    return t["users"].select("id", "first_name", "last_name", "email")


def list_subscribers(t) -> DataFrame:
    """A3: newsletter subscribers newest first."""
    return t["newsletter_subscribers"].select("id", "email", "subscribed_at").orderBy(F.col("id").desc())


def list_messages(t) -> DataFrame:
    """Contact messages newest first with escaped fields,
    50-character preview and read label."""
    m = t["contact_messages"]
    return (m.withColumn("preview", T.message_preview(T.html_escape("message")))
            .withColumn("name_html", T.html_escape("name"))
            .withColumn("status_label", T.read_label())
            .orderBy(F.col("id").desc()))


def search_orders(orders_list: DataFrame, q: str | None = None, status: str | None = None) -> DataFrame:
    """Order search over number, customer and e-mail plus status equality."""
    cond = P.admin_text_search(["order_number", "customer_name", "email"], q)
    if status:
        cond = cond & (F.col("status") == status)
    return orders_list.where(cond)


def search_users(users: DataFrame, q: str | None) -> DataFrame:
    """User search over id, names and e-mail."""
    return users.where(P.admin_text_search(["id", "first_name", "last_name", "email"], q))


def search_products_admin(products: DataFrame, q: str | None) -> DataFrame:
    """Admin product search over name and id."""
    return products.where(P.admin_text_search(["name", "id"], q))


def search_subscribers(subs: DataFrame, q: str | None) -> DataFrame:
    """Subscriber search by e-mail."""
    return subs.where(P.admin_text_search(["email"], q))


def search_messages(messages: DataFrame, q: str | None = None, state: str | None = None) -> DataFrame:
    """Message search (name OR e-mail OR text) plus read / unread."""
    cond = P.any_contains_ci(["name", "email", "message"], q)
    if state == "unread":
        cond = cond & (F.col("status") == 1)
    elif state == "read":
        cond = cond & (F.col("status") != 1)
    return messages.where(cond)


def duplicate_emails(users: DataFrame) -> DataFrame:
    """Users whose e-mail (case-insensitive) is also held by another
    user. Counting per e-mail is a partial aggregate; the semi join brings
    the flagged users back."""
    dup = (users.groupBy(F.lower("email").alias("_e")).agg(F.count(F.lit(1)).alias("_n"))
           .where(F.col("_n") > 1))
    return users.join(dup, F.lower(users["email"]) == dup["_e"], "left_semi")

"""Source / sink queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import pricing as R
from ..operators import catalog as C
from ..operators import checkout as CO
from ..session import scratch_path
from ..sources import sinks as K
from ..sources import tables as T
from ..sources.tableset import TableSet
from .change_queries import COD_STEPS_SQL, NOW
from .registry import register, register_session, tables


@register_session("tables_roundtrip_cards", "A1", money=("price",), sql="""
SELECT p.id, p.name, p.image1, MIN(v.price) AS price
FROM products p JOIN product_variants v ON v.product_id = p.id GROUP BY p.id, p.name, p.image1
""")
def tables_roundtrip_cards(spark, sf_dir):
    """A1: write the derived products and variants as parquet folders under
    the shared checkpoint folder, load them back with the explicit schemas,
    and rebuild the product cards from the loaded tables."""
    t = tables(spark, sf_dir)
    path = scratch_path(spark, f"tables-{uuid.uuid4().hex[:12]}")
    T.save_tables({"products": t["products"], "product_variants": t["product_variants"]}, path)
    loaded = T.load_tables(spark, path, ["products", "product_variants"])
    return C.product_cards(loaded, columns=["id", "name", "image1"])


@register("shop_page_with_total", "A8 D19", money=("price",), sql="""
SELECT *, COUNT(*) OVER () AS total_products FROM (
  SELECT p.id, p.name, p.image1, MIN(v.price) AS price
  FROM products p JOIN product_variants v ON v.product_id = p.id
  WHERE lower(p.category) = 'women' GROUP BY p.id, p.name, p.image1) x
""")
def shop_page_with_total(t):
    return K.with_total(C.shop(t, "women"))


@register("collection_counts_with_total", "A8 D14", sql="""
SELECT coalesce(collection_name, 'All') AS collection_key, id,
       COUNT(*) OVER (PARTITION BY coalesce(collection_name, 'All')) AS total_products
FROM products
""")
def collection_counts_with_total(t):
    p = t["products"].select(F.coalesce("collection_name", F.lit("All")).alias("collection_key"), "id")
    return K.with_total(p, ["collection_key"])


@register_session("result_with_total_written", "A8 D19", money=("price",), sql="""
SELECT x.*, (SELECT COUNT(*) FROM products p WHERE EXISTS (SELECT 1 FROM product_variants v WHERE v.product_id = p.id)) AS total
FROM (SELECT p.id, p.name, p.image1, MIN(v.price) AS price
      FROM products p JOIN product_variants v ON v.product_id = p.id GROUP BY p.id, p.name, p.image1) x
""")
def result_with_total_written(spark, sf_dir):
    """The product cards written with their total, and read back."""
    path = scratch_path(spark, f"result-{uuid.uuid4().hex[:12]}")
    K.write_result(C.product_cards(tables(spark, sf_dir), columns=C.CARD_COLUMNS), path)
    total = spark.read.parquet(f"{path}/_total").select("total").scalar()
    return spark.read.parquet(f"{path}/rows").withColumn("total", total)


CHECKOUT_TABLES = ["products", "product_variants", "cart_items", "orders", "order_items", "order_addresses",
                   "order_status_history"]


@register_session("checkout_committed_cart", "A8 G15", sql=f"""
WITH RECURSIVE {COD_STEPS_SQL.strip().removeprefix("WITH RECURSIVE").rsplit("SELECT seq, user_id, reason FROM steps", 1)[0].rstrip()}
SELECT ci.id, ci.user_id, ci.variant_id, CAST(ci.quantity AS BIGINT) AS quantity, CAST(ci.is_gift AS INTEGER) AS is_gift,
       CAST(v.stock - coalesce(d.q, 0) AS INTEGER) AS stock
FROM cart_items ci LEFT JOIN product_variants v ON v.id = ci.variant_id
LEFT JOIN (SELECT variant_id, SUM(quantity) AS q FROM cart WHERE user_id IN (SELECT user_id FROM steps WHERE k > 0 AND reason IS NULL)
           GROUP BY variant_id) d ON d.variant_id = ci.variant_id
WHERE ci.user_id NOT IN (SELECT user_id FROM steps WHERE k > 0 AND reason IS NULL)
""")
def checkout_committed_cart(spark, sf_dir):
    """A checkout batch committed as one, then the carts and the stock
    that the new version shows."""
    t = tables(spark, sf_dir)
    held = TableSet(spark, scratch_path(spark, f"shop-{uuid.uuid4().hex[:12]}"))
    held.commit({n: t[n] for n in CHECKOUT_TABLES})
    CO.commit_checkout(held, t["checkout_requests"], R.ts_literal(NOW))
    new = held.load()
    stock = new["product_variants"].select(F.col("id").alias("variant_id"), "stock")
    return new["cart_items"].join(stock, "variant_id", "left").select(
        "id", "user_id", "variant_id", F.col("quantity").cast("long"), F.col("is_gift").cast("int"), "stock")


@register("user_json_rows", "A9", sql="""
SELECT to_json({'id': id, 'last_name': last_name, 'email': email})::VARCHAR AS json FROM users
""")
def user_json_rows(t):
    return K.to_json_rows(t["users"].select("id", "last_name", "email"))

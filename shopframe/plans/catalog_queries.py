"""Catalog queries with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import catalog as C
from ..operators import search_index as SI
from .registry import register

CARD_SQL = """
SELECT p.id, p.name, p.image1, MIN(v.price) AS price
FROM products p JOIN product_variants v ON v.product_id = p.id
WHERE {where}
GROUP BY p.id, p.name, p.image1
"""


@register("shop_filtered_page", "D2 B1 B5 B6 E2 C1", money=('price',), sql=
          CARD_SQL.format(where="lower(p.category) = 'men' AND (v.price BETWEEN 1000 AND 2000 "
                                "OR v.price >= 4000) AND lower(v.finish) IN ('gold', 'rose')"))
def shop_filtered_page(t):
    """Shop page /shop/men?price=1000-2000,4000+&finish=Gold,rose&sort=low."""
    return C.shop(t, "Men", price="1000-2000,4000+", finish="Gold,rose", sort="low")


@register("shop_sub_category_page", "D2 B2 E2", money=('price',), sql=
          CARD_SQL.format(where="lower(p.category) = 'women' AND lower(p.sub_category) = 'economy' "
                                "AND v.price BETWEEN 0 AND 3000"))
def shop_sub_category_page(t):
    """/shop/women/economy?price=0-3000&sort=high."""
    return C.shop(t, "women", sub_category="Economy", price="0-3000", sort="high")


@register("shop_collection_page", "D2 B3", money=('price',), sql=
          CARD_SQL.format(where="lower(p.category) = 'unisex' AND "
                                "lower(replace(p.collection_name, ' ', '-')) = 'brand-4' "
                                "AND lower(v.finish) IN ('silver')"))
def shop_collection_page(t):
    """/shop/unisex/collection/brand-4?finish=silver."""
    return C.shop(t, "Unisex", collection="Brand-4", finish="silver")


@register("shop_all_by_collection", "B4 D14 D19", money=('price',), sql= """
WITH cards AS (
  SELECT p.id, p.name, p.collection_name, p.image1, MIN(v.price) AS price
  FROM products p JOIN product_variants v ON v.product_id = p.id
  WHERE lower(p.category) IN ('men', 'women', 'unisex')
  GROUP BY p.id, p.name, p.collection_name, p.image1)
SELECT *, coalesce(collection_name, 'null') AS collection_key,
       COUNT(*) OVER (PARTITION BY coalesce(collection_name, 'null')) AS collection_size
FROM cards
""")
def shop_all_by_collection(t):
    """/shop-all grouped by collection (NULL collection keyed 'null')."""
    return C.by_collection(C.shop_all(t), null_key="null")


@register("home_newest_cards", "E1 D1 C1", money=('price',), sql= """
SELECT p.id, p.name, p.description, p.category, p.sub_category, p.collection_name, p.metal,
       p.is_gifting, p.gifting_category, p.image1, p.image2, p.image3, p.image4,
       MIN(v.price) AS price
FROM products p JOIN product_variants v ON v.product_id = p.id
GROUP BY ALL ORDER BY p.id DESC LIMIT 12
""")
def home_newest_cards(t):
    return C.newest_cards(t, 12)


@register("all_product_cards", "D1 C1", money=('price',), sql= """
SELECT p.*, v.price FROM products p
JOIN (SELECT product_id, MIN(price) AS price FROM product_variants GROUP BY product_id) v
  ON v.product_id = p.id
""")
def all_product_cards(t):
    return C.product_cards(t)


@register("category_cards", "B1", money=('price',), sql= """
SELECT p.*, v.price FROM products p
JOIN (SELECT product_id, MIN(price) AS price FROM product_variants GROUP BY product_id) v
  ON v.product_id = p.id
WHERE lower(p.category) = 'women'
""")
def category_cards(t):
    """/category/WOMEN."""
    return C.category_cards(t, "WOMEN")


GIFT_SQL = """
SELECT p.id, p.name, p.image1, p.is_gifting, MIN(v.price) AS price
FROM products p JOIN product_variants v ON v.product_id = p.id
WHERE {where}
GROUP BY p.id, p.name, p.image1, p.is_gifting
{having}
"""


@register("gifts_for_him", "D3 B7", money=('price',), sql= GIFT_SQL.format(
    where="p.is_gifting = 1 AND lower(p.gifting_category) = 'for-him'", having=""))
def gifts_for_him(t):
    return C.gifts(t, "for-him")


@register("gifts_under_1599", "D3 B7", money=('price',), sql= GIFT_SQL.format(
    where="p.is_gifting = 1", having="HAVING MIN(v.price) <= 1599"))
def gifts_under_1599(t):
    return C.gifts(t, "under-1599")


@register("gifts_from_699", "D3 B7", money=('price',), sql= GIFT_SQL.format(
    where="p.is_gifting = 1", having="HAVING MIN(v.price) >= 699"))
def gifts_from_699(t):
    return C.gifts(t, "from-699")


@register("gifts_unknown_type", "D3 B7", money=('price',), sql= GIFT_SQL.format(where="p.is_gifting = 1", having=""))
def gifts_unknown_type(t):
    """A linked gift type with no branch: every gift product."""
    return C.gifts(t, "for-party-gifting")


@register("product_admin_list", "D4", """
SELECT p.*, CAST(COUNT(v.id) AS BIGINT) AS variant_count
FROM products p LEFT JOIN product_variants v ON v.product_id = p.id
GROUP BY ALL
""")
def product_admin_list(t):
    return C.product_admin_list(t)


@register("search_live", "B8 E3", money=('price',), sql= """
SELECT p.id, p.name, p.image1, MIN(v.price) AS price,
       CASE WHEN p.name ILIKE 'HOT%' THEN 1 ELSE 2 END AS search_rank
FROM products p JOIN product_variants v ON v.product_id = p.id
WHERE p.name ILIKE '%HOT%' OR p.category ILIKE '%HOT%' OR p.sub_category ILIKE '%HOT%'
   OR p.collection_name ILIKE '%HOT%'
GROUP BY p.id, p.name, p.image1
ORDER BY search_rank, p.id LIMIT 8
""")
def search_live(t):
    return C.search_products(t, "  HOT ", mode="live")


@register("search_tiered", "B8 E4", """
SELECT id, name, image1, category, sub_category, collection_name,
       CASE WHEN name ILIKE '%an%' THEN 1 WHEN collection_name ILIKE '%an%' THEN 2
            WHEN category ILIKE '%an%' THEN 3 ELSE 4 END AS search_rank
FROM products
WHERE name ILIKE '%an%' OR category ILIKE '%an%' OR sub_category ILIKE '%an%'
   OR collection_name ILIKE '%an%'
ORDER BY search_rank, id LIMIT 12
""")
def search_tiered(t):
    return C.search_products(t, "an", mode="tiered")


# One search a product: the texts typed for all of them, in one job.
ASKED_SQL = "SELECT query_id, trim(q) AS q FROM search_requests WHERE length(trim(q)) >= 2"


@register("search_live_many", "B8 E3", money=("price",), sql=f"""
WITH a AS ({ASKED_SQL}),
hit AS (SELECT a.query_id, p.id, p.name, p.image1, v.price,
               CASE WHEN p.name ILIKE a.q || '%' THEN 1 ELSE 2 END AS search_rank
        FROM a JOIN products p ON p.name ILIKE '%' || a.q || '%' OR p.category ILIKE '%' || a.q || '%'
          OR p.sub_category ILIKE '%' || a.q || '%' OR p.collection_name ILIKE '%' || a.q || '%'
        JOIN (SELECT product_id, MIN(price) AS price FROM product_variants GROUP BY product_id) v ON v.product_id = p.id)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY search_rank, id) AS INTEGER) AS position
               FROM hit) WHERE position <= 8
""")
def search_live_many(t):
    return SI.search_products_many(t, t["search_requests"], "live")


@register("search_tiered_many", "B8 E4", sql=f"""
WITH a AS ({ASKED_SQL}),
hit AS (SELECT a.query_id, p.id, p.name, p.image1, p.category, p.sub_category, p.collection_name,
               CASE WHEN name ILIKE '%' || a.q || '%' THEN 1 WHEN collection_name ILIKE '%' || a.q || '%' THEN 2
                    WHEN category ILIKE '%' || a.q || '%' THEN 3 ELSE 4 END AS search_rank
        FROM a JOIN products p ON p.name ILIKE '%' || a.q || '%' OR p.category ILIKE '%' || a.q || '%'
          OR p.sub_category ILIKE '%' || a.q || '%' OR p.collection_name ILIKE '%' || a.q || '%')
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY search_rank, id) AS INTEGER) AS position
               FROM hit) WHERE position <= 12
""")
def search_tiered_many(t):
    return SI.search_products_many(t, t["search_requests"], "tiered")


@register("related_products", "C15 E13", money=('related_price',), sql= """
WITH cards AS (
  SELECT p.id, p.name, p.image1, p.category, MIN(v.price) AS price
  FROM products p JOIN product_variants v ON v.product_id = p.id
  GROUP BY p.id, p.name, p.image1, p.category),
pairs AS (
  SELECT q.id AS product_id, c.id AS related_id, c.name AS related_name,
         c.image1 AS related_image1, c.price AS related_price,
         row_number() OVER (PARTITION BY q.id ORDER BY c.id) AS rn
  FROM products q JOIN cards c ON lower(c.category) = lower(q.category) AND c.id <> q.id)
SELECT product_id, CAST(rn AS INTEGER) AS position, related_id, related_name, related_image1,
       related_price
FROM pairs WHERE rn <= 4
""")
def related_products(t):
    return C.related_products(t, 4)


@register("variant_options", "D15", sql="""
SELECT DISTINCT product_id, option, value FROM (
  SELECT product_id, 'finish' AS option, finish AS value FROM product_variants WHERE trim(finish) <> ''
  UNION ALL SELECT product_id, 'gemstone', gemstones_colour FROM product_variants WHERE trim(gemstones_colour) <> ''
  UNION ALL SELECT product_id, 'size', length_size FROM product_variants WHERE trim(length_size) <> '')
""")
def variant_options(t):
    return C.variant_options(t)


@register("variant_option_lists", "D15", sql="""
SELECT product_id, option, CAST(1 AS BIGINT) AS page, string_agg(value, '|' ORDER BY value) AS vals FROM (
  SELECT DISTINCT product_id, option, value FROM (
    SELECT product_id, 'finish' AS option, finish AS value FROM product_variants WHERE trim(finish) <> ''
    UNION ALL SELECT product_id, 'gemstone', gemstones_colour FROM product_variants WHERE trim(gemstones_colour) <> ''
    UNION ALL SELECT product_id, 'size', length_size FROM product_variants WHERE trim(length_size) <> ''))
GROUP BY product_id, option
""")
def variant_option_lists(t):
    o = C.variant_option_lists(t)
    return o.select("product_id", "option", "page", F.array_join("values", "|").alias("vals"))


@register("default_variant", "D16", money=('price',), sql= """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY price, id) AS rn
  FROM product_variants) WHERE rn = 1
""")
def default_variant(t):
    return C.default_variant(t)


@register("quick_add_products", "D18", """
SELECT product_id, MIN(id) AS variant_id FROM product_variants
GROUP BY product_id HAVING COUNT(*) = 1
""")
def quick_add_products(t):
    return C.quick_add(t)


@register("product_images", "B19 B26", """
SELECT id,
  array_to_string(list_filter([image1, image2, image3, image4], lambda x: x IS NOT NULL AND x <> ''), ',')
    AS images,
  CAST(len(list_filter([image1, image2, image3, image4], lambda x: x IS NOT NULL AND x <> '')) AS INTEGER)
    AS n_images,
  coalesce(contains(lower(sub_category), 'ring'), false) AS is_ring
FROM products
""")
def product_images(t):
    im = C.product_images(t)
    rings = t["products"].select("id", P.is_ring().alias("is_ring"))
    return (im.join(rings, "id")
            .select("id", F.array_join("images", ",").alias("images"),
                    F.size("images").alias("n_images"), "is_ring"))


@register("wishlisted_products_by_ids", "A5", """
SELECT * FROM products WHERE id IN (SELECT product_id FROM wishlist)
""")
def wishlisted_products_by_ids(t):
    return C.by_ids(t["products"], t["wishlist"], "id", "product_id")


@register("variants_by_price", "A6", money=('price',), sql= "SELECT * FROM product_variants")
def variants_by_price(t):
    return C.variants_by_price(t)


@register("list_products", "A2", "SELECT * FROM products")
def list_products(t):
    return C.list_products(t)


@register("shop_result_count", "D19", """
SELECT CAST(COUNT(*) AS BIGINT) AS total_products FROM (
""" + CARD_SQL.format(where="lower(p.category) = 'men' AND (v.price BETWEEN 1000 AND 2000 "
                            "OR v.price >= 4000) AND lower(v.finish) IN ('gold', 'rose')") + ")")
def shop_result_count(t):
    return C.result_count(C.shop(t, "Men", price="1000-2000,4000+", finish="Gold,rose"))

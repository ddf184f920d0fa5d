"""Catalog reads: product cards, shop / category / collection pages, gifts,
search, related products, variant options.

Design notes for scale:
* Variants are aggregated per product *before* the join with products
  (``MIN(price)`` with map-side partial aggregation), so the join sees one row
  per product; the reference's ``p.* ... GROUP BY p.id`` relies on functional
  dependence that Spark does not accept.
* Filters on variant columns run before the aggregate, HAVING-style filters
  after it (they give different results and stay distinct).
* No broadcast hints: both sides of a catalog join grow with the catalog, so
  the physical join is left to Spark's size statistics and AQE (broadcast when
  the runtime size is under ``autoBroadcastJoinThreshold``, sort-merge else).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P

CARD_COLUMNS = ["id", "name", "image1"]


def list_products(t) -> DataFrame:
    """A2: full product listing."""
    return t["products"]


def variants_by_price(t) -> DataFrame:
    """Every product's variants, cheapest first (id breaks ties)."""
    return t["product_variants"].orderBy("product_id", "price", "id")


def min_price_per_product(variants: DataFrame, variant_filter: Column | None = None) -> DataFrame:
    v = variants if variant_filter is None else variants.where(variant_filter)
    return v.groupBy("product_id").agg(F.min("price").alias("price"))


def product_cards(t, product_filter: Column | None = None,
                  variant_filter: Column | None = None,
                  columns=None) -> DataFrame:
    """Products joined to the minimum price of their (matching)
    variants; a product without a matching variant vanishes (inner join)."""
    p = t["products"] if product_filter is None else t["products"].where(product_filter)
    if columns is not None:
        p = p.select(*columns)
    mins = min_price_per_product(t["product_variants"], variant_filter)
    return p.join(mins, p["id"] == mins["product_id"], "inner").drop("product_id")


def _sorted(df: DataFrame, sort: str | None) -> DataFrame:
    """Shop sort: 'low' / 'high' by price, default newest (id desc).
    The id is a tie-break so the order is total and repeatable."""
    if sort == "low":
        return df.orderBy(F.col("price").asc(), F.col("id").desc())
    if sort == "high":
        return df.orderBy(F.col("price").desc(), F.col("id").desc())
    return df.orderBy(F.col("id").desc())


def newest_cards(t, n: int = 12) -> DataFrame:
    """Newest ``n`` product cards (home page, category index)."""
    return product_cards(t).orderBy(F.col("id").desc()).limit(n)


def category_cards(t, category: str) -> DataFrame:
    """B1: all cards of one category, newest first."""
    return product_cards(t, P.category_filter(category)).orderBy(F.col("id").desc())


def shop(t, category: str | None = None, sub_category: str | None = None,
         price: str | None = None, finish: str | None = None, sort: str | None = None,
         collection: str | None = None, shop_all: bool = False) -> DataFrame:
    """A filtered shop page. Product predicates (category, sub-category,
    collection slug) and variant predicates (price ranges, finish) run before
    ``MIN(price)``, so a card's price is the minimum over matching variants."""
    pf = P.category_filter(category, sub_category)
    if shop_all:
        pf = pf & P.shop_all_filter()
    if collection is not None:
        pf = pf & (P.collection_slug() == F.lit(collection.lower()))
    vf = P.price_filter(price) & P.finish_filter(finish)
    cols = ["id", "name", "collection_name", "image1"] if shop_all else CARD_COLUMNS
    return _sorted(product_cards(t, pf, vf, columns=cols), sort)


def shop_all(t) -> DataFrame:
    """/shop-all: men + women + unisex cards with their collection name."""
    return shop(t, shop_all=True)


def gifts(t, gift_type: str | None) -> DataFrame:
    """Gift cards; under/from price limits are HAVING on MIN(price)."""
    cards = product_cards(t, P.gift_filter(gift_type),
                          columns=["id", "name", "image1", "is_gifting"])
    return cards.where(P.gift_having(gift_type)).orderBy(F.col("id").desc())


# Gift page titles by type.
GIFT_TITLES = {
    "for-him": "Gifts for Him",
    "for-her": "Gifts for Her",
    "under-1599": "Gifts Under ₹1599",
    "from-699": "Gifts From ₹699",
}


def gift_title(gift_type_col) -> Column:
    """Gift page title by type (NULL for other types)."""
    c = F.col(gift_type_col) if isinstance(gift_type_col, str) else gift_type_col
    expr = None
    for k, v in GIFT_TITLES.items():
        expr = (F.when(c == k, v) if expr is None else expr.when(c == k, v))
    return expr


def product_admin_list(t) -> DataFrame:
    """Products with their variant count (0 when none), newest first."""
    counts = t["product_variants"].groupBy("product_id").agg(F.count("id").alias("variant_count"))
    p = t["products"]
    return (p.join(counts, p["id"] == counts["product_id"], "left").drop("product_id")
            .withColumn("variant_count", F.coalesce("variant_count", F.lit(0)).cast("long"))
            .orderBy(F.col("id").desc()))


def search_products(t, q: str | None, mode: str = "live") -> DataFrame:
    """B8 + E3/E4: product search over name, category, sub-category and
    collection (case-insensitive contains, user wildcards kept).

    ``mode='live'``: cards with MIN(variant price); name-prefix matches first;
    8 rows. ``mode='tiered'``: plain product rows (no variant join), tiers
    name / collection / category / other; 12 rows. A query shorter than two
    characters returns no rows. The product id breaks ties in both modes.
    """
    q = P.search_text(q)
    cols = ["name", "category", "sub_category", "collection_name"]
    match = P.contains_ci(cols, q) if q is not None else F.lit(False)
    if mode == "live":
        cards = product_cards(t, match, columns=CARD_COLUMNS)
        rank = F.when(F.col("name").ilike(f"{q}%"), 1).otherwise(2) if q else F.lit(2)
        return (cards.withColumn("search_rank", rank)
                .orderBy("search_rank", "id").limit(8))
    pat = f"%{q}%"
    rank = (F.when(F.col("name").ilike(pat), 1)
            .when(F.col("collection_name").ilike(pat), 2)
            .when(F.col("category").ilike(pat), 3).otherwise(4))
    return (t["products"].where(match)
            .select("id", "name", "image1", "category", "sub_category", "collection_name")
            .withColumn("search_rank", rank)
            .orderBy("search_rank", "id").limit(12))


def related_products(t, k: int = 4) -> DataFrame:
    """For every product, up to ``k`` other products of the same category
    with their minimum price (lowest id first, the order MySQL's GROUP BY scan
    gives in practice).

    Avoids the quadratic self-join: keep the first k+1 cards per category (a
    ``row_number <= k+1`` filter that Spark turns into a partial
    WindowGroupLimit *before* the shuffle, so a hot category moves at most k+1
    rows per map task), join those candidates back to products on category
    (at most k+1 partners per product), drop the product itself, keep k.
    """
    # Category text compares case-insensitively, as the shop's SQL does.
    cards = (product_cards(t, columns=["id", "name", "image1", "category"])
             .withColumn("_cat", F.lower("category")))
    w = Window.partitionBy("_cat").orderBy("id")
    top = (cards.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1)
           .select("_cat", F.col("id").alias("related_id"),
                   F.col("name").alias("related_name"), F.col("image1").alias("related_image1"),
                   F.col("price").alias("related_price")))
    p = t["products"].select(F.col("id").alias("product_id"), F.lower("category").alias("_pcat"))
    pairs = (p.join(top, p["_pcat"] == top["_cat"], "inner")
             .where(F.col("related_id") != F.col("product_id")))
    w2 = Window.partitionBy("product_id").orderBy("related_id")
    return (pairs.withColumn("position", F.row_number().over(w2)).where(F.col("position") <= k)
            .select("product_id", "position", "related_id", "related_name",
                    "related_image1", "related_price"))


def by_collection(cards: DataFrame, null_key: str | None = "All") -> DataFrame:
    """Cards grouped by collection name. Flat form: one row per card
    with its ``collection_key`` (NULL collection -> ``null_key``; the /shop-all
    page keys them by the text 'null') and the per-collection card count.
    The count is a grouped aggregate joined back (partial aggregation, no
    collection is gathered into one task); nesting for display is
    ``nest_by_collection``."""
    keyed = cards.withColumn("collection_key", F.coalesce(F.col("collection_name"), F.lit(null_key)))
    counts = keyed.groupBy("collection_key").agg(F.count(F.lit(1)).alias("collection_size"))
    return keyed.join(counts, "collection_key", "inner")


def nest_by_collection(cards: DataFrame, null_key: str | None = "All", page_size: int = 1000) -> DataFrame:
    """D14, nested presentation: collection -> lists of cards (id desc), in
    pages of at most ``page_size`` cards (one row per collection and page)."""
    from .paging import nested_pages
    keyed = cards.withColumn("collection_key", F.coalesce(F.col("collection_name"), F.lit(null_key)))
    return nested_pages(keyed, "collection_key", [F.col("id").desc()], ["id", "name", "image1", "price"],
                        "products", page_size)


def result_count(df: DataFrame) -> DataFrame:
    """``totalProducts`` of a result as a one-row frame."""
    return df.agg(F.count(F.lit(1)).alias("total_products"))


# The option kinds shown on a product page and their columns.
OPTION_COLUMNS = (("finish", "finish"), ("gemstone", "gemstones_colour"), ("size", "length_size"))


def variant_options(t) -> DataFrame:
    """Distinct non-blank option values per product, flat:
    (product_id, option, value). Deduplicated by a grouped aggregate, so a
    product with very many variants costs partial rows per map task."""
    from functools import reduce
    v = t["product_variants"]
    parts = [v.where(P.non_blank(col)).select("product_id", F.lit(opt).alias("option"),
                                              F.col(col).cast("string").alias("value"))
             for opt, col in OPTION_COLUMNS]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def variant_option_lists(t, page_size: int = 1000) -> DataFrame:
    """D15, nested: per (product, option) the sorted distinct values, in
    pages of at most ``page_size`` values."""
    from .paging import nested_pages
    o = variant_options(t).withColumn("_k", F.concat_ws("|", F.col("product_id").cast("string"), "option"))
    pages = nested_pages(o, "_k", [F.col("value").asc()], ["value"], "values", page_size)
    return pages.select(F.split("_k", "[|]").getItem(0).cast("long").alias("product_id"),
                        F.split("_k", "[|]").getItem(1).alias("option"), "page",
                        F.transform("values", lambda x: x["value"]).alias("values"))


def default_variant(t) -> DataFrame:
    """The cheapest variant of each product (lowest id on equal price)."""
    v = t["product_variants"]
    best = v.groupBy("product_id").agg(
        F.min_by(F.struct(*[F.col(c) for c in v.columns]),
                 F.struct(F.col("price"), F.col("id"))).alias("v"))
    return best.select("v.*")


OPTION_PAIRS = (("finish", "finish"), ("gemstone", "gemstones_colour"), ("size", "length_size"))


def resolve_variant(t, choices: DataFrame) -> DataFrame:
    """Resolve chosen options to a variant iff exactly one variant of the
    product matches. ``choices``: (choice_id, product_id, finish, gemstone,
    size); a NULL choice means 'not chosen' and matches anything.
    Output: one row per choice with ``variant_id`` (NULL unless exactly one
    match) and ``match_count``.

    No choice is paired with a product's variants one by one: of the eight
    patterns of chosen / not-chosen options, each product's variants are counted
    per value of the chosen ones for the patterns its choices have, and every
    choice joins exactly one such count (equi join). Both sides grow with the
    input, and Spark's guess of their size is far too low, so both joins are
    merge joins: nothing is broadcast."""
    def key(column, i, pattern):
        """The option's value in the pattern: null if chosen and missing."""
        return F.when(pattern.bitwiseAND(1 << i) == 0, F.lit("")).otherwise(F.col(column))

    pattern = sum(F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, (c, _) in enumerate(OPTION_PAIRS))
    names = [f"_k{i}" for i in range(len(OPTION_PAIRS))]
    c = choices.select("choice_id", "product_id", pattern.alias("_p"),
                       *[F.coalesce(c, F.lit("")).alias(k) for k, (c, _) in zip(names, OPTION_PAIRS)])
    asked = c.where(F.col("product_id").isNotNull()).select("product_id", "_p").distinct()
    v = t["product_variants"].join(asked.hint("merge"), "product_id")
    v = v.select("product_id", "_p", "id", *[key(x, i, F.col("_p")).alias(k) for i, (k, (_, x)) in enumerate(zip(names, OPTION_PAIRS))])
    counts = v.dropna(subset=names).groupBy("product_id", "_p", *names).agg(
        F.count(F.lit(1)).alias("match_count"), F.min("id").alias("_vid"))
    m = c.join(counts.hint("merge"), ["product_id", "_p", *names], "left")
    return m.select("choice_id", F.coalesce("match_count", F.lit(0)).alias("match_count"),
                    F.when(F.col("match_count") == 1, F.col("_vid")).alias("variant_id"))


def quick_add(t) -> DataFrame:
    """Products with exactly one variant and that variant's id
    (eligible for one-click add to cart)."""
    v = t["product_variants"]
    return (v.groupBy("product_id").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("variant_id"))
            .where(F.col("n") == 1).select("product_id", "variant_id"))


def product_images(t) -> DataFrame:
    """Each product's non-empty images in order."""
    return t["products"].select("id", P.images_list().alias("images"))


def by_ids(df: DataFrame, ids: DataFrame, key: str = "id", ids_key: str | None = None) -> DataFrame:
    """A5: keyed fetch of many rows at once: semi join with a key frame."""
    ids_key = ids_key or key
    k = ids.select(F.col(ids_key).alias("_k")).distinct()
    return df.join(k, df[key] == k["_k"], "left_semi")

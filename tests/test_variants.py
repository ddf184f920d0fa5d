"""D17 on rows of its own: options that are not chosen, missing or empty."""

from pyspark.sql import functions as F

from shopframe.operators import catalog as C

VARIANT = "id long, product_id long, finish string, gemstones_colour string, length_size string"
CHOICE = "choice_id long, product_id long, finish string, gemstone string, size string"
VARIANTS = [(10, 1, "gold", "Red", "5"), (11, 1, "gold", None, "5"), (12, 1, None, "", "6"), (13, 1, "rose", "", None),
            (20, 2, None, None, None), (30, None, "gold", "Red", "5")]
CHOICES = [(1, 1, "gold", None, None), (2, 1, "gold", "Red", None), (3, 1, None, "", None), (4, 1, None, "", "6"),
           (5, 1, None, None, None), (6, 2, None, None, None), (7, 2, "gold", None, None), (8, 3, None, None, None),
           (9, None, "gold", None, None), (1, 1, "gold", "Red", "5")]
EXPECTED = [(1, 1, 10), (1, 2, None), (2, 1, 10), (3, 2, None), (4, 1, 12), (5, 4, None), (6, 1, 20), (7, 0, None),
            (8, 0, None), (9, 0, None)]


def test_choices_resolve_to_their_only_variant(spark):
    got = C.resolve_variant({"product_variants": spark.createDataFrame(VARIANTS, VARIANT)}, spark.createDataFrame(CHOICES, CHOICE))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == EXPECTED


def test_variants_are_not_sent_to_the_driver(spark):
    """Whatever sizes Spark expects, neither variants nor their counts are
    broadcast: the driver would hold them."""
    v = spark.range(1000).select("id", (F.col("id") % 300).alias("product_id"), *[
        F.col("id").cast("string").alias(c) for c in ("finish", "gemstones_colour", "length_size")])
    c = spark.range(500).select(F.col("id").alias("choice_id"), F.col("id").alias("product_id"), *[
        F.when(F.col("id") % k == 0, F.col("id").cast("string")).alias(n) for k, n in ((2, "finish"), (3, "gemstone"), (5, "size"))])
    got = C.resolve_variant({"product_variants": v}, c)
    assert got.count() == 500
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()

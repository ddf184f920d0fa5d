"""Mixing sources to target weights by Poisson replication.

Every source gets a repetition rate: its target share of the mixture's size
over its own size. A document's number of copies is a Poisson number with that
mean, found by inverting the distribution at a uniform number hashed from a
seed and the document, so the same seed gives the same mixture on any cluster
and documents draw independently. Documents are exploded by their counts and
all copies are shuffled globally: dealt to partitions by a hashed key and
sorted by it within each.

Rates come from one aggregate over (source, size); the texts take part only in
the final shuffle. The rate table has one row per source; it is broadcast when
it was counted to hold at most ``BROADCAST_SOURCES`` rows, and is joined by a
shuffle otherwise. A rate beyond ``PART_RATE`` is drawn as the sum of several
Poisson numbers of smaller mean, each with its own hash, so the cumulative
tables stay short.

Edge cases: a null source is a source of its own; a source without a weight,
or with weight 0 or null, is left out; null text has size 0 and takes part (a
source of size 0 gets rate 0); rows equal in id, source and text draw the same
count, and are numbered so that each is dealt on its own; an empty table gives an empty mixture; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, numbered

PART_RATE = 16.0            # largest mean inverted at once
TABLE = 120                 # entries of a cumulative table (mean 16: tail < 1e-60)
BROADCAST_SOURCES = 20_000  # rows of the rate table that may be broadcast
EQUAL_BLOCK = 1000          # equal rows written out by one task at a time
TEMPERATURE = 0.7
SEED = 20260


def uniform(*key: Column) -> Column:
    """Uniform number in [0, 1) from a 64-bit hash of the key."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11) * F.lit(2.0 ** -53)


def poisson_table(mean: Column) -> Column:
    """Cumulative probabilities of 0, 1, ..., TABLE - 1 for a mean."""
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))

    def step(a, k):
        p = a["p"] * mean / k
        c = a["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(a["all"], F.array(c)).alias("all"))

    ks = F.array(*[F.lit(float(k)) for k in range(1, TABLE)])
    return F.aggregate(ks, start, step, lambda a: a["all"])


def rates(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source", size: Column | None = None,
          temperature: float = TEMPERATURE, total: float | None = None) -> DataFrame:
    """One row per source: size, weight (normalised), rate. ``weights`` has
    (source, weight); without it a source weighs size ** temperature. ``total``
    is the size of the mixture (default: that of the input)."""
    size = size if size is not None else F.octet_length("text")
    by = docs.select(F.col(f"`{source_col}`").alias("source"), F.coalesce(size, F.lit(0)).cast("double").alias("_s"))
    by = by.groupBy("source").agg(F.sum("_s").alias("size"))
    if weights is None:
        by = by.withColumn("_w", F.pow("size", F.lit(temperature)))
    else:
        w = weights.select(F.col("source").alias("_src"), F.col("weight").cast("double").alias("_w"))
        by = by.join(w, F.col("source").eqNullSafe(F.col("_src")), "left").drop("_src")
    by = by.withColumn("_w", F.when((F.col("size") > 0) & (F.col("_w") > 0), F.col("_w")).otherwise(0.0))
    by = materialize(by)
    sums = by.agg(F.sum("_w").alias("w"), F.sum("size").alias("s")).first()
    w, s = sums.w or 0.0, total if total is not None else (sums.s or 0.0)
    share = F.col("_w") / F.lit(w) if w > 0 else F.lit(0.0)
    return by.select("source", "size", share.alias("weight"),
                     F.when(F.col("size") > 0, share * F.lit(float(s)) / F.col("size")).otherwise(0.0).alias("rate"))


def replicate(docs: DataFrame, rate: DataFrame, id_col: str = "doc_id", source_col: str = "source",
              text_col: str = "text", seed: int = SEED) -> DataFrame:
    """All copies of all documents in a global random order, followed by
    ``_copies``, ``_copy`` (from 0) and the ``_key`` of the shuffle; columns
    that already have such a name are replaced."""
    docs = docs.drop("_copies", "_copy", "_key")
    names = docs.columns
    d, place = numbered(docs)
    parts = F.greatest(F.ceil(F.col("rate") / F.lit(PART_RATE)), F.lit(1)).cast("int")
    table = rate.select(F.col("source").alias("_src"), parts.alias("_parts"),
                        poisson_table(F.col("rate") / parts).alias("_cdf")).where(F.col("rate") > 0)
    if rate.count() <= BROADCAST_SOURCES:      # the size is checked
        table = F.broadcast(table)
    key = [F.col(place[id_col]), F.col(place[source_col]), F.xxhash64(F.col(place[text_col]))]
    out = _number_equal(d, key).join(table, F.col(place[source_col]).eqNullSafe(F.col("_src")))
    # Number of table entries at or below the uniform number, summed over parts.
    draws = F.transform(F.sequence(F.lit(1), F.col("_parts")), lambda j: F.size(
        F.filter("_cdf", lambda c: c <= uniform(F.lit(seed), j, *key))))
    out = out.withColumn("_copies", F.aggregate(draws, F.lit(0), lambda a, x: a + x)).where(F.col("_copies") > 0)
    out = out.select(*d.columns, "_n", "_copies", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_copy"))
    deal = F.xxhash64(F.lit(seed + 1), *key, F.col("_copy"))
    out = out.withColumn("_key", F.when(F.col("_n") == 0, deal).otherwise(F.xxhash64(deal, "_n"))).drop("_n")
    return out.repartition(F.col("_key")).sortWithinPartitions("_key").toDF(*names, "_copies", "_copy", "_key")


def _number_equal(d: DataFrame, key: list[Column]) -> DataFrame:
    """``d`` with ``_n``: 0, and 0, 1, ... for rows equal in everything where
    several have one key. Equal rows are counted where they are met and written
    out again in blocks, so no task holds all of them."""
    own = F.xxhash64(*key)
    twice = materialize(d.groupBy(own.alias("_h")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("_h"))
    if twice.isEmpty():
        return d.withColumn("_n", F.lit(0).cast("long"))
    marked = d.withColumn("_h", own)
    once = marked.join(twice, "_h", "left_anti").select(*d.columns, F.lit(0).cast("long").alias("_n"))
    many = marked.join(twice, "_h", "left_semi").groupBy("_h", *d.columns).agg(F.count(F.lit(1)).alias("_m"))
    many = many.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_m - 1) div {EQUAL_BLOCK}"))))
    many = many.repartition("_h", "_b").withColumn("_n", F.explode(F.sequence(
        F.col("_b") * EQUAL_BLOCK, F.least(F.col("_m"), (F.col("_b") + 1) * EQUAL_BLOCK) - 1)))
    return once.unionByName(many.select(*d.columns, "_n"))


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, temperature: float = TEMPERATURE,
                total: float | None = None, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source",
                text_col: str = "text") -> DataFrame:
    """The mixture with the columns of ``docs``."""
    names = docs.columns
    d, place = numbered(docs)
    rate = rates(docs, weights, source_col, F.octet_length(F.col(f"`{text_col}`")), temperature, total)
    mixed = replicate(d, rate, place[id_col], place[source_col], place[text_col], seed)
    return mixed.drop("_copies", "_copy", "_key").toDF(*names)


def mixing_report(docs: DataFrame) -> DataFrame:
    """All copies with their document, source, count and shuffle key."""
    mixed = replicate(docs, rates(docs))
    return mixed.select("doc_id", "source", F.col("_copy").cast("long").alias("copy"),
                        F.col("_copies").cast("long").alias("n_copies"), F.col("_key").alias("shuffle_key"), "text")

"""Links inside crowded buckets, without comparing all parts with all parts.

A bucket of more nodes than one task compares is settled in steps, each followed
by union-find over the links found so far:

1. The bucket's nodes are dealt to parts and compared within them.
2. One node of each component that a bucket still has stands for it, and these
   are compared with one another where they are few.
3. Nodes outside the bucket's largest component are compared with everything:
   the largest component stays in its parts, which the others visit.

A crowd that its links join thus costs about a row a node; only nodes that stay
apart are repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, materialize_alone
from .components import FEW_EDGES, components


def part_of(node: str, key: str, parts) -> F.Column:
    """The part of a node, another one in each bucket."""
    return F.pmod(F.xxhash64(node, key), parts).cast("int")


def crowd_rows(members: DataFrame, limit: int) -> DataFrame:
    """``members``: (key, node, comp). Rows (key, i, j, side, node, comp): what
    meets in each task. Nodes of a bucket's largest component (part numbers
    from 0) meet the others (negative part numbers), and the others one
    another; a bucket of at most ``limit`` nodes is one part."""
    by = members.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    sizes = materialize(by.groupBy("key").agg(F.sum("c").alias("all"), F.max(F.struct("c", "comp")).alias("m")).select(
        "key", "all", F.col("m.comp").alias("main"), F.ceil(F.col("m.c") / F.lit(limit)).cast("int").alias("big"),
        F.greatest(F.ceil((F.col("all") - F.col("m.c")) / F.lit(limit)), F.lit(1)).cast("int").alias("rest")))
    m = members.join(sizes, "key")
    small = m.where(F.col("all") <= limit).select("key", *[F.lit(0).alias(c) for c in ("i", "j", "side")], "node", "comp")
    m = m.where(F.col("all") > limit).withColumn("in_main", F.col("comp") == F.col("main")).withColumn(
        "side", F.when(F.col("in_main"), F.pmod(F.xxhash64("node"), F.col("big")))
        .otherwise(-1 - F.pmod(F.xxhash64("node"), F.col("rest"))).cast("int"))
    others = F.transform(F.sequence(F.lit(1), F.col("rest")), lambda k: -k)
    meets = F.when(F.col("in_main"), others).otherwise(F.concat(others, F.sequence(F.lit(0), F.col("big") - 1)))
    m = m.withColumn("o", F.explode(meets)).select("key", F.least("side", "o").alias("i"), F.greatest("side", "o").alias("j"),
                                                   "side", "node", "comp")
    return small.unionByName(m)


def _named(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members`` with their component, and the components as links: a star
    each, in place of all the links that led to it."""
    comp = materialize(components(links, FEW_EDGES))
    named = members.join(comp.withColumnRenamed("component", "comp"), "node", "left")
    return (materialize(named.select("key", "node", F.coalesce("comp", "node").alias("comp"))),
            comp.select(F.col("node").alias("a"), F.col("component").alias("b")))


def join_parts(members: DataFrame, links: DataFrame, verify, limit: int) -> DataFrame:
    """Steps 2 and 3: ``members`` (key, node) of crowded buckets whose parts
    were compared; ``links`` (a, b) found so far. ``verify`` takes rows as of
    ``crowd_rows`` and gives links. Returns the further links."""
    named, stars = _named(members, links)
    reps = materialize(named.groupBy("key", "comp").agg(F.min("node").alias("node")))
    few = reps.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where((F.col("c") > 1) & (F.col("c") <= limit)).select("key")
    more = materialize_alone(verify(reps.join(few, "key", "left_semi").select(
        "key", *[F.lit(0).alias(c) for c in ("i", "j", "side")], "node", "comp")))
    named, _ = _named(members, stars.unionByName(more))
    mixed = materialize(named.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key"))
    if mixed.isEmpty():
        return more
    return more.unionByName(materialize_alone(verify(crowd_rows(named.join(mixed, "key", "left_semi"), limit))))

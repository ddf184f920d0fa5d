"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Rows are grouped by equal text and groups are placed whole, each into the
shard where the dot product of its vector (bytes, tokens, rows; each as a share
of the total) with the shard's residual capacity is highest, larger groups
first. A group holding more than a quarter of a shard in any dimension is
first cut into pieces by a hash of its rows (at most 4 * shards such groups
can exist per dimension, so their table is small by construction and is
broadcast).

The greedy order is sequential, so it is split in a way that keeps its
quality: pieces of at least 3 / ``HEAD`` of the total in some dimension (of
which there can be no more than ``HEAD``) are placed one after another on the
driver, as a table of vectors without texts; all others are dealt by hash to
buckets of about ``BUCKET`` pieces, and each bucket is packed by one streaming
pass, its capacities being its share of what the head left free in each shard.
Every piece in the tail is small against a bucket's capacity, so each bucket
fills its shares evenly.

``slot`` numbers a shard's rows from 0 without gathering a shard in one task:
row numbers within (shard, hash bucket) plus the sums of the buckets before.

Edge cases: null and empty texts have size 16 and crc 0 and form one group;
repeated rows are rows of their own; fewer groups than shards leave shards
empty; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered, shuffle_partitions

SHARDS = 40
PIECE = 0.25          # largest piece of a group, as a part of a shard
HEAD = 20_000         # bound of the pieces placed one by one on the driver
BUCKET = 20_000       # smaller pieces packed in one pass
DIMENSIONS = ("bytes", "tokens", "rows")
IMPORTANCE = np.array([1.0, 0.1, 0.1])   # of the dimensions in the dot product


class Packer:
    """Greedy placement by dot product with the residual capacities."""

    def __init__(self, residual: np.ndarray):
        self.residual = residual          # (shards, dimensions), shares of the total

    def place(self, vector: np.ndarray) -> int:
        shard = int(np.argmax(self.residual @ (vector * IMPORTANCE)))
        self.residual[shard] -= vector
        return shard


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, group key, vector and crc (no texts)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("t"))
    return d.select(
        "doc_id", F.unhex(F.md5("t")).alias("key"), (F.octet_length("t") + 16).cast("long").alias("bytes"),
        F.size(F.array_remove(F.split("t", "[\\x20\\x09-\\x0D]+"), "")).cast("long").alias("tokens"),
        F.lit(1).cast("long").alias("rows"), F.crc32("t").alias("crc"),
        F.monotonically_increasing_id().alias("n"))


def place_groups(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their piece, placement of every (key, piece))."""
    spark = rows.sparkSession
    total = rows.agg(*[F.sum(c).alias(c) for c in DIMENSIONS]).first()
    total = np.array([float(total[c] or 0) for c in DIMENSIONS])
    scale = np.where(total > 0, 1 / np.maximum(total, 1), 0.0)
    largest = F.greatest(*[F.sum(c) * float(s) for c, s in zip(DIMENSIONS, scale)])
    hot = (rows.groupBy("key").agg(largest.alias("_share"))
           .select("key", F.ceil(F.col("_share") * (shards / PIECE)).cast("int").alias("pieces"))
           .where(F.col("pieces") > 1))
    # Only 3 * shards / PIECE groups can hold so much: bounded.
    rows = rows.join(F.broadcast(hot), "key", "left").withColumn(
        "piece", F.coalesce(F.pmod(F.xxhash64("n"), F.col("pieces")), F.lit(0)).cast("int")).drop("pieces")
    vectors = [(F.sum(c) * float(s)).alias(f"v{i}") for i, (c, s) in enumerate(zip(DIMENSIONS, scale))]
    pieces = materialize(rows.groupBy("key", "piece").agg(*vectors)
                         .withColumn("large", F.greatest("v0", "v1", "v2")))
    order = [F.desc("large"), F.asc("key"), F.asc("piece")]
    # Shares add up to 1 in each of three dimensions: at most HEAD such pieces.
    head = pieces.where(F.col("large") >= 3 / HEAD).toPandas()
    head = head.sort_values(["large", "key", "piece"], ascending=[False, True, True])
    packer = Packer(np.full((shards, 3), 1.0 / shards) * (total > 0))
    head["shard"] = [packer.place(v) for v in head[["v0", "v1", "v2"]].to_numpy(dtype=np.float64)]
    placed = spark.createDataFrame(
        [(bytes(k), int(p), int(s)) for k, p, s in zip(head["key"], head["piece"], head["shard"])],
        "key binary, piece int, shard int")
    tail = pieces.where(F.col("large") < 3 / HEAD)
    buckets = math.ceil(tail.count() / BUCKET)
    if buckets == 0:
        return rows, placed
    tail = tail.withColumn("bucket", F.pmod(F.xxhash64("key", "piece"), F.lit(buckets)).cast("int"))
    sums = tail.groupBy("bucket").agg(*[F.sum(f"v{i}").alias(f"s{i}") for i in range(3)])
    free = packer.residual
    left = np.maximum(free.sum(axis=0), 1e-300)

    def task(batches):
        bucket, pack = None, None
        for batch in batches:
            b = batch.column(2).to_numpy(zero_copy_only=False)
            v, whole = (np.column_stack([batch.column(k + i).to_numpy(zero_copy_only=False) for i in range(3)])
                        for k in (3, 6))
            shard = np.zeros(len(b), dtype=np.int32)
            for i in range(len(b)):
                if b[i] != bucket:
                    bucket = b[i]
                    pack = Packer(free * (whole[i] / left))
                shard[i] = pack.place(v[i])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shard)],
                                             names=["key", "piece", "shard"])

    packed = (tail.join(sums, "bucket").repartition("bucket").sortWithinPartitions("bucket", *order)
              .select("key", "piece", "bucket", "v0", "v1", "v2", "s0", "s1", "s2")
              .mapInArrow(task, "key binary, piece int, shard int"))
    return rows, placed.unionByName(packed)


def shard_rows(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard, slot of every row."""
    spark = docs.sparkSession
    rows, placed = place_groups(materialize(describe(docs, id_col, text_col)), shards)
    buckets = max(16, shuffle_partitions(spark))
    rows = materialize(rows.join(placed, ["key", "piece"]).select(
        "doc_id", F.col("bytes").alias("size"), F.col("crc").alias("text_crc32"), "tokens", "shard", "n",
        F.pmod(F.xxhash64("doc_id", "n"), F.lit(buckets)).cast("int").alias("b")))
    counts = rows.groupBy("shard", "b").agg(F.count(F.lit(1)).alias("c"))     # at most shards * buckets rows
    before = Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "b").orderBy("doc_id", "n")) - 1
    return (rows.withColumn("w", within).join(F.broadcast(counts), ["shard", "b"])
            .select("doc_id", "size", "text_crc32", "tokens", "shard",
                    (F.col("start") + F.col("w")).cast("long").alias("slot")))


def sharding_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """The digest columns of ``shard_rows`` under the law ``bytes``."""
    return shard_rows(docs, shards).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id",
                 text_col: str = "text", files_per_shard: int = 1) -> None:
    """Write the documents as Parquet under ``path``/shard=<n>. Rows equal in
    id and text may stand in any order within their shard."""
    plan = shard_rows(docs, shards, id_col, text_col).groupBy("doc_id", "text_crc32", "size", "shard").agg(
        F.count(F.lit(1)).alias("_times"))
    names = [c for c in docs.columns if c != "shard"]
    d, place = numbered(docs.select(*[F.col(f"`{c}`") for c in names]))
    text = F.coalesce(F.col(place[text_col]), F.lit(""))
    d = d.withColumns({"_crc": F.crc32(text), "_size": (F.octet_length(text) + 16).cast("long")})
    one = d.dropDuplicates([place[id_col], "_crc", "_size"])
    out = one.join(plan, F.col(place[id_col]).eqNullSafe(F.col("doc_id")) & (F.col("_crc") == F.col("text_crc32"))
                   & (F.col("_size") == F.col("size")))
    out = out.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    out = out.withColumn("_f", F.pmod(F.xxhash64(place[id_col], "_k"), F.lit(files_per_shard))).repartition("shard", "_f")
    (out.select(*[F.col(place[c]).alias(c) for c in names], "shard").write.partitionBy("shard").parquet(path))

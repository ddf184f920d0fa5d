"""Pagination and ranking within groups.

``page`` fetches one page (a top-k). ``number_rows`` gives every row its
position (and page) in a total order, optionally within groups, without a
single-partition window and without gathering a hot group into one task:

1. range-partition and sort by (group, order) - a hot group spans several
   range partitions, because the order columns split it;
2. tag rows with their partition and in-partition index
   (``monotonically_increasing_id``), then cut lineage with a reliable
   ``checkpoint()`` so every later read sees the same tagging;
3. count rows per (partition, group) - at most #partitions rows per group -
   and turn counts into per-(partition, group) start offsets with a small
   window over those counts;
4. join the offsets back on (partition, group): position = offset + index
   within the partition's run of the group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, materialize


def page(df: DataFrame, order: list[Column], page_no: int, size: int) -> DataFrame:
    """One page (1-based) of a total order."""
    return df.orderBy(*order).offset((page_no - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    """Number of pages for a page size (0 rows -> 0 pages)."""
    return df.agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("pages"))


def number_rows(df: DataFrame, order: list[Column], group_cols: list[str] | None = None,
                page_size: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """Row positions (1-based) in ``order`` within ``group_cols`` (or over the
    whole frame), plus the page number when ``page_size`` is given.
    ``order`` must be a total order (end it with a unique column)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    groups = list(group_cols or [])
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g).asc_nulls_first() for g in groups] + list(order)
    tagged = (df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id())
              .checkpoint(eager=True))
    # In-partition index: the id's low 33 bits.
    tagged = tagged.withColumn("_idx", F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), 33))
    runs = tagged.groupBy("_pid", *groups).agg(F.count(F.lit(1)).alias("_cnt"),
                                               F.min("_idx").alias("_first"))
    w = (Window.partitionBy(*groups).orderBy("_pid") if groups else Window.orderBy("_pid"))
    runs = runs.withColumn("_start", F.coalesce(
        F.sum("_cnt").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = runs.select(F.col("_pid").alias("_rpid"), *[F.col(g).alias(f"_rg_{g}") for g in groups],
                    "_start", "_first")
    cond = F.col("_pid") == F.col("_rpid")
    for g in groups:  # NULL is a group of its own
        cond = cond & F.col(g).eqNullSafe(F.col(f"_rg_{g}"))
    out = (tagged.join(r, cond, "inner")
           .drop("_rpid", *[f"_rg_{g}" for g in groups])
           .withColumn("position", (F.col("_start") + F.col("_idx") - F.col("_first") + 1).cast("long"))
           .drop("_pid", "_mid", "_idx", "_start", "_first"))
    if page_size:
        out = out.withColumn("page", F.floor((F.col("position") - 1) / page_size).cast("long") + 1)
    return out


def running_sums(df: DataFrame, group_cols: list[str], order: list[Column], value_cols: list[str],
                 num_partitions: int | None = None, suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of ``value_cols`` in ``order`` within
    ``group_cols``, without a one-task window per group: range partitions
    split a hot group; each (partition, group) run is summed locally and
    shifted by the totals of the same group in earlier partitions (at most
    #partitions rows per group). ``order`` must be a total order."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g).asc_nulls_first() for g in group_cols] + list(order)
    tagged = (df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id())
              .checkpoint(eager=True))
    w = (Window.partitionBy("_pid", *group_cols).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = tagged.select("*", *[F.sum(v).over(w).alias(f"_loc_{v}") for v in value_cols])
    totals = tagged.groupBy("_pid", *group_cols).agg(*[F.sum(v).alias(f"_tot_{v}") for v in value_cols])
    wo = (Window.partitionBy(*group_cols).orderBy("_pid") if group_cols else Window.orderBy("_pid"))
    offs = totals.select("_pid", *group_cols, *[
        F.coalesce(F.sum(f"_tot_{v}").over(wo.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias(f"_off_{v}") for v in value_cols])
    r = offs.select(F.col("_pid").alias("_rpid"), *[F.col(g).alias(f"_rg_{g}") for g in group_cols],
                    *[f"_off_{v}" for v in value_cols])
    cond = F.col("_pid") == F.col("_rpid")
    for g in group_cols:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_rg_{g}"))
    out = local.join(r, cond, "inner")
    for v in value_cols:
        out = out.withColumn(f"{v}{suffix}", F.col(f"_off_{v}") + F.col(f"_loc_{v}"))
    return out.drop("_pid", "_rpid", *[f"_rg_{g}" for g in group_cols],
                    *[f"_loc_{v}" for v in value_cols], *[f"_off_{v}" for v in value_cols])


def nested_pages(df: DataFrame, key: str, order: list[Column], value_cols: list[str], name: str,
                 page_size: int = 1000) -> DataFrame:
    """Nest ``value_cols`` of the rows of each ``key`` into arrays of at most
    ``page_size`` elements, in ``order``: one row per (key, page), elements
    carry their 1-based position ``pos``.

    Keys with more than ``page_size`` rows are found first (a count per key,
    which reads the key column only). Usually there is none, and every key is
    numbered by a window over its one page. Where some exist, their rows alone
    are numbered with the skew-safe ``number_rows`` and cut into pages. No group
    ever holds more than ``page_size`` rows; the result is the same either way."""
    large = materialize(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > page_size).select(key))
    w = Window.partitionBy(key).orderBy(*order)

    def one_page(rows):
        return (rows.withColumn("position", F.row_number().over(w).cast("long"))
                .withColumn("page", F.lit(1).cast("long")))

    if large.isEmpty():
        numbered = one_page(df)
    else:
        big = number_rows(df.join(large, key, "left_semi"), order, [key]).withColumn(
            "page", (F.floor((F.col("position") - 1) / page_size) + 1).cast("long"))
        numbered = one_page(df.join(large, key, "left_anti")).unionByName(big)
    return numbered.groupBy(key, "page").agg(
        F.sort_array(F.collect_list(F.struct(F.col("position").alias("pos"), *[F.col(c) for c in value_cols])))
        .alias(name))

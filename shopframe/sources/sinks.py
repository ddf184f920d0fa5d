"""Result sinks: A8 (result + total count) and A9 (rows as JSON text)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def with_total(df: DataFrame, group_cols=None, name: str = "total_products") -> DataFrame:
    """Attach the result's row count (per group when given) to every
    row: a grouped count joined back (partial aggregation, no window over the
    whole result)."""
    if group_cols:
        counts = df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias(name))
        return df.join(counts, list(group_cols), "inner")
    total = df.agg(F.count(F.lit(1)).alias(name)).scalar()
    return df.withColumn(name, total)


def write_result(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None,
                 mode: str = "overwrite") -> int:
    """Write a result table (parquet or JSON lines), optionally
    partitioned, plus a one-row ``_total`` table with its row count. The rows
    are counted as they are written (an observed metric), so the result is
    computed once. Returns the count."""
    spark, path = df.sparkSession, path.rstrip("/")
    seen = Observation()
    w = df.observe(seen, F.count(F.lit(1)).alias("total")).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    getattr(w, fmt)(f"{path}/rows")
    total = seen.get["total"]
    spark.range(1).select(F.lit(total).cast("long").alias("total")).write.mode(mode).parquet(f"{path}/_total")
    return total


def to_json_rows(df: DataFrame, col: str = "json") -> DataFrame:
    """Every row as one JSON object text (the page's ``json`` helper)."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(col))


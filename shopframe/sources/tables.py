"""A1: load the storefront tables.

``load_tables`` reads parquet folders with the explicit schemas of
``shopframe.schemas`` (no inference; column pruning and filter pushdown reach
the scan). ``load_jdbc_table`` reads a table straight from the shop's SQL
database in parallel slices of a numeric key (``partitionColumn``), the way a
cluster should read an OLTP source; it needs the database's JDBC driver on
the classpath and is not exercised by the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import SCHEMAS


def load_tables(spark: SparkSession, path: str, names=None) -> dict[str, DataFrame]:
    """``{name: DataFrame}`` for ``<path>/<name>`` parquet folders or files."""
    out = {}
    for name in names or SCHEMAS:
        out[name] = spark.read.schema(SCHEMAS[name]).parquet(f"{path.rstrip('/')}/{name}")
    return out


def load_jdbc_table(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int,
                    partitions: int, properties: dict | None = None) -> DataFrame:
    """Parallel JDBC read: ``partitions`` range slices of ``key`` in
    [lower, upper] run as separate tasks."""
    reader = (spark.read.format("jdbc").option("url", url).option("dbtable", table)
              .option("partitionColumn", key).option("lowerBound", lower).option("upperBound", upper)
              .option("numPartitions", partitions).option("fetchsize", 10000))
    for k, v in (properties or {}).items():
        reader = reader.option(k, v)
    return reader.load()


def save_tables(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Write storefront tables as parquet folders (the layout ``load_tables``
    reads)."""
    for name, df in tables.items():
        df.write.mode(mode).parquet(f"{path.rstrip('/')}/{name}")

"""Shared pieces of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import ensure_checkpoint_dir, materialize, scratch_path  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it
    back: computed once, lineage cut, survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_alone(df: DataFrame) -> DataFrame:
    """``materialize``, whose shuffles then go at once and not when the driver
    happens to collect its garbage: for what shuffles the texts."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, "false")
    conf.set(key, "true")
    try:
        return materialize(df.select("*"))      # a new frame: it takes the setting as it is made
    finally:
        conf.set(key, before)


def with_columns_of(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, whatever else the input carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def map_whole_rows(df: DataFrame, task, extra: list[StructField] = ()) -> DataFrame:
    """``mapInArrow`` over all columns, whatever their names: they reach the
    task as c0, c1, ... in order, and keep their names in the result."""
    fields = [StructField(f"c{i}", f.dataType, True) for i, f in enumerate(df.schema.fields)]
    out = df.toDF(*[f.name for f in fields]).mapInArrow(task, StructType([*fields, *extra]))
    return out.toDF(*df.columns, *[f.name for f in extra])


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns named c0, c1, ... (so that none clashes with a
    name used inside an operator), and the new name of each old one."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), {n: f"c{i}" for i, n in enumerate(df.columns)}

"""Query registry: name -> (Spark builder, oracle SQL).

A builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame built with the
library's operators over the storefront tables derived from ``sf_dir``. The
oracle SQL is written against the storefront table names; ``oracle_sql()``
prefixes the DuckDB derivation of each storefront table it mentions as a CTE.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from ..sources.fixtures import derive_tables, duckdb_ctes


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str  # SURVEY ids covered


REGISTRY: dict[str, Query] = {}
_TABLE_CACHE: dict[tuple[int, str], dict] = {}


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    key = (id(spark), sf_dir)
    if key not in _TABLE_CACHE:
        _TABLE_CACHE[key] = derive_tables(spark, sf_dir)
    return _TABLE_CACHE[key]


def as_report(df: DataFrame) -> DataFrame:
    """Money stays DECIMAL inside the library; a registered query reports it
    as DOUBLE so both engines hand the same float64 values to the comparison."""
    return df.select(*[F.col(f"`{f.name}`").cast("double").alias(f.name)
                       if isinstance(f.dataType, DecimalType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def register(name: str, ops: str, sql: str | None = None, money: tuple = ()):
    """Decorator for ``fn(t) -> DataFrame`` (``t`` = storefront tables).
    ``money`` names the DECIMAL output columns the oracle casts to DOUBLE."""
    if sql and money:
        casts = ", ".join(f"CAST({m} AS DOUBLE) AS {m}" for m in money)
        sql = f"SELECT * REPLACE ({casts}) FROM (\n{sql}\n) AS _q"

    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return as_report(fn(tables(spark, sf_dir)))
        build.__name__ = name
        build.__doc__ = fn.__doc__
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build, sql, ops)
        return fn
    return deco


def register_session(name: str, ops: str, sql: str | None = None, money: tuple = ()):
    """Decorator for ``fn(spark, sf_dir) -> DataFrame``: queries that need the
    session itself (streams, written and re-read tables)."""
    def deco(fn):
        register(name, ops, sql=sql, money=money)(fn)
        q = REGISTRY[name]

        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return as_report(fn(spark, sf_dir))
        build.__name__ = name
        build.__doc__ = fn.__doc__
        q.build = build
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q.build for k, q in REGISTRY.items()}


def with_fixtures(sql: str) -> str:
    ctes = duckdb_ctes()
    used = [n for n in ctes if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    body = sql.strip()
    head = ",\n".join(f"{n} AS ({ctes[n]})" for n in used)
    m = re.match(r"(?is)^with(\s+recursive)?\s", body)
    if m:
        kw = "WITH RECURSIVE" if m.group(1) else "WITH"
        return f"{kw} {head},\n{body[m.end():]}"
    return f"WITH {head}\n{body}"


def oracle_sql() -> dict[str, str]:
    return {k: with_fixtures(q.sql) for k, q in REGISTRY.items() if q.sql}

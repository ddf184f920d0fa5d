"""Registered storefront queries (one per SURVEY §2 operator) and the DuckDB
oracle SQL for each. Importing this package registers every query module."""

from .registry import REGISTRY, oracle_sql, queries  # noqa: F401
from . import (catalog_queries, change_queries, io_queries, order_queries,  # noqa: F401,E402
               store_queries, stream_queries)

"""Registered queries of the training-data operators: ``(spark, sf_dir)`` to
DataFrame, each over the whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (bitslice, decontam, langid, linededup, merkle, minhash, mixing, quality, sharding, simhash, substring,
               suffixes, toxicity)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op8_decontamination(spark, sf_dir):
    """Words of each document inside an occurrence of a benchmark window."""
    return decontam.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op9_quality_rules(spark, sf_dir):
    """Rule ledger of every document under policy version 2."""
    return quality.quality_report(table(spark, sf_dir, "documents"))


ORACLE["op9_quality_rules"] = quality.ORACLE_SQL


@query
def op2_toxicity(spark, sf_dir):
    """Chained category probabilities of every document."""
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_language_id(spark, sf_dir):
    """Predicted language of every document."""
    return langid.language_report(table(spark, sf_dir, "documents"))


@query
def op5_mixing(spark, sf_dir):
    """Every copy of the mixture that flattens source sizes to power 0.7."""
    return mixing.mixing_report(table(spark, sf_dir, "documents"))


@query
def op6_sharding(spark, sf_dir):
    """Shard and slot of every document, 40 shards near equal in bytes."""
    return sharding.sharding_report(table(spark, sf_dir, "documents"))


@query
def op1_simhash(spark, sf_dir):
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicate_report(table(spark, sf_dir, "documents"))


@query
def op3_substring_dedup(spark, sf_dir):
    """Words of each document inside a 20-word window that starts earlier."""
    return substring.substring_report(table(spark, sf_dir, "documents"))


@query
def op7_suffix_dedup(spark, sf_dir):
    """Bytes of each document inside a 50-byte string of an earlier document."""
    return suffixes.suffix_report(table(spark, sf_dir, "documents"))


@query
def op4_line_dedup(spark, sf_dir):
    """Lines of each document that are not the first of their class."""
    return linededup.line_report(table(spark, sf_dir, "documents"))


@query
def op12_merkle(spark, sf_dir):
    """Merkle proof of every document, and the root folded from a changed one."""
    return merkle.manifest_report(table(spark, sf_dir, "documents"))


ORACLE["op12_merkle"] = merkle.ORACLE_SQL


@query
def op13_minhash(spark, sf_dir):
    """Shingle set size and near-duplicate class of every document."""
    return minhash.near_duplicate_report(table(spark, sf_dir, "documents"))


@query
def op11_ranked_search(spark, sf_dir):
    """The ten highest-scoring documents for every benchmark item."""
    return bitslice.search_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op11_ranked_search"] = bitslice.ORACLE_SQL


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

"""Bounds that hold however ids and rows repeat, long texts, heavy beginnings."""

import random
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shopframe.llm import langid, mixing, sharding, suffixes, toxicity
from tests.llm import brute
from tests.llm.conftest import SCHEMA, ordered, rows_of, words

SPANS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.fixture
def collected(monkeypatch):
    """Rows that each toPandas brings to the driver."""
    from pyspark.sql.classic.dataframe import DataFrame
    real, seen = DataFrame.toPandas, []

    def count(self):
        out = real(self)
        seen.append(len(out))
        return out
    monkeypatch.setattr(DataFrame, "toPandas", count)
    return seen


def test_toxicity_sample_is_bounded(spark, collected):
    """20,000 documents of one labelled id, and others."""
    rows = [(7, f"bad word {i}") for i in range(20_000)] + [(i, f"good text {i} here") for i in range(100, 400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(7, 0, 1)] + [(i, 1, i % 2) for i in range(100, 400)], "doc_id long, quality int, toxic int")
    toxicity.train(docs, toxicity.chain_labels(labels), toxicity.CATEGORIES, sample_rows=50)
    assert collected and max(collected) <= 50


def test_language_sample_is_bounded(spark, collected):
    """A third of the rows are one row, a third share an id."""
    rng = random.Random(3)
    rows = [(2, "the same text of words", "en")] * 3000 + [(2, words(rng, 8), "en") for _ in range(3000)]
    rows += [(10 + i, words(rng, 8), "xx" if i % 2 else "en") for i in range(3000)]
    docs = spark.createDataFrame([(d, t, x, "s", 1) for d, t, x in rows], SCHEMA).repartition(4)
    model = langid.train(docs, sample_rows=100)
    assert model is not None and collected and max(collected) <= 100


def test_equal_rows_are_dealt_over_the_partitions(spark):
    rows = [(5, "hot text " * 3, "a") for _ in range(3000)] + [(i, f"text {i}", "b") for i in range(6000)]
    docs = spark.createDataFrame([(d, t, None, s, 1) for d, t, s in rows], SCHEMA).repartition(6)
    mixed = mixing.replicate(docs, mixing.rates(docs))
    sizes = [r[1] for r in mixed.groupBy(F.spark_partition_id()).count().collect()]
    copies = {(r.doc_id, r.n) for r in mixed.groupBy("doc_id", F.col("_copies").alias("n")).count().collect()}
    assert len({n for d, n in copies if d == 5 and n}) <= 1
    assert max(sizes) < 3 * np.mean(sizes)
    keys = sorted(r._key for r in mixed.select("_key").collect())
    again = mixing.replicate(docs.repartition(3), mixing.rates(docs))
    assert keys == sorted(r._key for r in again.select("_key").collect())
    assert len(set(keys)) > 0.99 * len(keys)


def test_slots_of_null_ids_are_numbered_in_many_windows(spark):
    docs = spark.createDataFrame([(None, f"t {i % 40}", None, "s", 1) for i in range(4000)], SCHEMA).repartition(4)
    got = sharding.shard_rows(docs, 4).select("shard", "slot").collect()
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_shards_balance_tokens_and_rows_too(spark):
    """With the weights in use, bytes stay within 1 %, tokens and rows within a
    tenth of even on documents of mixed length."""
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, words(rng, rng.randint(1, 60)), None, "s", 1) for i in range(4000)], SCHEMA)
    got = sharding.shard_rows(docs, 8).groupBy("shard").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"),
                                                            F.count(F.lit(1)).alias("r")).toPandas()
    for c, bound in (("b", 0.01), ("t", 0.1), ("r", 0.1)):
        assert (pd.Series(got[c]) / got[c].mean() - 1).abs().max() < bound


def test_long_texts_are_read_in_segments(spark, monkeypatch):
    """Texts many times the bound, windows over every border."""
    monkeypatch.setattr(suffixes, "SEGMENT", 64)
    rng = random.Random(7)
    base = words(rng, 300, 50)
    rows = [(i, base[a:a + 900] + words(rng, 20, 50) + base[b:b + 300]) for i, a, b in
            [(k, rng.randrange(600), rng.randrange(600)) for k in range(25)]] + [(30, base), (31, base), (None, base), (32, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert rows_of(suffixes.suffix_report(docs), *SPANS) == ordered(brute.spans(rows))


def indented(rng, n):
    return "\n".join(" " * rng.randrange(20, 64) + "return " + words(rng, 5, 60) for _ in range(n))


def test_heavy_beginnings_are_dealt_window_by_window(spark, monkeypatch):
    """Indented code: most suffixes begin with blanks. The result is exact, and
    the largest bucket shrinks as their number grows."""
    rng = random.Random(5)
    rows = [(i, indented(rng, 25)) for i in range(60)]
    rows += [(100 + i, rows[i][1][:400] + indented(rng, 5)) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = ordered(brute.spans(rows))
    largest, heavy = {}, {}
    real = suffixes._suffixes
    for n in (8, 16, 32):
        sizes = {}
        monkeypatch.setattr(suffixes, "bucket_count", lambda d, n=n: n)

        def watched(span, lead, splitters, heavy):
            sizes["heavy"], sizes["n"] = len(heavy), len(splitters) + 1
            return real(span, lead, splitters, heavy)
        monkeypatch.setattr(suffixes, "_suffixes", watched)
        assert rows_of(suffixes.suffix_report(docs), *SPANS) == want
        heavy[n] = sizes["heavy"]
        d = suffixes.identified(docs, "doc_id", "text")
        hits = suffixes.shared_positions(d, suffixes.sampled(50, 20), n)
        sent = suffixes.with_lists(d, hits, "pos").mapInArrow(
            real(50, 20, *suffixes.sample_splitters(d, n, 50, 20)), "bucket int, found int, data binary")
        by = sent.where("found IS NULL").groupBy("bucket").agg(F.sum(F.length("data")).alias("b")).collect()
        largest[n] = max(r.b for r in by) / sum(r.b for r in by)
    assert heavy[32] > 0
    assert largest[32] < 0.6 * largest[8]


def test_template_lines_send_few_rows(spark, monkeypatch):
    """A template of many lines in crowded buckets: rows of text grow with the
    lines, not with their square, and the result is that of small tasks."""
    from shopframe.llm import linededup
    base = "a rather long line of text that very many documents carry with a small change in it, number "
    rows = [(i, f"{base}{i}") for i in range(3000)] + [(5000 + i, f"quite another line {i * i} of words {i}") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    real = linededup._fetch

    def counted(batches):
        for b in real(batches):
            total.add(b.num_rows)
            yield b
    total = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(linededup, "_fetch", counted)
    monkeypatch.setattr(linededup, "LIMIT", 100)
    got = rows_of(linededup.line_report(docs), "doc_id", "n_lines", "n_removed", "kept_sha256")
    assert sum(r[2] for r in got if r[0] < 5000) == 2999 and all(r[2] == 0 for r in got if r[0] >= 5000)
    assert total.value < 12 * 3000


@pytest.mark.parametrize("few", [True, False])
def test_few_links_take_no_rounds(spark, monkeypatch, few):
    """Links of crowded buckets that one task holds are joined there; more of
    them go through rounds, with the same result."""
    from shopframe.llm import crowds, linededup
    from shopframe.operators import components
    base = "a rather long line of text that many documents carry with some small change in it "
    rows = [(i, f"{base}{i}\n{base}{i % 7} and more") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    written, real = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df: written.append(df.columns) or real(df))
    monkeypatch.setattr(linededup, "LIMIT", 5)
    if not few:
        monkeypatch.setattr(crowds, "FEW_EDGES", 0)
        monkeypatch.setattr(linededup, "FEW_EDGES", 0)
    got = rows_of(linededup.line_report(docs), "doc_id", "n_lines", "n_removed", "kept_sha256")
    assert got == ordered(brute.lines(rows))
    assert (["u", "m", "open"] not in written) == few


def test_shuffles_go_with_their_table(spark):
    """The table's shuffle files are dropped when it is written; the setting
    and the table stay."""
    from pathlib import Path
    from shopframe.llm.common import materialize, materialize_alone
    folder = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])

    def files():
        return {p.name for p in folder.rglob("shuffle_*.data")}

    def left(write):
        before = files()
        out = write(spark.range(1000).repartition(4, "id"))
        time.sleep(2)
        new = files() - before
        assert out.count() == 1000
        return new

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key)
    assert left(materialize)
    assert not left(materialize_alone)
    assert spark.conf.get(key) == was

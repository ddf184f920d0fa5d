"""Decontamination and quality rules against plain Python versions."""

import random

import pytest
from pyspark import cloudpickle

from shopframe.llm import decontam, quality
from tests.llm import brute
from tests.llm.conftest import SCHEMA, ordered, rows_of

SMALL = "/root/testdata/sf0.001"
HIT = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.fixture(scope="module")
def items(rows):
    text = dict(rows)
    return [(1, text[8][40:300]), (2, text[8][40:300].upper()), (3, "one"), (4, "two words"), (5, None), (6, ""),
            (7, "!? --"), (8, "t1 t2 t3 t4 t5 t6 t7 t8 t9 t10 t11"), (None, text[10][:200]), (1, text[4]),
            (20, "été où ça naïve Übergröße été"), (21, "日本語のテキスト" * 20)]


@pytest.fixture(scope="module")
def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_decontamination_odd(odd, rows, benchmark, items):
    assert rows_of(decontam.contamination_report(odd, benchmark), *HIT) == ordered(brute.contamination(rows, items))


def test_decontamination_small(spark):
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = ordered(brute.contamination(rows, items))
    assert rows_of(decontam.contamination_report(docs, bench), *HIT) == want
    clean = {r[0] for r in want if not r[-1]}
    assert {r.doc_id for r in decontam.remove_contaminated(docs, bench).collect()} == clean and len(clean) < len(want)


def test_decontamination_in_blocks(spark):
    """A test set beyond one block takes several passes, with the same result."""
    docs, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    one = decontam.find_contamination(docs, bench)
    many = decontam.find_contamination(docs, bench, block_bytes=2000)
    columns = ("doc_id", "n_words", "n_hit", "item_ids", "longest_match")
    assert rows_of(one, *columns) == rows_of(many, *columns)


def test_long_items_in_pieces(spark):
    """Items beyond a block are cut, with the same result in every column."""
    rng = random.Random(8)
    w = [f"w{rng.randrange(2000)}" for _ in range(1500)]
    loop = ["round", "and"] * 60
    texts = [w, w[1400:] + w[:90], w[300:420], w[17:40], ["odd"], [], loop, w[700:1000] + loop]
    items = [(i, " ".join(t)) for i, t in enumerate(texts)]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    rows = [(1, " ".join(w)), (2, " ".join(w[100:1300])), (3, " ".join(w[:9])), (4, None), (5, " ".join(loop[:31])),
            (6, " ".join(w[55:65] + ["x"] + w[1390:] + w[:50])), (7, "no hit"), (8, "an odd word"),
            *[(100 + n, " ".join(["x", *w[60:60 + n], "y"])) for n in range(8, 130, 3)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    one = decontam.find_contamination(docs, bench)
    assert rows_of(decontam.contamination_report(docs, bench), *HIT) == ordered(brute.contamination(rows, items))
    assert {r.doc_id: r.longest_match for r in one.collect()}[2] == 1200
    clean = {r.doc_id for r in decontam.remove_contaminated(docs, bench).collect()}
    assert clean and len(clean) < len(rows)
    for size in (1000, 4000):
        blocks = list(decontam.test_blocks(bench, "item_id", "text", block_bytes=size))
        assert len(blocks) > 3 and any(b.resumes and b.continues for b in blocks)
        many = decontam.find_contamination(docs, bench, block_bytes=size)
        assert rows_of(many, *one.columns) == rows_of(one, *one.columns)
        left = decontam.remove_contaminated(docs, bench, block_bytes=size)
        assert {r.doc_id for r in left.collect()} == clean and left.columns == docs.columns


def test_block_is_linear_in_its_text(spark):
    """What a task is sent holds each word's hash once, within the bound."""
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(5000))), (2, "é" * 9000 + " tail")],
                                  "item_id long, text string").coalesce(1)
    whole, = decontam.test_blocks(bench, "item_id", "text")
    assert len(cloudpickle.dumps(decontam._match(whole, decontam.WINDOW))) < 8 * 5002 + 50_000
    parts = list(decontam.test_blocks(bench, "item_id", "text", block_bytes=8000))
    assert all(b.h.nbytes + 16 * len(b.ids) <= 8000 for b in parts) and len(parts) == 7


def test_item_hashes(monkeypatch):
    text = "Ab cd, " * 50 + "é" * 300 + " x" * 40 + "--"
    want = decontam.item_hashes(text)
    assert len(want) == len(brute.ALNUM.findall(text.encode()))
    monkeypatch.setattr(decontam, "CHUNK_BYTES", 16)
    assert decontam.item_hashes(text).tolist() == want.tolist() and len(decontam.item_hashes("")) == 0


def test_longest_match(spark):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(1, "x " + " ".join(words[5:42]) + " y"), (2, " ".join(words[:9]))],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(words))], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.find_contamination(docs, bench).collect()}
    assert (got[1].longest_match, got[1].n_hit, got[1].n_locations) == (37, 37, 28)
    assert [tuple(s) for s in got[1].spans] == [(1, 38)]
    assert (got[2].longest_match, got[2].n_hit, got[2].spans) == (0, 0, [])


def test_decontamination_empty(spark, empty, odd, benchmark):
    assert decontam.contamination_report(empty, benchmark).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert not any(r.contaminated for r in decontam.contamination_report(odd, none).collect())
    kept = decontam.remove_contaminated(odd, none)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert decontam.remove_contaminated(odd, benchmark).columns == odd.columns


MEASURE = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_odd(odd, rows):
    short = [(d, t) for d, t in rows if d not in (11, 12)]
    got = quality.quality_report(odd.where("doc_id is null or doc_id not in (11, 12)"))
    assert rows_of(got, *MEASURE) == ordered(brute.quality(short))
    assert all(r.kept == (r.failure_bits == 0) and (r.kept is False or not r.base_failed) for r in got.collect())
    long = quality.quality_report(odd.where("doc_id = 11")).first()
    assert (long.n_words, long.kept) == (30_000, True)


def test_quality_empty(spark, empty):
    assert quality.quality_report(empty).count() == 0
    nulls = quality.quality_report(spark.createDataFrame([(None,) * 5] * 2, SCHEMA)).collect()
    assert [(r.n_words, r.base_failed, r.kept) for r in nulls] == [(0, True, False)] * 2


def test_policies_and_ablations(odd):
    led = quality.ledger(odd)
    rows = led.collect()
    for policy in quality.POLICIES.values():
        mask = policy.mask()
        kept = quality.apply_policy(led, policy)
        assert kept.where("kept").count() == sum(r.failure_bits & mask == 0 for r in rows)
        for r in quality.ablations(led, policy).collect():
            bit = next(x.bit for x in quality.RULES if x.name == r.rule)
            failed = [x.failure_bits & mask for x in rows]
            assert r.failed == sum(f >> bit & 1 for f in failed)
            assert r.failed_alone == sum(f == 1 << bit for f in failed)
            assert r.dropped_without == sum(f & ~(1 << bit) != 0 for f in failed)


def test_quality_plan_has_no_python(spark):
    plan = quality.quality_report(spark.read.parquet(f"{SMALL}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Exchange"))

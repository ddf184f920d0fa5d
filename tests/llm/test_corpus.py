"""Mixing, sharding, the pipeline and the registered queries."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shopframe.llm import decontam, mixing, queries, sharding, simhash, toxicity
from tests.llm import brute
from tests.llm.conftest import SCHEMA, odd_rows, ordered, rows_of

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


def invert(mean, u):
    """Smallest k whose cumulative Poisson probability exceeds u."""
    p = c = math.exp(-mean)
    k = 0
    while c <= u and k < mixing.TABLE:
        k += 1
        p *= mean / k
        c += p
    return k


def test_mixing_against_inversion(spark, docs):
    weights = spark.createDataFrame([(f"s{i}", float(i)) for i in range(4)], "source string, weight double")
    d = docs.withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string")))
    rate = mixing.rates(d, weights, total=20e6)
    by = {r.source: r for r in rate.collect()}
    assert by["s0"].rate == 0 and by["s4"].rate == 0 and abs(sum(r.weight for r in by.values()) - 1) < 1e-9
    assert max(r.rate for r in by.values()) > mixing.PART_RATE       # several draws are added up
    parts = {s: max(1, math.ceil(r.rate / mixing.PART_RATE)) for s, r in by.items()}
    u = [mixing.uniform(F.lit(mixing.SEED), F.lit(j), F.col("doc_id"), F.col("source"), F.xxhash64("text")).alias(f"u{j}")
         for j in range(1, max(parts.values()) + 1)]
    want = {}
    for r in d.select("doc_id", "source", *u).collect():
        n = parts[r.source]
        want[r.doc_id] = sum(invert(by[r.source].rate / n, r[f"u{j}"]) for j in range(1, n + 1)) if by[r.source].rate else 0
    mixed = mixing.replicate(d, rate)
    got = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert got == Counter({k: v for k, v in want.items() if v})
    size = {r.source: r.b for r in mixed.groupBy("source").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    for s in ("s1", "s2", "s3"):
        assert abs(size[s] / (20e6 * by[s].weight) - 1) < 0.15


def test_mixing_is_shuffled_and_repeatable(docs):
    one = [(r.doc_id, r.copy) for r in mixing.mixing_report(docs).collect()]
    two = mixing.mixing_report(docs.repartition(5))
    assert Counter(one) == Counter((r.doc_id, r.copy) for r in two.collect())
    ids = [d for d, _ in one]
    assert sum(a < b for a, b in zip(ids, ids[1:])) < 0.6 * len(ids)
    copies = Counter(ids)
    assert all(r.n_copies == copies[r.doc_id] for r in two.collect())


def test_mixing_odd(spark, odd, empty):
    mixed = mixing.mix_sources(odd)
    assert mixed.columns == odd.columns and mixed.count() > 0
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mix_sources(empty).columns == empty.columns
    nulls = spark.createDataFrame([(None,) * 5] * 3, SCHEMA)
    assert mixing.mix_sources(nulls).count() == 0                     # sources of size 0


SHARD = ("doc_id", "size", "text_crc32")


def check_plan(got, rows, shards):
    import zlib
    want = [(d, len(brute.raw(t)) + 16, zlib.crc32(brute.raw(t))) for d, t in rows]
    assert rows_of(got, *SHARD) == ordered(want)
    slots = {}
    for r in got.collect():
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return got.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.sum("tokens").alias("t")).collect()


def test_sharding_balance(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sharding.sharding_report(docs).cache()
    load = check_plan(got, rows, 40)
    mean = sum(r.b for r in load) / 40
    assert len(load) == 40 and all(0.95 < r.b / mean < 1.05 for r in load)


def test_sharding_tail_and_hot_group(spark, monkeypatch):
    """A third of all rows are one text; most pieces are packed in buckets."""
    rows = [(i, "same text " * 20 if i % 3 == 0 else f"text {i} " * (1 + i * 7 % 60)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(sharding, "HEAD", 300)
    monkeypatch.setattr(sharding, "BUCKET", 500)
    load = check_plan(sharding.sharding_report(docs, 10).cache(), rows, 10)
    mean = sum(r.b for r in load) / 10
    assert all(0.97 < r.b / mean < 1.03 for r in load)


def test_equal_texts_share_a_shard(spark):
    rows = [(i, f"text {i // 3} " * 30) for i in range(900)]
    got = sharding.sharding_report(spark.createDataFrame(rows, "doc_id long, text string"), 5)
    assert got.groupBy("text_crc32").agg(F.countDistinct("shard").alias("n")).where("n > 1").count() == 0


def test_sharding_odd(spark, odd, rows, empty, tmp_path):
    check_plan(sharding.sharding_report(odd, 4).cache(), rows, 4)
    assert sharding.sharding_report(empty).count() == 0
    sharding.write_shards(odd, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert rows_of(back, "doc_id", "text") == ordered(rows)


def test_pipeline_stages(spark, tmp_path):
    """Every stage against its plain version, on its own input."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("labels", "benchmark"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash near-dedup", "benchmark decontamination", "mixing", "sharding"]
    columns = docs.columns

    def step(name, d):
        out = stages[name](spark, d, SMALL)
        out.write.parquet(str(tmp_path / name.split()[0]))
        return spark.read.parquet(str(tmp_path / name.split()[0]))

    def pairs(d):
        return [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]

    one = step("toxicity", docs)
    rejected = {r.doc_id for r in toxicity.toxicity_report(docs, labels).where("toxic").collect()}
    assert {d for d, _ in pairs(one)} == {d for d, _ in pairs(docs)} - rejected and rejected
    two = step("simhash near-dedup", one)
    assert sorted(d for d, _ in pairs(two)) == sorted({c for _, _, c in brute.simhash(pairs(one))})
    three = step("benchmark decontamination", two)
    items = [(r.item_id, r.text) for r in bench.collect()]
    clean = [r[0] for r in brute.contamination(pairs(two), items) if not r[-1]]
    assert sorted(d for d, _ in pairs(three)) == sorted(clean)
    four = step("mixing", three)
    assert Counter(pairs(four)) == Counter(pairs(mixing.mix_sources(three)))
    assert one.columns == two.columns == three.columns == four.columns == columns
    check_plan(step("sharding", four).cache(), pairs(four), 40)


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 100 and {"doc_id", "shard", "slot"} <= set(out.columns)


def test_pipeline_stages_take_odd_documents(spark, odd, empty):
    wide = odd.unionByName(odd.withColumn("text", F.lit("more text of another kind"))).checkpoint()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, wide, SMALL)
        assert out.count() > 0, name
        assert name == "sharding" or out.columns == odd.columns
        assert stage(spark, empty, SMALL).count() == 0


def test_registered_queries():
    names = list(queries.queries())
    for n in range(1, 11):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert set(queries.oracle_sql()) <= set(names)


def test_operators_used_by_the_pipeline_are_the_library_s():
    assert corpus_pipeline.simhash is simhash and corpus_pipeline.decontam is decontam and len(odd_rows()) > 20

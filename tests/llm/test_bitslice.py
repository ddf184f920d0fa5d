"""Ranked lexical search against every document scored for every item."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shopframe.llm import bitslice
from shopframe.llm.textcore import chunks
from tests.llm.brute import ALNUM, LOWER, raw
from tests.llm.conftest import SCHEMA, rows_of, words

COLUMNS = ("item_id", "rank", "doc_id", "score")


def terms(text):
    return ALNUM.findall(raw(text).translate(LOWER))


def brute(rows, items, k=10):
    counts = [(d, Counter(terms(t))) for d, t in rows]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m))
                    for w in set(terms(text)) if c[w])
            if s > 0:
                scored.append((-s, d is None, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=lambda r: (r[0] is not None, r))


@pytest.fixture(scope="module")
def asked(rows):
    texts = [t for _, t in rows]
    items = [(1, texts[3][:300]), (2, (texts[7] or "")[:500]), (3, "ONE two words ÉTÉ été"), (4, "no such term at all"), (5, None),
             (6, ""), (7, "a b c one"), (8, "fox dog the fox the wood x"), (9, texts[10][:4000])]
    return items


def test_odd_rows(spark, odd, rows, asked):
    items = spark.createDataFrame(asked, "item_id long, text string").repartition(2)
    assert rows_of(bitslice.search_report(odd, items), *COLUMNS) == brute(rows, asked)


def test_blocks_of_items_and_small_slices(spark, odd, rows, asked, monkeypatch):
    """Several blocks of items, few documents a slice, few cells at once."""
    items = spark.createDataFrame(asked, "item_id long, text string")
    monkeypatch.setattr(bitslice, "GATHER", 200)
    monkeypatch.setattr(bitslice, "CELLS", 3000)
    got = bitslice.search(odd, items, block_terms=60)
    assert rows_of(got, *COLUMNS) == brute(rows, asked)


def test_copies_ties_and_shuffled_bounds(spark, monkeypatch):
    """A third of all rows are one text, near copies fill the ranks, named
    documents are too many to broadcast."""
    import random
    rng = random.Random(8)
    hot = words(rng, 40)
    rows = [(i, hot if i % 3 == 0 else words(rng, rng.randint(1, 60))) for i in range(400)] + [(7, hot), (None, hot)]
    items = [(i, words(rng, rng.randint(1, 30))) for i in range(25)] + [(99, hot)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    assert rows_of(bitslice.search_report(docs, asked), *COLUMNS) == want
    monkeypatch.setattr(bitslice, "BROADCAST_ROWS", 0)
    assert rows_of(bitslice.search(docs, asked, k=3), *COLUMNS) == brute(rows, items, 3)


def test_bounds_are_never_below_the_scores():
    rng = np.random.default_rng(5)
    texts = [" ".join(f"t{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 300)) % 5000) for _ in range(70)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(70)), pa.array(texts), pa.array(range(70))], names=["doc_id", "text", "t"])
    ask = []
    for i in range(9):
        (c,) = chunks(pa.array([texts[i]]))
        ask.append((i, bitslice.term_counts(c)[2]))
    items = bitslice.Items(ask)
    found = list(bitslice._scan(items.terms, True, pa.int64())(iter([batch])))
    df = {r["term"]: r["df"] for b in found for r in b.to_pylist() if r["term"] is not None}
    total = sum(len(re.findall("t[0-9]+", t)) for t in texts)
    items.weigh(df, 70)
    exact = bitslice._score(items, 70, total)(iter([pa.RecordBatch.from_arrays(
        [pa.array(range(70)), pa.array(texts), pa.array([list(range(9))] * 70)], names=["doc_id", "text", "items"])]))
    score = {(r["item"], r["doc_id"]): r["score"] for b in exact for r in b.to_pylist()}
    seen = 0
    for r in (r for b in found for r in b.to_pylist() if r["n"] is not None):
        for lo, bound in bitslice.bounds(items, r, 70, total):
            for i, k in np.ndindex(bound.shape):
                s = score.get((i, r["docs"][lo + k]), 0)
                seen += 1
                assert bound[i, k] >= s
    assert seen == 9 * 70


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 21])
def test_slices_miss_no_term(n):
    rng = np.random.default_rng(n)
    row = np.repeat(np.arange(n), 30)
    term = rng.integers(0, 1 << 63, 30 * n, dtype=np.uint64)
    width = bitslice.width_for(30)
    slices = bitslice.slice_terms(row, term, n, width)
    got = bitslice.may_hold(slices, width, n, bitslice.positions(term, width), 0, n)
    assert got[np.arange(len(term)), row].all()
    other = bitslice.may_hold(slices, width, n, bitslice.positions(rng.integers(0, 1 << 63, 500, dtype=np.uint64), width), 0, n)
    assert other.mean() < 0.05


def test_empty_tables_and_text_ids(spark, empty):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([("d2", "a"), ("d1", "a"), ("d3", None), ("d4", "c c")], "doc_id string, text string")
    assert bitslice.search_report(empty, items).count() == 0
    assert bitslice.search_report(docs, items.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)], SCHEMA)
    assert bitslice.search_report(nulls, items).count() == 0
    assert [(r.rank, r.doc_id) for r in bitslice.search_report(docs, items).orderBy("rank").collect()] == [(1, "d1"), (2, "d2")]

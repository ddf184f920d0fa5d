"""Near-duplicate and substring operators against plain Python versions."""

import numpy as np
import pytest

from shopframe.llm import linededup, simhash, substring, suffixes
from shopframe.llm.components import components
from tests.llm import brute
from tests.llm.conftest import SCHEMA, ordered, rows_of

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


PRINT = ("doc_id", "fingerprint", "component_id")


def test_simhash_odd(odd, rows):
    assert rows_of(simhash.near_duplicate_report(odd), *PRINT) == ordered(brute.simhash(rows))


def test_simhash_small(small):
    docs, rows = small
    assert rows_of(simhash.near_duplicate_report(docs), *PRINT) == ordered(brute.simhash(rows))


def test_simhash_empty(empty):
    assert simhash.near_duplicate_report(empty).count() == 0
    assert simhash.keep_one(empty).columns == empty.columns


def test_simhash_crowded_cells(spark):
    """Cells beyond the limit are cut into blocks and lose no link."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    f = {int(x) for x in base}
    for x in base:
        for _ in range(150):
            y = int(x)
            for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
                y ^= 1 << int(b)
            f.add(y)
    f = sorted(f)
    prints = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in f], "f long").repartition(4)
    found = {}
    for limit in (4096, 20):
        edges = simhash.links(prints, cell_limit=limit)
        pairs = [(int(np.int64(r.a).view(np.uint64)), int(np.int64(r.b).view(np.uint64))) for r in edges.collect()]
        assert all(bin(a ^ b).count("1") <= 4 for a, b in pairs)
        place = {x: i for i, x in enumerate(f)}
        found[limit] = brute.classes(len(f), [(place[a], place[b]) for a, b in pairs])
    want = brute.classes(len(f), [(i, j) for i in range(len(f)) for j in range(i) if bin(f[i] ^ f[j]).count("1") <= 4])
    assert found[4096] == want and found[20] == want


def test_embedding_is_a_lower_bound():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    low = np.bitwise_count(simhash.embed(a) ^ simhash.embed(b))
    assert (low <= np.bitwise_count(a ^ b)).all()
    x, y = int(a[0]), int(b[0])
    count = [[(v >> 2 * s & 1) + (v >> 2 * s + 1 & 1) for s in range(32)] for v in (x, y)]
    assert low[0] == sum(abs(p - q) for p, q in zip(*count))


def test_keep_one(odd, rows):
    got = [r.doc_id for r in simhash.keep_one(odd).collect()]
    want = [c for c in {c for _, _, c in brute.simhash(rows)}]
    assert ordered([(x,) for x in got]) == ordered([(x,) for x in want])


def test_components(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7), (900, 905), (905, 901)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500, 900: 900, 901: 900, 905: 900}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


CUT = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_substring_odd(odd, rows):
    assert rows_of(substring.substring_report(odd), *CUT) == ordered(brute.substrings(rows))


def test_substring_small_and_text(small):
    docs, rows = small
    got = substring.remove_repeats(docs)
    assert rows_of(got, *CUT) == ordered(brute.substrings(rows))
    assert all(brute.sha(r.kept.encode()) == r.kept_sha256 for r in got.collect())


def test_substring_hot_passage(spark):
    """Many tasks, one passage and one text in a third of all rows."""
    rng = np.random.default_rng(2)
    shared = " ".join(f"s{i}" for i in range(45))
    rows = [(i, (" ".join(f"v{rng.integers(0, 60)}" for _ in range(rng.integers(0, 90))) + " " + shared) if i % 3 else shared)
            for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert rows_of(substring.substring_report(docs), *CUT) == ordered(brute.substrings(rows))


SPANS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_odd(odd, rows):
    assert rows_of(suffixes.suffix_report(odd), *SPANS) == ordered(brute.spans(rows))


def test_suffix_small(small):
    docs, rows = small
    assert rows_of(suffixes.suffix_report(docs), *SPANS) == ordered(brute.spans(rows))


def test_suffix_dense_overlaps(spark):
    """A tiny alphabet: every leading string is shared, contexts differ."""
    rng = np.random.default_rng(4)
    base = "".join(rng.choice(list("ab"), 400))
    rows = []
    for i in range(60):
        a = int(rng.integers(0, 300))
        rows.append((int(rng.integers(0, 40)), base[a:a + int(rng.integers(0, 200))] + "".join(rng.choice(list("abc"), 40))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert rows_of(suffixes.suffix_report(docs), *SPANS) == ordered(brute.spans(rows))


def test_multikey_sort():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, (500, 5)).astype(np.uint64)
    order, differs = suffixes.multikey_sort(x)
    got = x[order].tolist()
    assert got == sorted(x.tolist())
    for a, b, d in zip(got, got[1:], differs[1:]):
        assert next((j for j in range(5) if a[j] != b[j]), 5) == d


LINES = ("doc_id", "n_lines", "n_removed", "kept_sha256")


def test_lines_odd(odd, rows):
    assert rows_of(linededup.line_report(odd), *LINES) == ordered(brute.lines(rows))


def test_lines_small(small):
    docs, rows = small
    assert rows_of(linededup.line_report(docs), *LINES) == ordered(brute.lines(rows))


def test_lines_blocks(spark, monkeypatch):
    """Buckets beyond the limit are searched block by block, with the same result."""
    base = "a rather long line of text that many documents carry with some small change in it "
    rows = [(i, f"{base}{i}\n{base}{i % 7} and more") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = ordered(brute.lines(rows))
    assert rows_of(linededup.line_report(docs), *LINES) == want
    monkeypatch.setattr(linededup, "LIMIT", 5)
    assert rows_of(linededup.line_report(docs), *LINES) == want


@pytest.mark.parametrize("report", [substring.substring_report, suffixes.suffix_report, linededup.line_report])
def test_empty_tables(empty, report):
    assert report(empty).count() == 0


@pytest.mark.parametrize("report", [substring.substring_report, suffixes.suffix_report, linededup.line_report,
                                    simhash.near_duplicate_report])
def test_only_nulls(spark, report):
    docs = spark.createDataFrame([(None, None, None, None, None)] * 3, SCHEMA)
    assert report(docs).count() == 3

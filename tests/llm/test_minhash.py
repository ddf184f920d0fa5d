"""One-permutation MinHash near-duplicates against all pairs compared."""

import random

import numpy as np
import pytest

from shopframe.llm import crowds, minhash
from shopframe.llm.textcore import chunks
from tests.llm.brute import LOWER, WS, classes, raw
from tests.llm.conftest import SCHEMA, ordered, rows_of, words

import pyarrow as pa

COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def shingle_set(text, width=3):
    w = WS.findall(raw(text).translate(LOWER))
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, percent=85):
    sets = [shingle_set(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root, least = classes(len(rows), pairs), {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return ordered([(d, len(s), least.get(r) if s else d, d == (least.get(r) if s else d))
                    for (d, _), s, r in zip(rows, sets, root)])


def near_copies(rng, n, changes, base=None, size=120):
    """``n`` texts made from one by changing a few words each."""
    base = base or words(rng, size, 10**6).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(*changes)):
            w[rng.randrange(len(w))] = f"c{rng.randrange(10**9)}"
        out.append(" ".join(w))
    return [" ".join(base)] + out


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def test_odd_rows(odd, rows):
    assert rows_of(minhash.near_duplicate_report(odd), *COLUMNS) == brute(rows)


def test_small_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(minhash.near_duplicate_report(docs), *COLUMNS) == brute(rows)


@pytest.mark.parametrize("limit", [1000, 7])
def test_groups_that_avoid_the_hub(spark, limit):
    """Copies that differ from one another more than from their base, chains,
    and unlinked texts of one template, in whole buckets and in parts."""
    rng = random.Random(9)
    texts = near_copies(rng, 60, (1, 5)) + near_copies(rng, 50, (4, 8))
    chain = words(rng, 100, 10**6).split()
    for _ in range(25):
        chain = chain[2:] + [f"n{rng.randrange(10**9)}" for _ in range(2)]
        texts.append(" ".join(chain))
    form = words(rng, 60, 10**6)
    texts += [form + " " + words(rng, 12, 10**6) for _ in range(40)]
    texts += [" ".join(f"s{rng.randrange(40)}" for _ in range(rng.randint(1, 9))) for _ in range(80)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = minhash.near_duplicates(frame(spark, rows), limit=limit)
    want = [(d, n, c) for d, n, c, _ in brute(rows)]
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == want


def test_threshold_is_exact(spark):
    """17 of 20 shingles shared links, one less does not."""
    a = [f"a{i}" for i in range(20)]
    rows = []
    for k, n in enumerate((17, 16)):
        w = [f"{x}g{k}" for x in a]
        rows += [(2 * k, " ".join(w[:n + 2])), (2 * k + 1, " ".join(w[:20] + [f"z{k}", f"y{k}"]))]
    want = brute(rows)
    assert rows_of(minhash.near_duplicate_report(frame(spark, rows)), *COLUMNS) == want
    assert [r[2] for r in want] == [0, 0, 2, 3]


def test_large_group_makes_few_pairs(spark, monkeypatch):
    """A hot group of near copies is a star: pairs grow with its size."""
    rng = random.Random(4)
    rows = list(enumerate(near_copies(rng, 1200, (0, 2), size=80) + [words(rng, 60, 10**6) for _ in range(300)]))
    found = []
    real = minhash.star_links
    monkeypatch.setattr(minhash, "STAR", 50)
    monkeypatch.setattr(minhash, "star_links", lambda pairs, *a: found.append(pairs.count()) or real(pairs, *a))
    got = rows_of(minhash.near_duplicate_report(frame(spark, rows, 12)), *COLUMNS)
    assert {r[2] for r in got if r[0] <= 1200} == {0} and all(r[3] for r in got if r[0] > 1200)
    assert found[0] < 32 * 1200


def test_crowd_rows_are_linear_beside_a_large_component(spark):
    """10,000 nodes of one component and 30 others: each large part meets the
    others once."""
    members = spark.range(10_030).selectExpr("7L as key", "cast(cast(id as string) as binary) as node",
                                             "cast(case when id < 10000 then 'm' else cast(id as string) end as binary) as comp")
    rows = crowds.crowd_rows(members, 1000)
    assert rows.count() == 10_000 + 30 * 11


def test_densified_bins_agree_as_often_as_sets():
    rng = np.random.default_rng(2)
    hits = []
    for n in (3, 12, 60, 400):
        for _ in range(30):
            x = rng.integers(0, 1 << 63, n + n // 4, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            a, b = np.sort(x[:n]), np.sort(x[n // 4:])
            sig = minhash.signatures(np.array([0, n, 2 * n]), np.concatenate([a, b]))
            assert (sig != minhash.EMPTY).all()
            hits.append((sig[0] == sig[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(hits)) < 0.02


def test_shingles_of_short_and_shifted_rows():
    texts = ["a b c d", "a b", "b a", "a", "", "A  b\tc d", "a b c d a b c d", "ab"]
    batch = pa.array(texts)
    (c,) = chunks(batch)
    first, h = minhash.shingles(c)
    sets = [set(h[a:b].tolist()) for a, b in zip(first, first[1:])]
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    assert sets[0] == sets[5] and sets[0] < sets[6] and sets[1] != sets[2] and len(set.union(*sets)) == 2 + 1 + 1 + 1 + 1 + 2


@pytest.mark.parametrize("n", [0, 3])
def test_empty_and_only_nulls(spark, n):
    docs = spark.createDataFrame([(None, None, None, None, None)] * n, SCHEMA)
    got = minhash.near_duplicate_report(docs).collect()
    assert [tuple(r) for r in got] == [(None, 0, None, True)] * n

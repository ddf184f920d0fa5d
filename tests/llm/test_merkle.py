"""Merkle manifest against a plain Python tree."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from shopframe.llm import merkle
from tests.llm.brute import LOWER
from tests.llm.conftest import SCHEMA, ordered, rows_of


def sha(*parts):
    return hashlib.sha256(b"".join(p if isinstance(p, bytes) else p.encode() for p in parts)).hexdigest()


def leaf_of(row):
    out = []
    for v in row:
        b = None if v is None else str(v).encode()
        out.append(b"-" if b is None else b"%d:" % len(b) + b)
    return sha(*out)


def climb(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha(*now[i:i + fanout]) for i in range(0, len(now), fanout)])
    return levels


def siblings(levels, i, fanout):
    """(left, right) of each level."""
    out = []
    for now in levels[:-1]:
        lo = i - i % fanout
        out.append((now[lo:i], now[i + 1:lo + fanout]))
        i //= fanout
    return out


def brute(rows, fanout=16):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0], leaf_of(r)))
        trees[s] = (own, climb([leaf_of(r) for r in own], fanout))
    top = climb([trees[s][1][-1][0] for s in sources], fanout)
    out = []
    for k, s in enumerate(sources):
        own, levels = trees[s]
        for i, r in enumerate(own):
            path = siblings(levels, i, fanout) + siblings(top, k, fanout)
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = text.encode().translate(LOWER).decode()
            fold = leaf_of((*r[:4], text))
            for left, right in path:
                fold = sha(*left, fold, *right)
            out.append((r[0], levels[0][i], levels[-1][0], top[-1][0], sha(*[x for p in path for side in p for x in side]),
                        fold, fold == top[-1][0]))
    return ordered(out)


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def test_odd_rows(odd):
    rows = [tuple(r) for r in odd.select(*FIELDS).collect()]
    assert rows_of(merkle.manifest_report(odd), *COLUMNS) == brute(rows)


@pytest.mark.parametrize("fanout, levels", [(2, 2), (3, 1), (16, 1)])
def test_deep_trees(spark, fanout, levels):
    """Many blocks and levels, a hot source, sources of one row, repeated rows."""
    rows = [(i % 90, "hot" if i % 3 else f"s{i % 30}", "en", i % 7, f"Text {i % 90} A{i % 4}") for i in range(240)]
    rows += [(1, None, None, None, None), (1, None, None, None, None), (None, "é", "x", 1, ""), (None, "z", "x", 1, "B")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    picked = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    placed = merkle.leaves(docs, changed={"text": F.lower("text")}, where=picked)
    got = rows_of(merkle.prove(placed, fanout, levels), *COLUMNS)
    assert got == brute(rows, fanout)
    assert {r[6] for r in got} == {True, False}


def test_subtree_resumes_states():
    nodes = [sha(str(i)).encode() for i in range(37)]
    tree = merkle.Subtree(nodes, 4, merkle.natural_depth(37, 4))
    want = climb([n.decode() for n in nodes], 4)
    assert tree.root.decode() == want[-1][0]
    for i in (0, 5, 36):
        changed = [n.decode() for n in nodes]
        changed[i] = sha("other")
        assert tree.fold(i, changed[i].encode()).decode() == climb(changed, 4)[-1][0]


def test_manifest_lists_sources(odd):
    got = {r.source: (r.n_leaves, r.subroot, r.root) for r in merkle.manifest(odd).collect()}
    rows = odd.select(*FIELDS).collect()
    assert {s: n for s, (n, _, _) in got.items()} == {s: sum(r.source == s for r in rows) for s in {r.source for r in rows}}
    report = merkle.manifest_report(odd).select("subroot", "root").distinct().collect()
    assert {r.subroot for r in report} == {v[1] for v in got.values()} and {r.root for r in report} == {v[2] for v in got.values()}


def test_text_ids_empty_and_single(spark, empty):
    assert merkle.manifest_report(empty).count() == 0
    one = spark.createDataFrame([(3, "T", "en", "s", 1)], SCHEMA)
    (r,) = merkle.manifest_report(one).collect()
    assert r.leaf == r.subroot == r.root and r.proof_sha256 == sha("")
    named = spark.createDataFrame([("b", "x", None, "s", 1), ("a", "y", None, "s", 1)], SCHEMA.replace("doc_id long", "doc_id string"))
    assert [r.doc_id for r in merkle.manifest_report(named).orderBy("doc_id").collect()] == ["a", "b"]

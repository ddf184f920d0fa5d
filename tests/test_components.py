"""Components of edge tables against union-find, and their number of rounds."""

import random
from collections import Counter

import pytest

from shopframe.operators import components as CO

EDGES = {"none": [], "star": [(0, i) for i in range(1, 9)], "loops": [(3, 3), (4, 5), (5, 5)], "chain": [(i, i + 1) for i in range(40)],
         "centre in the middle": [(5, i) for i in range(12)],
         "random": [(random.Random(i).randrange(90), random.Random(-i - 1).randrange(90)) for i in range(70)]}


def expected(edges):
    u = CO.Union()
    for a, b in edges:
        u.join(a, b)
    root = {k: u.find(k) for k in u.up}
    size = Counter(root.values())
    return {k: v for k, v in root.items() if size[v] > 1}


@pytest.mark.parametrize("name", EDGES)
def test_components_equal_union_find(spark, name):
    df = spark.createDataFrame([((a,), (b,)) for a, b in EDGES[name]], "a struct<x:long>, b struct<x:long>")
    got = [(r.node.x, r.component.x) for r in CO.components(df).collect()]
    assert len(got) == len(set(got)) and dict(got) == expected(EDGES[name])


def test_stars_take_no_round(spark, monkeypatch):
    """The edges and one table of minima are written, nothing else."""
    written, real = [], CO.materialize
    monkeypatch.setattr(CO, "materialize", lambda df: written.append(df.columns) or real(df))
    df = spark.createDataFrame([((a,), (b,)) for a, b in EDGES["star"]], "a struct<x:long>, b struct<x:long>")
    assert CO.components(df).count() == 9
    assert len(written) == 2

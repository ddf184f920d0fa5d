"""Connected components of an edge table.

1. Every task joins the edges it holds by union-find and passes on a star for
   each component it sees, so repeated and redundant edges end where they are
   (edges of structs are only made distinct).
2. Stars of at most ``small`` edges (counted) are joined in one task.
3. More than that alternate two steps until all edges are stars, which the
   first step's minima and maxima show. Large star: every
   node links its larger neighbours to its smallest neighbour (or itself).
   Small star: every node links its smaller neighbours and itself to the
   smallest of them. Trees flatten into stars whose centre is the component's
   smallest node, in a number of rounds that grows with the logarithm of the
   component's size. The grouped minima are written before they are joined:
   a join of two written sides can be split where a centre is skewed.

Every round cuts its lineage with a checkpoint in the shared folder.
"""

from __future__ import annotations

import sys as _sys

import pyarrow as pa
from pyspark import cloudpickle as _cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

LOCAL_EDGES = 200_000       # edges a task holds at once
FEW_EDGES = 50_000          # a ``small`` for callers: below it, rounds cost more than the one task


def _key(value):
    return tuple(value.values()) if isinstance(value, dict) else value


class Union:
    """Union-find whose roots are the smallest members."""

    def __init__(self):
        self.up, self.value = {}, {}

    def find(self, k):
        root = k
        while self.up[root] != root:
            root = self.up[root]
        while self.up[k] != root:
            self.up[k], k = root, self.up[k]
        return root

    def join(self, a, b):
        ends = []
        for v in (a, b):
            k = _key(v)
            if k not in self.up:
                self.up[k], self.value[k] = k, v
            ends.append(self.find(k))
        low, high = sorted(ends)
        self.up[high] = low

    def stars(self):
        """(node, root) of every node that is not a root."""
        return [(self.value[k], self.value[self.find(k)]) for k in self.up if self.up[k] != k]


def _contract(whole: bool):
    """Edges to stars; ``whole`` holds all edges of the task, else some."""
    def emit(seen, kinds):
        found = seen.stars()
        for lo in range(0, len(found), 50_000):
            part = found[lo:lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in part], kinds[k]) for k in (0, 1)], names=["u", "v"])

    def task(batches):
        seen, n, kinds = Union(), 0, None
        for batch in batches:
            kinds = kinds or [batch.schema.field(i).type for i in (0, 1)]
            for a, b in zip(*[c.to_pylist() for c in batch.columns]):
                seen.join(a, b)
            n += batch.num_rows
            if n >= LOCAL_EDGES and not whole:
                yield from emit(seen, kinds)
                seen, n = Union(), 0
        if n:
            yield from emit(seen, kinds)
    return task


def _both(e: DataFrame) -> DataFrame:
    return e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, small: int = 0) -> DataFrame:
    """``edges``: columns a, b of one comparable type (any direction, repeats
    and loops allowed; rows with a null end are no edges). Returns (node,
    component) for every node that has an edge to another one, component being
    its smallest reachable node."""
    kind = edges.schema["a"].dataType.simpleString()
    schema = f"u {kind}, v {kind}"
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    if not kind.startswith("struct"):       # rows of structs are costly to hand to Python
        e = e.mapInArrow(_contract(False), schema)
    e = materialize(e.distinct())
    if small and e.count() <= small:
        e = materialize(e.repartition(1).mapInArrow(_contract(True), schema))
        return _stars(e)
    while True:
        both = _both(e)
        # Done when every node that has a smaller neighbour has no other one.
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x")).select(
            "u", "m", F.expr("m < u AND m <> x").alias("open")))
        if low.where("open").isEmpty():
            return _stars(e)
        large = materialize(both.join(low.select("u", "m"), "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"), F.col("u").alias("c"))
                            .where("u > c AND u <> v").select("u", "v").distinct())
        stars = materialize(large.groupBy("u").agg(F.min("v").alias("m")))
        e = materialize(large.join(stars, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                        .unionAll(stars.select("u", F.col("m").alias("v"))).where("u <> v").distinct())


def _stars(e: DataFrame) -> DataFrame:
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


# Task functions are pickled by value: executors need pyarrow, not this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

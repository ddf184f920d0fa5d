"""SimHash near-duplicates by segment popcounts.

A text (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``) gives the XXH64 hashes
(seed 42) of its ``shingle``-word runs; bit i of its 64-bit fingerprint is set
where more than half of them have it. Fingerprints link at ``distance`` or
fewer differing bits, and linked texts form components.

Candidate search: a fingerprint is embedded as the vector of its bit counts
over 32 segments of two bits. The Manhattan distance of two such vectors never
exceeds the Hamming distance, so links lie within Manhattan ``distance``. The
grid range-join works on this vector: its 32 coordinates form ``BLOCKS`` blocks,
a vector within Manhattan distance d of another differs in at most d blocks,
and so the two fall into one grid cell for at least one choice of
``BLOCKS - d`` blocks. Each fingerprint goes to the cells of all choices; within
a cell the Manhattan bound is tested first (in unary code it is one XOR and one
bit count) and the fingerprints are then verified exactly.

Within a cell only a spanning forest of its links is emitted, found by a search
that drops every fingerprint once reached, so a group of thousands of close
copies costs about its size, not its square, in rows. A cell of more than
``CELL`` fingerprints is searched in parts that are then joined
(``crowds.join_parts``). Exact copies meet only once: the search runs on
distinct fingerprints.

Edge cases: a text without words (null, empty, blank) has fingerprint 0 and is
linked like any other; fewer words than ``shingle`` give one shingle of all
words; repeated rows share their class; rows of null id take part, their class
is the smallest id present or null; an empty table gives no row; extra columns
are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import LongType, StructField

from .common import map_whole_rows, materialize, numbered, shuffle_partitions
from .components import components
from .crowds import join_parts, part_of
from .textcore import chunks, mix

SHINGLE = 4
DISTANCE = 4
BLOCKS = 8
CELL = 4096
SEED = 42
_LOW = np.uint64(0x5555555555555555)


def fingerprint(texts: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints (uint64) of UTF-8 texts."""
    digest, hashes, count = xxhash.xxh64_intdigest, [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = text.lower().split()
        n = len(words)
        if n == 0:
            continue
        joined = b" ".join(words)
        if n <= shingle:
            hashes.append(digest(joined, SEED))
            count[i] = 1
            continue
        end = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        start = np.append(0, end[:-1] + 1)
        m = n - shingle + 1
        hashes.extend([digest(joined[a:b], SEED) for a, b in zip(start[:m].tolist(), end[shingle - 1:].tolist())])
        count[i] = m
    out = np.zeros(len(texts), dtype=np.uint64)
    some = np.flatnonzero(count)
    if len(some) == 0:
        return out
    h = np.array(hashes, dtype=np.uint64)
    first = np.cumsum(count[some]) - count[some]
    ones = np.zeros((len(some), 64), dtype=np.int64)
    # Count the set bits of each text's hashes, a bounded block of texts a time.
    lo = 0
    while lo < len(some):
        hi = max(lo + 1, int(np.searchsorted(first, first[lo] + 100_000)))
        a, b = first[lo], first[hi] if hi < len(some) else len(h)
        bits = np.unpackbits(h[a:b].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[lo:hi] = np.add.reduceat(bits, first[lo:hi] - a, axis=0, dtype=np.int32)
        lo = hi
    set_ = 2 * ones > count[some][:, None]
    out[some] = np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def embed(f: np.ndarray) -> np.ndarray:
    """Bit counts of the 32 two-bit segments, each in unary code, so that the
    Manhattan distance of two vectors is the bit count of their XOR."""
    high = (f >> np.uint64(1)) & _LOW
    low = f & _LOW
    return (low | high) | ((low & high) << np.uint64(1))


def cell_masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """One mask per choice of blocks - distance blocks (64 // blocks bits each)."""
    width = 64 // blocks
    unit = (1 << width) - 1
    return [sum(unit << (width * b) for b in pick) for pick in combinations(range(blocks), blocks - distance)]


def spanning(f: np.ndarray, distance: int, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``f`` (or of those between ``f``
    and ``other``), as two arrays of end points."""
    a, b = [], []
    if other is None:
        rest, u = f, embed(f)
        while len(rest) > 1:
            todo, rest, u = [rest[0]], rest[1:], u[1:]
            while todo and len(rest):
                x = todo.pop()
                ex = embed(np.array([x], dtype=np.uint64))[0]
                near = np.bitwise_count(u ^ ex) <= distance                    # lower bound
                near &= np.bitwise_count(rest ^ x) <= distance                 # exact
                if near.any():
                    got = rest[near]
                    a.append(np.full(len(got), x))
                    b.append(got)
                    todo.extend(got)
                    rest, u = rest[~near], u[~near]
    else:
        free = [f, other]
        code = [embed(f), embed(other)]
        while len(free[0]) and len(free[1]):
            todo = [(0, free[0][0])]
            free[0], code[0] = free[0][1:], code[0][1:]
            while todo:
                s, x = todo.pop()
                ex = embed(np.array([x], dtype=np.uint64))[0]
                near = np.bitwise_count(code[1 - s] ^ ex) <= distance
                near &= np.bitwise_count(free[1 - s] ^ x) <= distance
                if near.any():
                    got = free[1 - s][near]
                    a.append(np.full(len(got), x))
                    b.append(got)
                    todo.extend((1 - s, y) for y in got)
                    free[1 - s], code[1 - s] = free[1 - s][~near], code[1 - s][~near]
    z = np.zeros(0, dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (z, z)


def _cells(masks: list[int]):
    salt = [(np.uint64(m), np.uint64((k + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) for k, m in enumerate(masks)]

    def task(batches):
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            u = embed(f)
            for m, k in salt:
                cell = mix((u & m) ^ k)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), batch.column(0)], names=["cell", "f"])
    return task


def _links(distance: int, limit: int):
    """Rows sorted by cell: spanning links of each cell (kind 0); the members
    of a cell beyond ``limit`` are passed on (kind 1)."""
    def rows(kind, x, y):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind, np.int32)), pa.array(x.view(np.int64)),
                                           pa.array(y.view(np.int64))], names=["kind", "a", "b"])

    def done(cell, f):
        """Whole cells, sorted."""
        start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        size = np.diff(np.append(start, len(cell)))
        two = start[size == 2]
        x, y = f[two], f[two + 1]
        near = np.bitwise_count(embed(x) ^ embed(y)) <= distance
        near &= np.bitwise_count(x ^ y) <= distance
        a, b = [x[near]], [y[near]]
        for s, n in zip(start[(size > 2) & (size <= limit)], size[(size > 2) & (size <= limit)]):
            p, q = spanning(f[s:s + n], distance)
            a.append(p)
            b.append(q)
        a, b = np.concatenate(a), np.concatenate(b)
        pair = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0)
        if len(pair):
            yield rows(0, np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1]))

    def task(batches):
        hold_c, hold_f, open_ = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for batch in batches:
            cell = np.concatenate([hold_c, batch.column(0).to_numpy(zero_copy_only=False)])
            f = np.concatenate([hold_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
            if len(cell) == 0:
                continue
            if open_ is not None:                    # a cell that is passed on
                n = int(np.searchsorted(cell, open_, side="right"))
                if n:
                    yield rows(1, cell[:n].view(np.uint64), f[:n])
                cell, f = cell[n:], f[n:]
                if len(cell) == 0:
                    hold_c, hold_f = cell, f
                    continue
                open_ = None
            last = int(np.searchsorted(cell, cell[-1], side="left"))
            yield from _split(cell[:last], f[:last])
            hold_c, hold_f = cell[last:], f[last:]
            if len(hold_c) > limit:
                open_ = hold_c[0]
                yield rows(1, hold_c.view(np.uint64), hold_f)
                hold_c, hold_f = hold_c[:0], hold_f[:0]
        yield from _split(hold_c, hold_f)

    def _split(cell, f):
        """A cell beyond the limit inside the sorted rows is passed on too."""
        if len(cell) == 0:
            return
        start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        size = np.repeat(np.diff(np.append(start, len(cell))), np.diff(np.append(start, len(cell))))
        if (size > limit).any():
            yield rows(1, cell[size > limit].view(np.uint64), f[size > limit])
        yield from done(cell[size <= limit], f[size <= limit])
    return task


def _block_links(distance: int):
    """Rows (cell, i, j, block, f) sorted by (cell, i, j): links within block i
    (i = j) or between blocks i and j."""
    def flush(key, parts):
        if key is None:
            return
        block = np.concatenate([p[0] for p in parts])
        f = np.concatenate([p[1] for p in parts])
        _, i, j = key
        a, b = spanning(f, distance) if i == j else spanning(f[block == i], distance, f[block == j])
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def task(batches):
        key, parts = None, []
        for batch in batches:
            c, i, j, k, f = (batch.column(x).to_numpy(zero_copy_only=False) for x in range(5))
            if len(c) == 0:
                continue
            cut = np.flatnonzero((c[1:] != c[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for lo, hi in zip(np.append(0, cut), np.append(cut, len(c))):
                now = (c[lo], i[lo], j[lo])
                if now != key:
                    yield from flush(key, parts)
                    key, parts = now, []
                parts.append((k[lo:hi].copy(), f[lo:hi].view(np.uint64).copy()))
        yield from flush(key, parts)
    return task


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, cell_limit: int = CELL) -> DataFrame:
    """``prints``: one column f of distinct fingerprints (signed longs).
    Returns links (a, b) that connect whatever links connect."""
    if not 0 <= distance < blocks or 64 % blocks:
        raise ValueError("needs distance < blocks, and blocks that divide 64")
    cells = prints.select("f").mapInArrow(_cells(cell_masks(distance, blocks)), "cell long, f long")
    found = materialize(cells.repartition(shuffle_partitions(prints.sparkSession), "cell").sortWithinPartitions("cell", "f")
                        .mapInArrow(_links(distance, cell_limit), "kind int, a long, b long"))
    near = found.where("kind = 0").select("a", "b")
    crowd = found.where("kind = 1").select(F.col("a").alias("cell"), F.col("b").alias("f"))
    if not crowd.isEmpty():
        limit, partitions = max(1, cell_limit // 2), shuffle_partitions(prints.sparkSession)

        def verify(rows):
            rows = rows.select(F.col("key").alias("cell"), "i", "j", "side", F.col("node").alias("f"))
            return (rows.repartition(partitions, "cell", "i", "j").sortWithinPartitions("cell", "i", "j")
                    .mapInArrow(_block_links(distance), "a long, b long"))

        members = crowd.select(F.col("cell").alias("key"), F.col("f").alias("node"))
        sizes = materialize(members.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(limit)).cast("int").alias("n")))
        first = members.join(sizes, "key").withColumn("i", part_of("node", "key", F.col("n")))
        near = near.unionByName(materialize(verify(first.select("key", "i", F.col("i").alias("j"), F.col("i").alias("side"), "node"))))
        near = near.unionByName(join_parts(members, near, verify, limit))
    return near


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, f): fingerprints as signed longs."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def task(batches):
        for batch in batches:
            for c in chunks(batch.column(1), max_rows=4096):
                f = fingerprint([c.text(i) for i in range(c.n)], shingle)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.lo, c.n), pa.array(f.view(np.int64))],
                                                 names=["doc_id", "f"])

    return d.mapInArrow(task, f"doc_id {docs.schema[id_col].dataType.simpleString()}, f long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, f, component_id (the smallest doc_id reachable) and class (a
    fingerprint that names the component) per row."""
    prints = materialize(fingerprints(docs, shingle, id_col, text_col))
    distinct = materialize(prints.groupBy("f").agg(F.min("doc_id").alias("least")))
    comp = components(links(distinct, distance))
    classed = distinct.join(comp.withColumnRenamed("node", "f"), "f", "left").select(
        "f", "least", F.coalesce("component", "f").alias("class"))
    least = classed.groupBy("class").agg(F.min("least").alias("component_id"))
    named = classed.join(least, "class").select("f", "component_id", "class")
    return prints.join(named, "f").select("doc_id", "f", "component_id", "class")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class: that of the smallest id, null
    last, and of the smallest fingerprint among equal ids. Rows equal in both
    count as one document."""
    found = near_duplicates(docs, shingle, distance, id_col, text_col)
    chosen = found.groupBy("class").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("no_id"), "doc_id", "f")).alias("r"))
    chosen = chosen.select(F.col("r.doc_id").alias("_keep"), F.col("r.f").alias("_keep_f"))
    names, at = docs.columns, docs.columns.index(text_col)
    docs, place = numbered(docs)

    def task(batches):
        for batch in batches:
            f = [fingerprint([c.text(i) for i in range(c.n)], shingle) for c in chunks(batch.column(at), max_rows=4096)]
            f = np.concatenate([np.zeros(0, np.uint64), *f])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(f.view(np.int64))],
                                             names=[*batch.schema.names, "_f"])

    left = map_whole_rows(docs, task, [StructField("_f", LongType())])
    left = left.join(chosen, F.col(place[id_col]).eqNullSafe(F.col("_keep")) & (F.col("_f") == F.col("_keep_f")),
                     "left_semi")
    return left.dropDuplicates([place[id_col], "_f"]).drop("_f").toDF(*names)

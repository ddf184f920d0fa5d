"""Shuffling very many (hash, document, position) postings compactly.

A map task gathers the postings of several chunks of text, deals them to
buckets by the leading bits of their hash and packs each bucket's share into
one binary value: the documents met, how many postings each has, then the
remaining hash bits and the positions as arrays. One row thus carries hundreds
or thousands of postings. ``bucket_count`` grows with the text, so a bucket's
postings fit a task whatever the input; buckets are dealt to partitions by
Spark, and ``by_bucket`` walks a partition sorted by bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textcore import chunks, mix, tidy

BUCKET_BYTES = 4 << 20      # text per bucket
GATHER = 500_000            # postings a map task packs at once
NO_ID = (1 << 63) - 1       # stands for a null id: behind all others


def bucket_count(docs: DataFrame, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> int:
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")).cast("long")).alias("b")).first().b or 0
    return int(total // bucket_bytes) + 1


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each 64-bit hash: monotone in its leading 32 bits."""
    return ((key >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def pack(bucket, doc, ids, arrays):
    """Rows (bucket, blob) of postings in document order: ``doc`` indexes the
    table ``ids`` (n_docs, m) of 64-bit ids, ``arrays`` are per posting. The
    last array ascends within a document and is stored as its steps."""
    order = np.argsort(bucket, kind="stable")
    bucket, doc = bucket[order], doc[order]
    arrays = [np.ascontiguousarray(a[order]) for a in arrays]
    step = arrays[-1].copy()
    if len(step):
        same = (bucket[1:] == bucket[:-1]) & (doc[1:] == doc[:-1])
        step[1:][same] -= arrays[-1][:-1][same]
    arrays[-1] = step
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    for lo, hi in zip(cut, np.append(cut[1:], len(bucket)) if len(bucket) else []):
        d = doc[lo:hi]                     # runs of one document
        first = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        n = np.diff(np.append(first, hi - lo)).astype(np.uint32)
        head = np.array([len(first), hi - lo], dtype=np.uint32)
        yield int(bucket[lo]), b"".join([head.tobytes(), n.tobytes(), ids[d[first]].T.tobytes(),
                                         *[planes(a[lo:hi]) for a in arrays]])


def planes(a: np.ndarray) -> bytes:
    """Bytes of an array, lowest bytes first, then the next, ...: the mostly
    zero upper bytes of small numbers then compress away in the shuffle."""
    return a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes()


def unpack(blob: bytes, n_ids: int, kinds):
    """(ids per posting (m arrays), arrays) of a packed value."""
    buf = memoryview(blob)
    docs, size = np.frombuffer(buf, np.uint32, 2)
    docs, size = int(docs), int(size)
    n = np.frombuffer(buf, np.uint32, docs, 8)
    at = 8 + 4 * docs
    ids = []
    for _ in range(n_ids):
        ids.append(np.repeat(np.frombuffer(buf, np.int64, docs, at), n))
        at += 8 * docs
    out = []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        raw = np.frombuffer(buf, np.uint8, width * size, at).reshape(width, size)
        out.append(np.ascontiguousarray(raw.T).view(kind).ravel())
        at += width * size
    total = np.cumsum(out[-1].astype(np.int64))
    first = (np.cumsum(n.astype(np.int64)) - n)[: len(n)]
    base = np.where(first > 0, total[np.maximum(first - 1, 0)], 0)
    out[-1] = (total - np.repeat(base, n)).astype(kinds[-1])
    return ids, out


def pack_positions(p: np.ndarray) -> bytes:
    """Ascending positions as steps, lowest bytes first."""
    step = p.astype(np.uint32)
    step[1:] -= p[:-1].astype(np.uint32)
    return planes(step)


def unpack_positions(values: list[bytes]) -> np.ndarray:
    """All positions of a list of packed values."""
    out = [np.zeros(0, dtype=np.int64)]
    for v in values:
        raw = np.frombuffer(v, np.uint8).reshape(4, -1)
        out.append(np.cumsum(np.ascontiguousarray(raw.T).view(np.uint32).ravel().astype(np.int64)))
    return np.concatenate(out)


def pack_found(ids: list[np.ndarray], values: list[np.ndarray], buckets: int):
    """Rows (bucket, blob) of what was found in documents, dealt by document:
    ``ids`` identify it (the first deals), the last value ascends."""
    order = np.lexsort((*values, *ids[::-1]))
    ids, values = [a[order] for a in ids], [a[order] for a in values]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in ids])
    table = np.column_stack([a[new].astype(np.int64) for a in ids])
    doc = np.cumsum(new) - 1
    return pack(bucket_of(mix(ids[0].astype(np.int64).view(np.uint64)), buckets), doc, table, values)


class Found:
    """Gathers what the buckets of a partition found and gives it out packed by
    document bucket, so that rows don't multiply with hash buckets."""

    def __init__(self, n_ids: int, buckets: int):
        self.n_ids, self.buckets, self.parts, self.n = n_ids, buckets, [], 0

    def add(self, *arrays):
        self.parts.append(arrays)
        self.n += len(arrays[0])
        if self.n >= GATHER // 2:
            yield from self.flush()

    def flush(self):
        if self.n:
            arrays = gather(self.parts)
            rows = list(pack_found(arrays[:self.n_ids], arrays[self.n_ids:], self.buckets))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()),
                                              pa.array([v for _, v in rows], pa.binary())], names=["bucket", "data"])
        self.parts, self.n = [], 0


def by_document(found: DataFrame, n_ids: int, kinds, finish, schema: str) -> DataFrame:
    """Bring packed finds (bucket, data) together: ``finish`` turns the id and
    value arrays of a bucket of documents into a record batch."""
    def task(batches):
        for _, blobs in by_bucket(batches):
            parts = [unpack(b, n_ids, kinds) for b in blobs]
            yield finish(gather([p[0] for p in parts]), gather([p[1] for p in parts]))

    return found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(task), schema)


def gather(table: list[list]) -> list[np.ndarray]:
    """Column-wise concatenation of a list of array tuples."""
    return [np.concatenate(c) for c in zip(*table)]


def by_bucket(batches, blob_at: int = 1, pass_at: int | None = None):
    """Walk rows sorted by bucket (column 0): yields (bucket, [blobs]). Rows
    whose column ``pass_at`` is not null are yielded as (None, rows) instead."""
    current, blobs = None, []
    for batch in batches:
        if pass_at is not None:
            through = batch.column(pass_at).is_valid()
            if pc.any(through).as_py():
                yield None, batch.filter(through)
            batch = batch.filter(pc.invert(through))
        bucket = batch.column(0).to_pylist()
        blob = batch.column(blob_at)
        for i, b in enumerate(bucket):
            if b != current:
                if blobs:
                    yield current, blobs
                current, blobs = b, []
            blobs.append(blob[i].as_py())
    if blobs:
        yield current, blobs


def by_id(ids: list[np.ndarray], values: list[np.ndarray]):
    """Group rows by their ids: yields (ids..., arrays...)."""
    if len(ids[0]) == 0:
        return
    order = np.lexsort((*values[::-1], *ids[::-1]))
    ids, values = [a[order] for a in ids], [a[order] for a in values]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in ids])
    cut = np.flatnonzero(new)
    for lo, hi in zip(cut, np.append(cut[1:], len(order))):
        yield tuple(int(a[lo]) for a in ids), tuple(a[lo:hi] for a in values)


def shared_positions(docs: DataFrame, anchors, buckets: int) -> DataFrame:
    """Positions whose hash also occurs elsewhere: rows (id, packed positions).
    ``docs`` has (id, text); ``anchors(chunk)`` gives the (row, pos, hash,
    indexed, where) arrays of a chunk: all postings, which of them are index
    entries, and a hash of their content that deals them to buckets (equal
    postings have equal ones; where neighbours share it, their postings stay
    together). A hash counts as shared when it has two postings of which one is
    indexed, or two postings met by one map task (a superset, decided where it
    is seen: only one posting of each hash leaves the task, so a hash that very
    many documents share costs a posting per task).
    """
    def send(table, ids):
        doc, pos, key, indexed, where = gather(table)
        ids = np.concatenate(ids).reshape(-1, 1)
        order = np.argsort(key, kind="stable")
        k = key[order]
        first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
        any_indexed = np.logical_or.reduceat(indexed[order], first) if len(k) else np.zeros(0, bool)
        size = np.diff(np.append(first, len(k)))
        local = order[np.repeat(size > 1, size)]
        out_b, out_id, out_v = [], [], []
        for b, blob in pack_found([ids[doc[local], 0]], [pos[local].astype(np.uint32)], buckets):
            out_b.append(b)
            out_id.append(b)
            out_v.append(blob)
        rep = order[first]
        mark = np.zeros(len(key), dtype=bool)
        mark[rep] = any_indexed
        rep.sort()
        value = pos[rep].astype(np.uint32) * np.uint32(2) + mark[rep]
        for b, blob in pack(bucket_of(where[rep], buckets), doc[rep], ids,
                            [(key[rep] & np.uint64(0xFFFFFFFF)).astype(np.uint32), value]):
            out_b.append(b)
            out_id.append(None)
            out_v.append(blob)
        yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int32()), pa.array(out_id, pa.int32()),
                                          pa.array(out_v, pa.binary())], names=["bucket", "found", "data"])

    def collect(batches):
        table, ids, n, base = [], [], 0, 0
        for batch in batches:
            column = batch.column(0).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(1)):
                row, *rest = anchors(c)
                table.append((row + base, *rest))
                ids.append(column[c.lo:c.hi].astype(np.int64))
                base += c.n
                n += len(row)
                if n >= GATHER:
                    yield from send(table, ids)
                    table, ids, n, base = [], [], 0, 0
        if table:
            yield from send(table, ids)

    def reduce(batches):
        found = Found(1, buckets)
        for bucket, blobs in by_bucket(batches, 2, 1):
            if bucket is None:
                yield pa.RecordBatch.from_arrays([blobs.column(1), blobs.column(2)], names=["bucket", "data"])
                continue
            parts = [unpack(b, 1, (np.uint32, np.uint32)) for b in blobs]
            ids = np.concatenate([p[0][0] for p in parts])
            key = np.concatenate([p[1][0] for p in parts])
            value = np.concatenate([p[1][1] for p in parts])
            del parts
            order = np.argsort(key, kind="stable")
            k = key[order]
            first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            size = np.diff(np.append(first, len(k)))
            marked = np.logical_or.reduceat((value[order] & np.uint32(1)) > 0, first)
            hit = order[np.repeat((size > 1) & marked, size)]
            yield from found.add(ids[hit], value[hit] >> np.uint32(1))
        yield from found.flush()

    def finish(ids, values):
        rows = list(by_id(ids, values))
        return pa.RecordBatch.from_arrays([pa.array([i for (i,), _ in rows], pa.int64()),
                                           pa.array([pack_positions(p) for _, (p,) in rows], pa.binary())],
                                          names=["id", "pos"])

    sent = docs.mapInArrow(tidy(collect), "bucket int, found int, data binary")
    found = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(reduce), "bucket int, data binary")
    return by_document(found, 1, (np.uint32,), finish, "id long, pos binary")


def identified(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) with null ids behind all others and null texts empty."""
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def compressed(docs: DataFrame) -> DataFrame:
    """(id, z): the texts of (id, text) under Zstandard, for shuffles that
    only carry them."""
    def task(batches):
        pack_ = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for c in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.lo, c.n),
                     pa.array([pack_.compress(c.text(i)) for i in range(c.n)], pa.binary())], names=["id", "z"])

    return docs.mapInArrow(tidy(task), "id long, z binary")


def with_lists(docs: DataFrame, rows: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with the lists of ``rows``' columns per id (null: none)."""
    lists = rows.groupBy(F.col("id").alias("_id")).agg(*[F.collect_list(c).alias(c) for c in columns])
    return docs.join(lists, F.col("id") == F.col("_id"), "left").drop("_id")

"""Exact substring deduplication with fixed-block anchors.

Every document's words are cut into non-overlapping blocks of ``window // 2``
words: the index. All rolling windows of that many words, of every document,
probe the index. A repeat of ``window`` words always covers one whole block of
the earlier text, so each repeat has a probe that hits. Around the hits, each
candidate start is extended to its ``window`` words; equal extensions meet by
hash, all but the earliest are repeats, and overlapping repeats unite to
maximal runs of removed words.

Index and probes meet by a 32-bit hash within a bucket (a superset); extended
windows by 64 further, independent bits of their own besides the bucket. What
a map task sees twice is settled there, so passages that very many documents
share cost one posting per task and not one per document. The texts are
shuffled once, by document, and read from that shuffle twice.

"Earlier" is a smaller doc_id, or an earlier start in one document. Windows
are judged on the input, so a window counts although its earlier copy is
removed as well.

Edge cases: a null or empty text has no words; fewer words than ``window`` are
never removed; a null doc_id comes after all others; rows equal in id and text
are judged alike, each as if alone; rows equal in id only are ordered by a hash
of their text; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .postings import (GATHER, NO_ID, Found, bucket_count, bucket_of, by_bucket, by_document, by_id, gather, identified,
                       pack, pack_found, pack_positions, shared_positions, unpack, unpack_positions, with_lists)
from .textcore import (BASES, SPACE, Words, chunks, covered, mix, runs_of, sliding_min, some_rows, span_hash, text_hash,
                       tidy, whole_windows, window_hash)

WINDOW = 20


def probe(block: int):
    """All rolling windows of ``block`` words; those at multiples of ``block``
    are the index blocks."""
    def anchors(chunk):
        words = Words(chunk, SPACE)
        h = span_hash(chunk.data, words.start, words.end)
        key = window_hash(h, block)
        at = np.flatnonzero(whole_windows(words.first, block, len(key)))
        row = words.row()[at]
        pos = at - words.first[row]
        return row, pos, key[at], pos % block == 0, neighbourhood(h, block, max(1, block // 3))[at]
    return anchors


def neighbourhood(h: np.ndarray, width: int, part: int) -> np.ndarray:
    """A hash that equal windows of ``width`` words share, and most neighbours
    too: the least hash of the ``part``-word runs within the window."""
    return mix(sliding_min(window_hash(h, part), width - part + 1))


def _extend(window: int, block: int, buckets: int):
    """Rows (id, text, pos list): extended windows around the hits, packed by
    bucket; repeats within one task are passed on as found."""
    def send(table, ids):
        doc, pos, g1, g2, where = gather(table)
        ids = np.concatenate(ids)
        # Earliest first among equal windows: by id, text, position.
        order = np.lexsort((pos, ids[doc, 1], ids[doc, 0], g2, g1))
        same = np.zeros(len(order), dtype=bool)
        a, b = order[1:], order[:-1]
        same[1:] = (g1[a] == g1[b]) & (g2[a] == g2[b])
        # The same place met twice (repeated rows) is not a repeat.
        start = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        lead = order[start]
        repeat = same & ((ids[doc[order], 0] != ids[doc[lead], 0]) | (ids[doc[order], 1] != ids[doc[lead], 1])
                         | (pos[order] != pos[lead]))
        out = [[], [], []]
        flagged = order[repeat]
        for b, blob in pack_found([ids[doc[flagged], 0], ids[doc[flagged], 1]], [pos[flagged].astype(np.uint32)], buckets):
            for column, v in zip(out, (b, b, blob)):
                column.append(v)
        keep = np.sort(order[~same])
        for bucket, blob in pack(bucket_of(where[keep], buckets), doc[keep], ids,
                                 [g2[keep], pos[keep].astype(np.uint32)]):
            for column, v in zip(out, (bucket, None, blob)):
                column.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(out, (pa.int32(), pa.int32(), pa.binary()))],
            names=["bucket", "found", "data"])

    def task(batches):
        table, ids, n, base = [], [], 0, 0
        for batch in batches:
            column, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            some = lists.is_valid().to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(1)):
                rows = np.flatnonzero(some[c.lo:c.hi])
                if len(rows) == 0:
                    continue
                part = some_rows(c, rows)
                words = Words(part, SPACE)
                h = span_hash(part.data, words.start, words.end)
                hit = np.zeros(words.n + 1, dtype=np.int64)
                for k, i in enumerate(rows):
                    p = unpack_positions(lists[c.lo + int(i)].as_py()) + words.first[k]
                    hit[p[p < words.first[k + 1]]] = 1
                g1 = window_hash(h, window)
                if len(g1) == 0:
                    continue
                total = np.concatenate(([0], np.cumsum(hit)))
                at = np.arange(len(g1))
                near = total[np.minimum(at + block, words.n)] > total[at]
                at = np.flatnonzero(near & whole_windows(words.first, window, len(g1)))
                g2 = window_hash(h, window, BASES[1])
                row = words.row()[at]
                table.append((row + base, at - words.first[row], g1[at], g2[at],
                              neighbourhood(h, window, max(1, window * 3 // 10))[at]))
                ids.append(np.column_stack([column[c.lo:c.hi][rows].astype(np.int64), text_hash(part)]))
                base += part.n
                n += len(at)
                if n >= GATHER // 2:
                    yield from send(table, ids)
                    table, ids, n, base = [], [], 0, 0
        if n:
            yield from send(table, ids)
    return task


def _repeats(buckets: int):
    """Packed windows sorted by bucket: all that are not the earliest of their
    hash, packed by document bucket."""
    def task(batches):
        found = Found(2, buckets)
        for bucket, blobs in by_bucket(batches, 2, 1):
            if bucket is None:
                yield pa.RecordBatch.from_arrays([blobs.column(1), blobs.column(2)], names=["bucket", "data"])
            else:
                yield from found.add(*later(blobs))
        yield from found.flush()
    return task


def later(blobs):
    """(ids, th, pos) of a bucket's windows that are not the earliest."""
    parts = [unpack(b, 2, (np.uint64, np.uint32)) for b in blobs]
    ids = np.concatenate([p[0][0] for p in parts])
    th = np.concatenate([p[0][1] for p in parts])
    key = np.concatenate([p[1][0] for p in parts])
    pos = np.concatenate([p[1][1] for p in parts])
    del parts
    order = np.lexsort((pos, th, ids, key))
    new = np.ones(len(order), dtype=bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    repeat = ~new & ((ids[order] != ids[lead]) | (th[order] != th[lead]) | (pos[order] != pos[lead]))
    flagged = order[repeat]
    return ids[flagged], th[flagged], pos[flagged]


def _listed(ids, values):
    rows = list(by_id(ids, values))
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k, _ in rows], pa.int64()), pa.array([k[1] for k, _ in rows], pa.int64()),
         pa.array([pack_positions(p) for _, (p,) in rows], pa.binary())], names=["id", "th", "pos"])


OUT = "id long, n_words long, n_removed long, kept_sha256 string, n_runs long, kept string"


def _cut(window: int, with_text: bool):
    """Rows (id, text, th list, pos list): the words left in each document."""
    def task(batches):
        for batch in batches:
            column = batch.column(0).to_pylist()
            valid = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(1)):
                own = text_hash(c)
                out = [[], [], [], [], [], []]
                for i in range(c.n):
                    words = c.text(i).split()
                    runs = 0
                    n = len(words)
                    if valid[c.lo + i]:
                        starts = unpack_positions([p for t, p in zip(
                            batch.column(2)[c.lo + i].as_py(), batch.column(3)[c.lo + i].as_py()) if t == own[i]])
                        if len(starts):
                            gone = covered(np.unique(starts), window, n)
                            runs = len(runs_of(gone)[0])
                            words = [words[j] for j in np.flatnonzero(~gone)]
                    kept = b" ".join(words)
                    for column_, v in zip(out, (column[c.lo + i], n, n - len(words), hashlib.sha256(kept).hexdigest(),
                                                runs, kept.decode("utf-8", "replace") if with_text else None)):
                        column_.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(),
                                                          pa.string()))],
                    names=["id", "n_words", "n_removed", "kept_sha256", "n_runs", "kept"])
    return task


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                   with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, n_runs and (unless not wanted)
    the kept text: the words left, joined by single blanks."""
    block = window // 2
    d = identified(docs, id_col, text_col)
    buckets = bucket_count(d)
    hits = shared_positions(d, probe(block), buckets)
    sent = with_lists(d, hits, "pos").mapInArrow(
        tidy(_extend(window, block, buckets)), "bucket int, found int, data binary")
    found = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        tidy(_repeats(buckets)), "bucket int, data binary")
    found = by_document(found, 2, (np.uint32,), _listed, "id long, th long, pos binary")
    out = with_lists(d, found, "th", "pos").mapInArrow(tidy(_cut(window, with_text)), OUT)
    columns = [F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "n_runs"]
    return out.select(*columns, *(["kept"] if with_text else []))


def substring_report(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs, with_text=False)

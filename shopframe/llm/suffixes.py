"""Exact duplicate spans across documents with a sparse suffix array.

Texts are UTF-8 bytes. Suffixes are sampled at minimizers: of the ``lead``-byte
strings within a window of ``span`` bytes, the one of least hash (leftmost of
equals). Equal windows choose equal places, so every window belongs to one
sampled suffix, at the same offset in all its copies, and a suffix with the
bytes before it carries all windows it owns.

1. Sampled suffixes whose leading ``lead`` bytes occur nowhere else match
   nothing; a shuffle of 32-bit hashes within buckets sorts them out.
2. The others leave their document with their leading bytes. Splitters sampled
   from the corpus range-partition them by all ``lead`` leading bytes. A
   beginning that the sample meets so often that it would fill a bucket by
   itself is heavy: its suffixes are cut into their windows, and each window is
   dealt by a hash of its bytes, so that equal ones still meet.
3. Each bucket is sorted locally by multikey quicksort: eight bytes a digit,
   descending only into runs still tied. Runs tied in all ``lead`` leading bytes
   are the groups that can match. A splitter is a whole beginning, so a run tied
   in its leading bytes never crosses a boundary: the suffixes on either side
   of it differ, which is the comparison across boundaries.
4. In a group, suffixes equal with all the bytes they carry settle by the
   smallest doc_id; where contexts differ, the windows owned are compared one
   by one (by 128 bits of hash), each by the smallest doc_id that has it.
5. A window also found in a document with a smaller doc_id covers its bytes;
   covered runs unite to maximal spans.

Exact copies that one map task meets are settled there, so a group of very
many copies costs a row per task and suffix. The texts are shuffled once, by
document, and read from that shuffle twice. A text is read ``SEGMENT`` windows at
a time, so its length is not limited.

Edge cases: a null or empty text has no bytes; texts shorter than ``span`` lose
nothing; a null doc_id comes after all others; rows of equal id do not affect
each other; extra columns are ignored. The bytes left need not be valid UTF-8
(a span may end within a character), so the kept text is returned as binary.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .postings import (NO_ID, bucket_count, by_bucket, by_document, gather, identified, pack, pack_found,
                       shared_positions, unpack, unpack_positions, with_lists)
from .textcore import BASES, chunks, ranges, runs_of, sliding_min, some_rows, text_hash, tidy, window_hash

SPAN = 50
LEAD = 20
SAMPLE_DOCS = 2000      # documents, about, whose suffixes give the splitters
SAMPLE_EACH = 500       # suffixes that one of them gives at most
SEGMENT = 1 << 22       # windows of a text taken at once, at most 2**26
_PLACE = np.uint64((1 << 27) - 1)


def owners(chunk, span: int, lead: int):
    """Segment by segment: window starts, the sampled suffix that owns each,
    and the hash of that suffix's leading bytes."""
    n, ends = len(chunk.data) - span + 1, chunk.offsets[1:-1]
    for lo in range(0, max(n, 0), SEGMENT):
        hi = min(lo + SEGMENT, n)
        key = window_hash(chunk.data[lo:hi + span - 1].astype(np.uint64) + np.uint64(1), lead)
        least = sliding_min((key & ~_PLACE) | np.arange(len(key), dtype=np.uint64), span - lead + 1)
        inside = np.ones(hi - lo, dtype=bool)
        inside[_before(ends[(ends > lo) & (ends < hi + span - 1)] - lo, span, hi - lo)] = False
        start = np.flatnonzero(inside)
        owner = (least[start] & _PLACE).astype(np.int64)
        yield start + lo, owner + lo, key[owner]


def _before(ends: np.ndarray, span: int, n: int) -> np.ndarray:
    """Window starts that would reach over the end of a row."""
    low = np.maximum(ends - span + 1, 0)
    at = ranges(low, ends - low)
    return at[at < n]


def sampled(span: int, lead: int):
    """Postings of all sampled suffixes: every one is an index entry."""
    def anchors(chunk):
        places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for _, owner, key in owners(chunk, span, lead):
            new = np.append(True, owner[1:] != owner[:-1]) if len(owner) else np.zeros(0, dtype=bool)
            places.append(owner[new])
            hashes.append(key[new])
        place, key = np.concatenate(places), np.concatenate(hashes)
        row = np.searchsorted(chunk.offsets, place, side="right") - 1
        return row, place - chunk.offsets[row], key, np.ones(len(place), dtype=bool), key
    return anchors


def beginnings(data: np.ndarray, at: np.ndarray, lead: int) -> np.ndarray:
    """The ``lead`` bytes from each place, as fixed-length byte strings."""
    out = np.empty(len(at), dtype=f"S{lead}")
    for lo in range(0, len(at), 8192):
        part = np.ascontiguousarray(data[at[lo:lo + 8192, None] + np.arange(lead)])
        out[lo:lo + 8192] = part.view(f"S{lead}").ravel()
    return out


def digits(data: np.ndarray, at: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """(n, width) big-endian 8-byte digits of the strings data[at:at+length],
    zero-padded."""
    offset = np.arange(8 * width, dtype=np.int32)
    out = np.zeros((len(at), width), dtype=np.uint64)
    for lo in range(0, len(at), 8192):       # bounded index arrays
        a, n = at[lo:lo + 8192, None], length[lo:lo + 8192, None]
        part = data[np.minimum(a + offset, len(data) - 1)] * (offset < n)
        out[lo:lo + 8192] = np.ascontiguousarray(part.astype(np.uint8)).view(">u8")
    return out


def multikey_sort(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of digits, and per sorted row the first digit in which it
    differs from the row before (the number of digits: equal). Each pass sorts
    one digit of the rows still tied in all digits before."""
    n, width = columns.shape
    order, group = np.arange(n), np.zeros(n, dtype=np.int64)
    differs = np.full(n, width, dtype=np.int64)
    if n:
        differs[0] = 0
    tied = np.arange(n)
    for j in range(width):
        key = columns[order[tied], j]
        by = np.lexsort((key, group[tied]))
        order[tied] = order[tied][by]
        g, key = group[tied][by], key[by]
        new = np.ones(len(tied), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        inner = new.copy()
        inner[1:] &= g[1:] == g[:-1]
        inner[:1] = False
        differs[tied[inner]] = j
        group[tied] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        tied = tied[~(new & np.append(new[1:], True))]
        if len(tied) == 0:
            break
    return order, differs


def merged(ids, th, start, end):
    """(ids, th, start, end): overlapping spans of a text united."""
    order = np.lexsort((start, th, ids))
    ids, th, start, end = (a[order] for a in (ids, th, start, end))
    fresh = np.ones(len(ids), dtype=bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (th[1:] != th[:-1])
    text = np.cumsum(fresh) << 32
    reach = np.maximum.accumulate(end + text)
    new = np.ones(len(ids), dtype=bool)
    new[1:] = start[1:] + text[1:] > reach[:-1]
    a = np.flatnonzero(new)
    stop = (reach - text)[np.append(a[1:], len(ids)) - 1] if len(a) else a
    return ids[a], th[a], start[a], stop


def pack_spans(ids, th, start, end, buckets: int):
    """Rows (bucket, blob) of spans, dealt by document."""
    return pack_found([ids, th], [(end - start).astype(np.uint32), start.astype(np.uint32)], buckets) \
        if len(ids) else []


def _suffixes(span: int, lead: int, splitters: np.ndarray, heavy: np.ndarray):
    """Rows (id, text, pos list): suffixes whose leading bytes occur elsewhere,
    with the bytes of the windows they own, packed by bucket; what one task
    settles is passed on as (id, th, spans)."""
    def deal(doc, start, before, length, pieces):
        """The suffixes and their buckets, heavy ones window by window."""
        at = np.cumsum(length) - length
        begin = beginnings(pieces, at + before, lead)
        bucket = np.searchsorted(splitters, begin, side="right")
        if len(heavy) == 0:
            return doc, start, before, length, pieces, bucket
        many = heavy[np.minimum(np.searchsorted(heavy, begin), len(heavy) - 1)] == begin
        k, rest = np.flatnonzero(many), np.flatnonzero(~many)
        if len(k) == 0:
            return doc, start, before, length, pieces, bucket
        n = length[k] - span + 1
        who, step = np.repeat(k, n), ranges(np.zeros(len(k), np.int64), n)
        own = pieces[ranges(at[who] + step, np.full(len(who), span))]
        h = window_hash(own.astype(np.uint64) + np.uint64(1), span)[np.arange(len(who)) * span]
        return (np.append(doc[rest], doc[who]), np.append(start[rest], start[who] + step),
                np.append(before[rest], before[who] - step), np.append(length[rest], np.full(len(who), span)),
                np.append(pieces[ranges(at[rest], length[rest])], own),
                np.append(bucket[rest], (h % np.uint64(len(splitters) + 1)).astype(np.int64)))

    def send(table, ids):
        doc, start, before, length, pieces, bucket = deal(*gather(table))
        ids = np.concatenate(ids)
        at = np.cumsum(length) - length
        # Equal strings in one task: all but those of the smallest id are settled.
        width = (2 * span - lead + 7) // 8 + 1
        cols = np.column_stack([digits(pieces, at, length, width), (before * 256 + length).astype(np.uint64)])
        order, differs = multikey_sort(cols)
        new = differs < cols.shape[1]
        run = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(ids[doc[order], 0], run), np.diff(np.append(run, len(order))))
        settled = order[ids[doc[order], 0] > least]
        out = [[], [], []]
        for b, blob in pack_spans(*merged(ids[doc[settled], 0], ids[doc[settled], 1], start[settled],
                                          start[settled] + length[settled]), len(splitters) + 1):
            for column, v in zip(out, (b, b, blob)):
                column.append(v)
        keep = np.ones(len(doc), dtype=bool)
        keep[settled] = False
        keep = np.flatnonzero(keep)
        keep = keep[np.argsort(bucket[keep], kind="stable")]
        cut = np.flatnonzero(np.append(True, bucket[keep][1:] != bucket[keep][:-1])) if len(keep) else []
        for lo, hi in zip(cut, np.append(cut[1:], len(keep)) if len(keep) else []):
            k = keep[lo:hi]
            (_, blob), = pack(np.zeros(len(k), np.int64), doc[k], ids,
                              [before[k].astype(np.uint8), length[k].astype(np.uint8), start[k].astype(np.uint32)])
            text = pieces[ranges(at[k], length[k])].tobytes()
            for column, v in zip(out, (int(bucket[k[0]]), None, len(blob).to_bytes(4, "little") + blob + text)):
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
                hit = np.zeros(len(part.data) + 1, dtype=bool)
                for k, i in enumerate(rows):
                    p = unpack_positions(lists[c.lo + int(i)].as_py()) + part.offsets[k]
                    hit[p[p < part.offsets[k + 1]]] = True
                own = np.column_stack([column[c.lo:c.hi][rows].astype(np.int64), text_hash(part)])
                ids.append(own)
                for start, owner, _ in owners(part, span, lead):
                    use = hit[owner]
                    start, owner = start[use], owner[use]
                    if len(start) == 0:
                        continue
                    # Windows owned by one suffix are consecutive.
                    new = np.append(True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1))
                    a = np.flatnonzero(new)
                    last = start[np.append(a[1:], len(start)) - 1]
                    low, length = start[a], last + span - start[a]
                    row = np.searchsorted(part.offsets, low, side="right") - 1
                    table.append((row + base, low - part.offsets[row], owner[a] - low, length,
                                  part.data[ranges(low, length)]))
                    n += len(a)
                    if n >= 120_000:
                        yield from send(table, ids)
                        table, ids, n, base = [], [own], 0, 0
                base += part.n
        if n:
            yield from send(table, ids)
    return task


def _compare(span: int, lead: int, buckets: int):
    """Range buckets of suffixes: (id, th, spans) of all windows that a smaller
    id has too."""
    def reduce(blobs):
        parts, texts = [], []
        for b in blobs:
            n = int.from_bytes(b[:4], "little")
            (ids, th), (before, length, start) = unpack(b[4:4 + n], 2, (np.uint8, np.uint8, np.uint32))
            parts.append((ids, th, start.astype(np.int64), before.astype(np.int64), length.astype(np.int64)))
            texts.append(np.frombuffer(b, np.uint8, offset=4 + n))
        ids, th, start, before, length = gather(parts)
        data = np.concatenate(texts)
        del parts, texts
        at = np.cumsum(length) - length
        # Sort by the suffix from its first byte, then by the bytes before it.
        whole = (lead + 7) // 8
        head = digits(data, at + before, np.minimum(length - before, lead), whole)
        rest = digits(data, at + before + lead, np.maximum(length - before - lead, 0), (2 * span - 2 * lead + 7) // 8 + 1)
        left = digits(data, at, before, (span - lead + 7) // 8)
        cols = np.column_stack([head, rest, left, (before * 256 + length).astype(np.uint64)])
        width = cols.shape[1]
        order, differs = multikey_sort(cols)
        del cols, head, rest, left
        n = len(order)
        group = np.flatnonzero(differs < whole)           # a new run of equal leading bytes
        full = np.flatnonzero(differs < width)            # differs from the suffix before
        run_size = np.diff(np.append(full, n))
        least = np.repeat(np.minimum.reduceat(ids[order], full), run_size)
        # Suffixes equal in everything they carry: the smallest id has it first.
        copies = ids[order] > least
        c = order[copies]
        yield ids[c], th[c], start[c], start[c] + length[c]
        # Groups with different contexts: window by window.
        kinds = np.searchsorted(full, np.append(group[1:], n)) - np.searchsorted(full, group)
        of = np.repeat(np.arange(len(group)), np.diff(np.append(group, n)))
        mixed = (kinds > 1)[of] & ~copies
        k, of = order[mixed], of[mixed]
        lo, cuts = 0, np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(k) else np.zeros(0, np.int64)
        while lo < len(cuts):                             # whole groups, bounded windows
            hi = max(lo + 1, int(np.searchsorted(cuts, cuts[lo] + 50_000)))
            a, b = cuts[lo], cuts[hi] if hi < len(cuts) else len(k)
            yield from windows(k[a:b], ids, th, start, before, length, at, data)
            lo = hi

    def windows(k, ids, th, start, before, length, at, data):
        text = data[ranges(at[k], length[k])].astype(np.uint64) + np.uint64(1)
        first = np.cumsum(length[k]) - length[k]
        n = length[k] - span + 1
        who = np.repeat(k, n)
        place = ranges(first, n)
        g1, g2 = window_hash(text, span)[place], window_hash(text, span, BASES[1])[place]
        step = ranges(np.zeros(len(k), np.int64), n)
        order = np.lexsort((ids[who], g2, g1))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (g1[order[1:]] != g1[order[:-1]]) | (g2[order[1:]] != g2[order[:-1]])
        lead_ = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        hit = order[ids[who[order]] > ids[who[lead_]]]
        s = start[who[hit]] + step[hit]
        yield ids[who[hit]], th[who[hit]], s, s + span

    def flush(parts):
        rows = list(pack_spans(*merged(*gather(parts)), buckets))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()),
                                          pa.array([v for _, v in rows], pa.binary())], names=["bucket", "data"])

    def task(batches):
        parts, n = [], 0                  # what several buckets found makes one row
        for bucket, blobs in by_bucket(batches, 2, 1):
            if bucket is None:
                yield pa.RecordBatch.from_arrays([blobs.column(1), blobs.column(2)], names=["bucket", "data"])
                continue
            for found in reduce(blobs):
                if len(found[0]):
                    parts.append(found)
                    n += len(found[0])
            if n >= 300_000:
                yield from flush(parts)
                parts, n = [], 0
        if parts:
            yield from flush(parts)
    return task


def _listed(ids, values):
    """One row (id, th, spans) per text from the spans of a document bucket."""
    length, start = (a.astype(np.int64) for a in values)
    ids, th, start, end = merged(*ids, start, start + length)
    cut = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (th[1:] != th[:-1])))
    pairs = np.column_stack([start, end]).astype(np.uint32)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[cut]), pa.array(th[cut]),
         pa.array([pairs[i:j].tobytes() for i, j in zip(cut, np.append(cut[1:], len(ids)))], pa.binary())],
        names=["id", "th", "spans"])


OUT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(with_text: bool):
    def task(batches):
        for batch in batches:
            column = batch.column(0).to_pylist()
            valid = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(1)):
                own = text_hash(c)
                out = [[], [], [], [], [], []]
                for i in range(c.n):
                    data = c.data[c.offsets[i]:c.offsets[i + 1]]
                    n, runs = len(data), 0
                    if valid[c.lo + i]:
                        found = [np.frombuffer(p, np.uint32).astype(np.int64).reshape(-1, 2) for t, p in zip(
                            batch.column(2)[c.lo + i].as_py(), batch.column(3)[c.lo + i].as_py()) if t == own[i]]
                        if found:
                            gone = np.zeros(n, dtype=bool)
                            for a, b in np.concatenate(found).tolist():
                                gone[a:b] = True
                            runs = len(runs_of(gone)[0])
                            data = data[~gone]
                    kept = data.tobytes()
                    for column_, v in zip(out, (column[c.lo + i], n, n - len(kept), runs,
                                                hashlib.sha256(kept).hexdigest(), kept if with_text else None)):
                        column_.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(),
                                                          pa.binary()))],
                    names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return task


def sample_splitters(docs: DataFrame, buckets: int, span: int, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings that cut the suffixes of about ``SAMPLE_DOCS`` rows, however
    their ids repeat, into ``buckets`` even ranges; and those that would fill
    a range or more by themselves."""
    share = min(1.0, SAMPLE_DOCS / max(1, docs.count()))

    def task(batches):
        for batch in batches:
            for c in chunks(batch.column(0), max_rows=1):
                place = [owner[np.append(True, owner[1:] != owner[:-1])] for _, owner, _ in owners(c, span, lead) if len(owner)]
                place = np.unique(np.concatenate([np.zeros(0, np.int64), *place]))[::8]
                place = place[::max(1, -(-len(place) // SAMPLE_EACH))]
                yield pa.RecordBatch.from_arrays([pa.array([beginnings(c.data, place, lead).tobytes()], pa.binary())], names=["d"])

    some = docs.where(F.rand(7) < share).select("text").mapInArrow(task, "d binary")
    kind = f"S{lead}"
    d = np.concatenate([np.zeros(0, kind), *[np.frombuffer(r.d, kind) for r in some.toLocalIterator()]])
    d.sort()
    if len(d) == 0 or buckets < 2:
        return np.zeros(0, kind), np.zeros(0, kind)
    cuts = d[(np.arange(1, buckets) * len(d)) // buckets]
    splitters, times = np.unique(cuts, return_counts=True)
    return splitters, splitters[times > 1]


def remove_duplicate_spans(docs: DataFrame, span: int = SPAN, lead: int = LEAD, id_col: str = "doc_id",
                           text_col: str = "text", with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (unless not
    wanted) the kept bytes."""
    d = identified(docs, id_col, text_col)
    buckets = bucket_count(d)
    splitters, heavy = sample_splitters(d, buckets, span, lead)
    hits = shared_positions(d, sampled(span, lead), buckets)
    sent = with_lists(d, hits, "pos").mapInArrow(
        tidy(_suffixes(span, lead, splitters, heavy)), "bucket int, found int, data binary")
    found = sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        tidy(_compare(span, lead, len(splitters) + 1)), "bucket int, data binary")
    found = by_document(found, 2, (np.uint32, np.uint32), _listed, "id long, th long, spans binary")
    out = with_lists(d, found, "th", "spans").mapInArrow(tidy(_cut(with_text)), OUT)
    columns = [F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    return out.select(*columns, *(["kept"] if with_text else []))


def suffix_report(docs: DataFrame) -> DataFrame:
    return remove_duplicate_spans(docs, with_text=False)

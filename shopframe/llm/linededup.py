"""Fuzzy line deduplication by MinHash.

Lines are the parts of a text between line feeds; a line without a character
other than white space is blank, always kept and never compared. A line's
shingles are its runs of ``SHINGLE`` characters (a shorter line: itself).

1. Equal lines collapse to their first occurrence (smallest doc_id, then line
   number) by 128 bits of hash, pre-aggregated where they are met.
2. Each distinct line has ``BANDS`` bands of ``ROWS`` MinHash values; lines that
   share a band meet in a bucket. At a Jaccard similarity of 0.8 a pair meets
   with probability 1 - (1 - 0.8**4)**10 = 0.995, beyond it more surely.
3. Buckets with the same lines are searched once. In a bucket a spanning forest
   of the links is found by comparing shingle sets exactly (Jaccard of
   ``SIMILARITY`` or more); a line once reached is not compared again, so large
   groups of like lines cost about their size. Buckets of more than ``LIMIT``
   lines are searched in parts that are then joined (``crowds.join_parts``).
4. Distributed union-find joins the links to components, and each component
   keeps its first line.

The texts are shuffled by document twice, compressed: for the lines of the
buckets, and for the result.

Edge cases: a null or empty text has no lines; a null
doc_id comes after all others; rows of equal id and text share their lines'
places and are judged alike, rows equal in id only are told apart by a hash of
their text; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize_alone
from .components import FEW_EDGES, components
from .crowds import join_parts, part_of
from .postings import (GATHER, NO_ID, bucket_count, bucket_of, by_bucket, compressed, gather, identified, pack, unpack,
                       with_lists)
from .textcore import BASES, MASK, chunks, mix, text_hash, tidy

SHINGLE = 8             # a power of two
BANDS, ROWS = 10, 4
SIMILARITY = 0.8
LIMIT = 1000
BLOCK = 1 << 15         # characters hashed at once, to stay in cache
SHIFT = 1 << 19         # added to part numbers, of which three make a long

# Fixed odd multipliers: 2-, 4- and 8-character hashes from their halves.
FACTORS = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

_RNG = np.random.default_rng(11)
MULTIPLY = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
FLIP = _RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


def solid_lines(text: bytes):
    """(line number, line) of all lines that are not blank."""
    return [(n, x) for n, x in enumerate(text.split(b"\n")) if x and not x.isspace()]


def shingle_hashes(chars: np.ndarray) -> np.ndarray:
    """Hash of the ``SHINGLE`` characters that start at each place, put
    together from two halves again and again."""
    h, size = chars.astype(np.uint64) + np.uint64(1), 1
    for m in FACTORS:
        h = h[:-size] * m + h[size:] if len(h) > size else h[:0]
        size *= 2
    return mix(h)


def band_keys(lines: list[bytes]) -> np.ndarray:
    """(lines, BANDS) 64-bit band keys."""
    chars = np.frombuffer(b"\n".join(lines).decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    feeds = np.flatnonzero(chars == 10)
    start, end = np.append(0, feeds + 1), np.append(feeds, len(chars))
    x = (shingle_hashes(chars) >> np.uint64(32)).astype(np.uint32)
    n = len(lines)
    sig = np.empty((n, BANDS * ROWS), dtype=np.uint32)
    short = end - start < SHINGLE
    for i in np.flatnonzero(short):
        sig[i] = (np.uint32(xxhash.xxh32_intdigest(lines[i])) ^ FLIP) * MULTIPLY
    at = np.flatnonzero(~short)
    lo, stop = 0, end[at] - SHINGLE + 1
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(stop, start[at[lo]] + BLOCK, side="right")))
        a, b = start[at[lo]], stop[hi - 1]
        part = x[a:b]
        room = np.empty_like(part)
        cuts = np.column_stack([start[at[lo:hi]], stop[lo:hi]]).ravel()[:-1] - a
        for k in range(BANDS * ROWS):
            np.bitwise_xor(part, FLIP[k], out=room)
            np.multiply(room, MULTIPLY[k], out=room)
            sig[at[lo:hi], k] = np.minimum.reduceat(room, cuts)[::2]
        lo = hi
    key = np.empty((n, BANDS), dtype=np.uint64)
    for b in range(BANDS):
        h = np.full(n, b + 1, dtype=np.uint64)
        for r in range(ROWS):
            h = mix(h ^ sig[:, b * ROWS + r].astype(np.uint64)) * np.uint64(BASES[0])
        key[:, b] = mix(h)
    return key


def _describe(batches):
    """Rows (id, text): one row per line, equal lines of a chunk once."""
    for batch in batches:
        column = batch.column(0).to_numpy(zero_copy_only=False)
        for c in chunks(batch.column(1)):
            ids, th = column[c.lo:c.hi].tolist(), text_hash(c).tolist()
            first: dict[int, tuple] = {}
            for i in range(c.n):
                for n, x in solid_lines(c.text(i)):
                    h, place = xxhash.xxh3_128_intdigest(x), (ids[i], th[i], n)
                    if h not in first or place < first[h]:
                        first[h] = place
            rows = [(h >> 64, h & MASK, *p) for h, p in first.items()]
            h1, h2, *place = zip(*rows) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(h1, np.uint64).view(np.int64)), pa.array(np.array(h2, np.uint64).view(np.int64)),
                 *[pa.array(v, t) for v, t in zip(place, (pa.int64(), pa.int64(), pa.int32()))]],
                names=["h1", "h2", "id", "th", "line"])


def _send(buckets: int):
    """Rows (id, text): packed postings (band key, line hash) of all lines,
    equal lines of a chunk once."""
    def send(table):
        line, keys = gather(table)
        line, first = np.unique(line, return_index=True)
        key, who = keys[first].T.ravel(), np.tile(line, BANDS)
        rows = list(pack(bucket_of(key, buckets), np.zeros(len(key), np.int64), np.zeros((1, 0), np.int64),
                         [who, (key >> np.uint64(16)) & np.uint64(0xFFFFFFFFFF), np.zeros(len(key), np.uint8)]))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()),
                                          pa.array([v for _, v in rows], pa.binary())], names=["bucket", "data"])

    def task(batches):
        table, n = [], 0
        for batch in batches:
            for c in chunks(batch.column(1)):
                lines = {}
                for i in range(c.n):
                    for _, x in solid_lines(c.text(i)):
                        lines.setdefault(xxhash.xxh3_128_intdigest(x) >> 64, x)
                if lines:
                    table.append((np.fromiter(lines, np.uint64, len(lines)), band_keys(list(lines.values()))))
                    n += len(lines) * BANDS
                if n >= GATHER:
                    yield from send(table)
                    table, n = [], 0
        if table:
            yield from send(table)
    return task


def _meet(batches):
    """Buckets of two different lines or more: (sig, size, h). Buckets that
    hold the same lines have the same sig."""
    for _, blobs in by_bucket(batches):
        parts = [unpack(b, 0, (np.uint64, np.uint64, np.uint8))[1] for b in blobs]
        who, key = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        # Band keys that occur once meet nothing; the others are put in order.
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        shared = np.append(same, False) | np.append(False, same)
        if not shared.any():
            continue
        key, who = key[shared], who[order[shared]]
        order = np.lexsort((who, key))
        who, key = who[order], key[order]
        new = np.append(True, (key[1:] != key[:-1]) | (who[1:] != who[:-1]))
        who, key = who[new], key[new]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(first, len(key)))
        sig = mix(np.add.reduceat(mix(who), first) ^ mix(np.bitwise_xor.reduceat(mix(who ^ np.uint64(77)), first)))
        sig, size = np.repeat(sig, size), np.repeat(size, size)
        k = size > 1
        if k.any():
            # The same lines meet in several bands: once per bucket is enough.
            pair = np.unique(np.column_stack([sig[k], who[k], size[k].astype(np.uint64)]), axis=0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(pair[:, 0]).view(np.int64)), pa.array(pair[:, 2].astype(np.int32)),
                 pa.array(np.ascontiguousarray(pair[:, 1]).view(np.int64))], names=["sig", "size", "h"])


def _texts(batch, some=None):
    """(row, id, text, hash of the text) of compressed rows."""
    unpack_ = zstandard.ZstdDecompressor()
    ids, z = batch.column(0).to_pylist(), batch.column(1)
    for i in range(batch.num_rows) if some is None else some:
        text = unpack_.decompress(z[int(i)].as_py())
        yield i, ids[i], text, int(np.uint64(xxhash.xxh3_64_intdigest(text)).astype(np.int64))


def _fetch(batches):
    """Rows (id, z, lists of th, line, sig, at): the lines' texts, once for
    every task they take part in."""
    for batch in batches:
        valid = np.flatnonzero(batch.column(2).is_valid().to_numpy(zero_copy_only=False))
        out = [[] for _ in range(8)]
        for r, doc, text, own in _texts(batch, valid.tolist()):
            parts = None
            for t, n, sig, at in zip(*[batch.column(k)[r].as_py() for k in range(2, 6)]):
                if t != own:
                    continue
                parts = parts or text.split(b"\n")
                for col, v in zip(out, (sig, *[(at >> b & 0xFFFFF) - SHIFT for b in (40, 20, 0)], doc, t, n, parts[n])):
                    col.append(v)
        if out[0]:
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(),
                                                      pa.int64(), pa.int32(), pa.binary()))],
                names=["sig", "i", "j", "side", "id", "th", "line", "text"])


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each line, hashed all at once."""
    chars = np.frombuffer(b"\n".join(texts).decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    feeds = np.flatnonzero(chars == 10)
    start, end = np.append(0, feeds + 1).tolist(), np.append(feeds, len(chars)).tolist()
    h = shingle_hashes(chars)
    out = []
    for a, b, t in zip(start, end, texts):
        if b - a < SHINGLE:
            out.append(np.array([xxhash.xxh3_64_intdigest(t)], dtype=np.uint64))
            continue
        own = np.sort(h[a:b - SHINGLE + 1])
        new = np.ones(len(own), dtype=bool)
        np.not_equal(own[1:], own[:-1], out=new[1:])
        out.append(own[new])
    return out


def similar_pair(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sets have a Jaccard similarity of at least that."""
    if len(x) < len(y):
        x, y = y, x
    if len(y) < similarity * len(x):
        return False
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    common = int(np.count_nonzero(x[at] == y))
    return common >= similarity * (len(x) + len(y) - common) - 1e-9


def _similar(x: np.ndarray, rest: list[np.ndarray], size: np.ndarray, similarity: float) -> np.ndarray:
    """Which of ``rest`` have a Jaccard similarity to ``x`` of at least that."""
    fit = np.flatnonzero((size >= similarity * len(x)) & (len(x) >= similarity * size))
    out = np.zeros(len(rest), dtype=bool)
    if len(fit) == 0:
        return out
    flat = np.concatenate([rest[i] for i in fit])
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    common = np.add.reduceat(x[at] == flat, np.cumsum(size[fit]) - size[fit], dtype=np.int64)
    out[fit] = common >= similarity * (len(x) + size[fit] - common) - 1e-9
    return out


def spanning(sets: list[np.ndarray], side: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets; with ``side``, of the
    links between the two sides."""
    left = np.arange(len(sets))
    size = np.array([len(s) for s in sets], dtype=np.int64)
    links = []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            other = left if side is None else left[side[left] != side[x]]
            near = other[_similar(sets[x], [sets[y] for y in other], size[other], similarity)]
            if len(near):
                links.extend((int(x), int(y)) for y in near)
                todo.extend(near)
                left = left[~np.isin(left, near)]
    return links


def _verify(similarity: float):
    """Rows sorted by (sig, i, j): links between lines, with the bucket (null).
    Every line of a part of a crowded bucket (i = j = side >= 0) is also given
    as a link to itself, with its bucket."""
    def flush(rows):
        if not rows:
            return []
        sig, i, j, side = rows[0][:4]
        own = [(r[4:7], r[4:7], sig) for r in rows] if i == j == side else []
        if len(rows) < 2:
            return own
        sets = [r[8] for r in rows]
        sides = None if i == j else np.array([r[3] for r in rows])
        if len(rows) == 2:
            meet = (sides is None or sides[0] != sides[1]) and similar_pair(*sets, similarity)
            return own + ([(rows[0][4:7], rows[1][4:7], None)] if meet else [])
        return own + [(rows[a][4:7], rows[b][4:7], None) for a, b in spanning(sets, sides, similarity)]

    def emit(found):
        place = pa.struct([("id", pa.int64()), ("th", pa.int64()), ("line", pa.int32())])
        ends = [[dict(zip(("id", "th", "line"), e[k])) for e in found] for k in (0, 1)]
        return pa.RecordBatch.from_arrays([*[pa.array(v, place) for v in ends], pa.array([e[2] for e in found], pa.int64())],
                                          names=["a", "b", "sig"])

    def task(batches):
        key, rows, found = None, [], []
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                columns = [col.to_pylist() for col in batch.slice(lo, 2000).columns]
                for r in zip(*columns, shingle_sets(columns[7])):
                    if r[:3] != key:
                        found += flush(rows)
                        key, rows = r[:3], []
                        if len(found) >= 10_000:
                            yield emit(found)
                            found = []
                    rows.append(r)
        found += flush(rows)
        if found:
            yield emit(found)
    return task


OUT = "id long, n_lines long, n_removed long, kept_sha256 string, kept string"


def _cut(with_text: bool):
    """Rows (id, z, lists of th and line of the lines that stay)."""
    def task(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for i, doc, text, own in _texts(batch):
                th, stay = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                stay = {n for t, n in zip(th, stay) if t == own} if th else set()
                lines = text.split(b"\n") if text else []
                left = [x for n, x in enumerate(lines) if n in stay or not x or x.isspace()]
                kept = b"\n".join(left)
                for col, v in zip(out, (doc, len(lines), len(lines) - len(left), hashlib.sha256(kept).hexdigest(),
                                        kept.decode("utf-8", "replace") if with_text else None)):
                    col.append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                names=["id", "n_lines", "n_removed", "kept_sha256", "kept"])
    return task


def distinct_lines(d: DataFrame) -> DataFrame:
    """(h1, h2, id, th, line): every distinct line's hash and first place."""
    lines = d.mapInArrow(tidy(_describe), "h1 long, h2 long, id long, th long, line int")
    return lines.groupBy("h1", "h2").agg(F.min(F.struct("id", "th", "line")).alias("p")).select(
        "h1", "h2", "p.id", "p.th", "p.line")


def near_lines(d: DataFrame, lines: DataFrame, buckets: int, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links between places (id, th, line) of distinct lines."""
    place = "struct<id:long,th:long,line:int>"

    def verify(rows):
        """``rows``: (sig, i, j, side, id, th, line)."""
        at = sum((F.col(c).cast("long") + SHIFT) * (1 << b) for c, b in (("i", 40), ("j", 20), ("side", 0)))
        rows = rows.select("id", "th", "line", "sig", at.alias("at"))
        texts = with_lists(compressed(d), rows, "th", "line", "sig", "at").where(F.col("th").isNotNull()).mapInArrow(
            tidy(_fetch), "sig long, i int, j int, side int, id long, th long, line int, text binary")
        return texts.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(
            tidy(_verify(similarity)), f"a {place}, b {place}, sig long")

    met = (d.mapInArrow(tidy(_send(buckets)), "bucket int, data binary").repartition("bucket").sortWithinPartitions("bucket")
           .mapInArrow(tidy(_meet), "sig long, size int, h long").distinct())
    met = met.join(lines.select(F.col("h1").alias("h"), "id", "th", "line"), "h")
    # A bucket is one part (0, with no side), a crowded one several.
    part = F.when(F.col("size") > LIMIT, part_of("h", "sig", F.ceil(F.col("size") / F.lit(LIMIT)))).otherwise(0)
    side = F.when(F.col("size") > LIMIT, part).otherwise(-1)
    found = materialize_alone(verify(met.select("sig", part.alias("i"), part.alias("j"), side.alias("side"), "id", "th", "line")))
    links = found.where("sig IS NULL").select("a", "b")
    crowd = found.where("sig IS NOT NULL").select(F.col("sig").alias("key"), F.col("a").alias("node"))
    if crowd.isEmpty():
        return links

    def again(rows):
        rows = rows.select(F.col("key").alias("sig"), "i", "j", F.when(F.col("i") == F.col("j"), -1).otherwise(F.col("side")).alias("side"),
                           "node.id", "node.th", "node.line")
        return verify(rows).where("sig IS NULL").select("a", "b")
    return links.unionByName(join_parts(crowd, links, again, LIMIT))


def remove_lines(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text",
                 with_text: bool = True) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 and (unless not wanted) the kept
    lines, joined by line feeds."""
    d = identified(docs, id_col, text_col)
    lines = materialize_alone(distinct_lines(d))
    classes = components(near_lines(d, lines, bucket_count(d), similarity), FEW_EDGES)
    gone = classes.where("node <> component").select("node.id", "node.th", "node.line")
    stay = lines.select("id", "th", "line").join(gone, ["id", "th", "line"], "left_anti")
    out = with_lists(compressed(d), stay, "th", "line").mapInArrow(tidy(_cut(with_text)), OUT)
    columns = [F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "n_lines", "n_removed", "kept_sha256"]
    return out.select(*columns, *(["kept"] if with_text else []))


def line_report(docs: DataFrame) -> DataFrame:
    return remove_lines(docs, with_text=False)

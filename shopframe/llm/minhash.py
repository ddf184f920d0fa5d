"""MinHash near-duplicates by one-permutation hashing.

A text (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``) is the set of its distinct
``width``-word shingles, or of its whole sequence when it has fewer words. Texts
link at a Jaccard similarity of ``percent`` in a hundred or more, and linked
texts form components.

1. Each shingle is hashed once: the upper half of the hash chooses one of
   ``BANDS * ROWS`` bins, the lower half is its value there, and a bin keeps its
   least value. An empty bin takes the value of the first filled bin in a random
   sequence of its own (optimal densification: the sequence depends on the bin
   only, so equal sets fill equally and bins still agree as often as sets do).
2. Texts of equal sets are one node. Each node has ``BANDS`` keys of ``ROWS``
   bins; nodes of one key share a bucket. A pair at the threshold of 0.85 misses
   all 32 buckets with probability (1 - 0.85**6)**32 = 3e-7.
3. A bucket's candidates are a star from its smallest node to all others, so n
   nodes give n - 1 pairs, and a pair that meets in several buckets is one pair.
   Pairs whose sizes alone rule a link out are dropped; all others are compared
   on their full sets, a hub against its members, a large star in parts.
4. Buckets whose members the links have not joined to one component may still
   hold links that avoid the hub. Once for each distinct membership, their
   members of different components are compared on full sets; in a bucket of
   more than ``LIMIT`` nodes those of the largest component, which need not meet
   one another, stay in parts that the others visit.
5. Distributed union-find joins the links.

Texts are compressed once and only those of shared buckets are shuffled.

Edge cases: null, empty and blank texts have an empty set and link with nothing
(their component is their own id); repeated rows and copies share their
component; rows of null id take part, their component is the smallest id present
or null; an empty table gives no row; extra columns are ignored. Sets are
compared by 64-bit hashes of their shingles, and named by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components
from .crowds import crowd_rows
from .textcore import LOWER, SPACE, Chunk, Words, chunks, mix, span_hash, tidy, whole_windows, window_hash

WIDTH = 3
PERCENT = 85
BANDS, ROWS = 32, 6
BINS = BANDS * ROWS
LIMIT = 1000            # nodes of a bucket compared in one task
STAR = 2000             # members of a star compared in one task
EMPTY = np.uint64((1 << 64) - 1)
_LOW = np.uint64(0xFFFFFFFF)


def shingles(chunk: Chunk, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(first, h): row i of the chunk has the sorted distinct shingle hashes
    h[first[i]:first[i + 1]]."""
    low = LOWER[chunk.data]
    words = Words(chunk, SPACE)
    h = span_hash(low, words.start, words.end)
    windows = window_hash(h, width)
    at = np.flatnonzero(whole_windows(words.first, width, len(windows)))
    row, value = words.row()[at], windows[at]
    few = np.flatnonzero((words.count > 0) & (words.count < width))
    if len(few):
        whole = np.zeros(len(few), dtype=np.uint64)
        for j in range(width - 1):
            has = words.count[few] > j
            word = h[np.minimum(words.first[few] + j, len(h) - 1)]
            whole[has] = mix(whole[has] * np.uint64(0xC2B2AE3D27D4EB4F) + word[has] + np.uint64(j + 1))
        row, value = np.append(row, few), np.append(value, whole)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return np.searchsorted(row[new], np.arange(chunk.n + 1)), value[new]


def signatures(first: np.ndarray, h: np.ndarray, bins: int = BINS) -> np.ndarray:
    """(rows, bins): least value of each bin, empty bins densified. Every row
    has a shingle."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    place = ((h >> np.uint64(32)) * np.uint64(bins)) >> np.uint64(32)
    sig = np.full(n * bins, EMPTY)
    np.minimum.at(sig, row * bins + place.astype(np.int64), h & _LOW)
    sig = sig.reshape(n, bins)
    filled = sig != EMPTY
    lone = np.flatnonzero(filled.sum(axis=1) == 1)      # every sequence ends there
    sig[lone] = sig[lone].min(axis=1, keepdims=True)
    r, b = np.nonzero(sig == EMPTY)
    t = 0
    while len(r):
        t += 1
        probe = (mix(np.arange(bins, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(t))
                 % np.uint64(bins)).astype(np.int64)
        j = probe[b]
        hit = filled[r, j]
        sig[r[hit], b[hit]] = sig[r[hit], j[hit]]       # a filled bin never changes
        r, b = r[~hit], b[~hit]
    return sig


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(rows, bands) 64-bit keys, the band among what is hashed."""
    bands = sig.shape[1] // rows
    key = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), 1))
    for r in range(rows):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::rows][:, :bands])
    return key


def _sign(width: int):
    """Rows (id, text): id, number of shingles, name and band keys of the set,
    compressed text; no name where the set is empty."""
    def task(batches):
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for c in chunks(batch.column(1)):
                first, h = shingles(c, width)
                count = np.diff(first)
                some = np.flatnonzero(count)
                keys, names, packed = [None] * c.n, [None] * c.n, [None] * c.n
                if len(some):
                    band = band_keys(signatures(np.append(first[some], len(h)), h))
                    view = memoryview(h.view(np.uint8))
                    for k, i in enumerate(some.tolist()):
                        keys[i] = band[k].tobytes()
                        names[i] = xxhash.xxh3_128_digest(view[8 * first[i]:8 * first[i + 1]])
                        packed[i] = press.compress(c.text(i))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.lo, c.n), pa.array(count), pa.array(names, pa.binary()),
                     pa.array(keys, pa.binary()), pa.array(packed, pa.binary())],
                    names=["doc_id", "n", "name", "keys", "z"])
    return task


def _postings(batches):
    """Rows (node, keys): a row (key, node) for each band."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 4096):
            part = batch.slice(lo, 4096)
            keys = part.column(1).to_pylist()
            row = np.repeat(np.arange(part.num_rows), [len(k) // 8 for k in keys])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(b"".join(keys), np.int64)), part.column(0).take(pa.array(row))], names=["key", "node"])


def unpacked_sets(packed: list[bytes], width: int):
    """The shingle sets of compressed texts, some megabytes of text at a time."""
    open_ = zstandard.ZstdDecompressor()
    texts, size = [], 0

    def flush():
        offsets = np.cumsum([0, *map(len, texts)])
        first, h = shingles(Chunk(np.frombuffer(b"".join(texts), np.uint8), offsets, 0, len(texts)), width)
        return [h[a:b] for a, b in zip(first, first[1:])]

    for z in packed:
        texts.append(open_.decompress(z))
        size += len(texts[-1])
        if size > 1 << 21:
            yield from flush()
            texts, size = [], 0
    if texts:
        yield from flush()


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    common = int(np.count_nonzero(x[at] == y))
    return 100 * common >= percent * (len(x) + len(y) - common)


def similar_to(x: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of the sets are similar to ``x``."""
    if not sets:
        return np.zeros(0, dtype=bool)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    at = np.minimum(np.searchsorted(x, flat), len(x) - 1)
    common = np.add.reduceat(x[at] == flat, np.cumsum(size) - size, dtype=np.int64)
    return 100 * common >= percent * (len(x) + size - common)


PAIR = "a long, b long"


def _pairs(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _stars(width: int, percent: int):
    """Rows (hub, part, member or null, z) sorted so that a star's hub comes
    first: its links."""
    def task(batches):
        hub, centre = None, None
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                hubs, _, members, packed = (c.to_pylist() for c in batch.slice(lo, 1000).columns)
                found = []
                for a, b, own in zip(hubs, members, unpacked_sets(packed, width)):
                    if b is None:
                        hub, centre = a, own.copy()
                    elif a == hub and similar(centre, own, percent):
                        found.append((a, b))
                if found:
                    yield _pairs(found)
    return task


def star_links(pairs: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (hub, member) whose full sets are similar."""
    counts = materialize(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / F.lit(STAR)).alias("parts")))
    dealt = pairs.join(counts, "hub").select("hub", F.pmod(F.xxhash64("member"), F.col("parts")).cast("int").alias("part"),
                                             "member")
    hubs = counts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"))
    rows = dealt.join(sets.withColumnRenamed("node", "member"), "member").select("hub", "part", "member", "z").unionByName(
        hubs.join(sets.withColumnRenamed("node", "hub"), "hub").select("hub", "part", F.lit(None).cast("long").alias("member"), "z"))
    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("member").asc_nulls_first()).mapInArrow(
        tidy(_stars(width, percent)), PAIR)


def search(nodes: list, comps: list, sides: list, sets: list[np.ndarray], percent: int) -> list[tuple]:
    """Links between nodes of different components (and different sides, where
    both are given) that are still needed to join them."""
    group = {c: i for i, c in enumerate(dict.fromkeys(comps))}
    of = np.array([group[c] for c in comps])
    side = np.array(sides)
    both = len(set(sides)) > 1
    size = np.array([len(s) for s in sets])
    found = []
    for x in range(len(nodes) - 1):
        other = np.flatnonzero((of != of[x]) & (100 * np.minimum(size, size[x]) >= percent * np.maximum(size, size[x]))
                               & ((side != side[x]) if both else True))
        other = other[other > x]
        for y in other[similar_to(sets[x], [sets[y] for y in other], percent)]:
            if of[y] != of[x]:
                found.append((nodes[x], nodes[y]))
                of[of == of[y]] = of[x]
    return found


def _crowds(width: int, percent: int):
    """Rows (key, i, j, side, node, comp, z) sorted by (key, i, j): links
    inside (i = j) or between two parts of a bucket."""
    def flush(rows):
        if len({r[5] for r in rows}) < 2 or (rows[0][1] != rows[0][2] and len({r[3] for r in rows}) < 2):
            return []
        _, _, _, sides, nodes, comps, packed = zip(*rows)
        return search(list(nodes), list(comps), list(sides), list(unpacked_sets(packed, width)), percent)

    def task(batches):
        key, rows = None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                for r in zip(*[c.to_pylist() for c in batch.slice(lo, 1000).columns]):
                    if r[:3] != key:
                        found = flush(rows) if rows else []
                        if found:
                            yield _pairs(found)
                        key, rows = r[:3], []
                    rows.append(r)
        found = flush(rows) if rows else []
        if found:
            yield _pairs(found)
    return task


def crowd_links(rest: DataFrame, sets: DataFrame, width: int, percent: int, limit: int = LIMIT) -> DataFrame:
    rows = crowd_rows(rest, limit).join(sets, "node").select("key", "i", "j", "side", "node", "comp", "z")
    return rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(
        tidy(_crowds(width, percent)), PAIR)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id",
                    text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the smallest id reachable)
    and name (of its set, null where it is empty)."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    signed = materialize(d.mapInArrow(
        tidy(_sign(width)), f"doc_id {d.schema['doc_id'].dataType.simpleString()}, n long, name binary, keys binary, z binary"))
    rows = signed.where("name IS NOT NULL")
    # Sets are numbered once, in the written table.
    nodes = materialize(rows.groupBy("name").agg(F.first("n").alias("n"), F.first("keys").alias("keys"),
                                                 F.min("doc_id").alias("least"))
                        .withColumn("node", F.monotonically_increasing_id()))
    postings = nodes.select("node", "keys").mapInArrow(_postings, "key long, node long")
    buckets = materialize(postings.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1"))
    met = postings.join(buckets, "key")
    size = nodes.select("node", "n")
    pairs = met.where("node <> hub").select("hub", F.col("node").alias("member")).distinct()
    pairs = (pairs.join(size.select(F.col("node").alias("hub"), F.col("n").alias("hub_n")), "hub")
             .join(size.select(F.col("node").alias("member"), "n"), "member")
             .where(f"100 * least(n, hub_n) >= {percent} * greatest(n, hub_n)").select("hub", "member"))
    pairs = materialize(pairs)
    shared = nodes.select("node", "name").join(met.select("node").distinct(), "node", "left_semi")
    sets = materialize(rows.select("name", "z").join(shared, "name").dropDuplicates(["node"]).select("node", "z"))
    links = materialize(star_links(pairs, sets, width, percent))
    comp = materialize(components(links))
    # Buckets that are not one component yet, beside their hub.
    member = met.where("c > 2 AND node <> hub").select("key", "node").join(comp.select("node", "component"), "node", "left")
    member = materialize(member.select("key", "node", F.coalesce("component", "node").alias("comp")))
    mixed = member.groupBy("key").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("c"),
        F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"))
    mixed = materialize(mixed.where("low <> high").groupBy("c", "s", "x").agg(F.min("key").alias("key")).select("key"))
    if not mixed.isEmpty():
        more = materialize(crowd_links(member.join(mixed, "key", "left_semi"), sets, width, percent, limit))
        if not more.isEmpty():
            comp = materialize(components(links.unionByName(more)))
    classed = materialize(nodes.select("name", "node", "least").join(comp, "node", "left").select(
        "name", "least", F.coalesce("component", "node").alias("class")))
    least = materialize(classed.groupBy("class").agg(F.min("least").alias("component_id")))
    named = materialize(classed.join(least, "class").select("name", "component_id"))
    return signed.select("doc_id", "n", "name").join(named, "name", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "name")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id",
                                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))

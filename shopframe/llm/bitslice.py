"""Ranked lexical search over bit-sliced Bloom signatures.

Terms are the maximal runs of letters, digits and non-ASCII characters, A-Z
lower-cased. ``build_index`` makes one pass over the texts: a document's
signature sets ``HASHES`` bits for each of its terms, a second signature those
of the terms it holds twice or more. Documents of about the same number of
terms share a width of at least ``BITS`` bits a term and are stored by slices:
for each bit position, one bitmap over the documents.

A search takes all items at once, in blocks of at most ``BLOCK_TERMS`` terms:

1. The documents holding each term are counted exactly (with the index, or in a
   pass of its own for a further block); weights follow from the counts.
2. The AND of a term's slices is a bitmap of the documents that may hold it, and
   misses none. The sum of the weights over an item's bitmaps, times the factor
   of a single occurrence, plus that over the second signature, times what the
   document's most frequent term could add, is never below the score.
3. The documents with the highest bounds, from all parts of the index, are scored
   exactly; the lowest of their best scores is the item's threshold.
4. A second pass over the index names every document whose bound reaches the
   threshold; all others are provably excluded. Those named are scored exactly
   from their texts, and the best are kept.

Only texts that are named are tokenised again, found by id and a 64-bit hash of
the text. The number of candidates is not limited.

Edge cases: null and empty texts and texts without a term are in no count and
no result; a null id comes last among equal scores; repeated rows are documents
of their own, with ranks of their own; every row of the items is an item, and an
item without a term found in a document has no result; an empty table gives no
row; extra columns are ignored. Terms are compared by 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize
from .textcore import LOWER, NON_ALNUM, Chunk, Words, chunks, span_hash, tidy

TOP = 10
HASHES = 4
BITS = 10                   # of signature a term, at least
BLOCK_TERMS = 200_000       # terms of a block of items
GATHER = 1_000_000          # terms of documents that are sliced together
SEEDS, SEEDS_TASK = 20, 16  # documents an item's threshold is taken from
BROADCAST_ROWS = 100_000    # named documents that may be broadcast
CELLS = 1 << 22             # bound cells computed at once


def term_counts(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(n, row, term, tf): terms of each row with repeats, and its distinct
    terms, sorted, with their counts."""
    low = LOWER[chunk.data]
    words = Words(Chunk(low, chunk.offsets, chunk.lo, chunk.hi), NON_ALNUM)
    h, row = span_hash(low, words.start, words.end), words.row()
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (row[1:] != row[:-1]))) if len(h) else np.zeros(0, np.int64)
    return words.count, row[first], h[first], np.diff(np.append(first, len(h)))


def positions(h: np.ndarray, width: int) -> np.ndarray:
    """(terms, HASHES) bit positions; ``width`` is a power of two."""
    a, b = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(HASHES, dtype=np.uint64) * b[:, None]) & np.uint64(width - 1)).astype(np.int64)


def room(n: int) -> int:
    """Bits of a slice over ``n`` documents: 1, 2, 4 or whole bytes."""
    return next((k for k in (1, 2, 4) if n <= k), (n + 7) // 8 * 8)


def width_for(terms: int) -> int:
    return 1 << max(6, math.ceil(math.log2(max(1, BITS * terms))))


def slice_terms(row: np.ndarray, term: np.ndarray, n: int, width: int) -> bytes:
    """Slices (width bitmaps of ``room(n)`` bits) of documents 0..n - 1."""
    bits = np.zeros(width * room(n), dtype=bool)
    if len(term):
        bits[(positions(term, width) * room(n) + row[:, None]).ravel()] = True
    return np.packbits(bits, bitorder="little").tobytes()


def may_hold(slices: bytes, width: int, n: int, at: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """(terms, hi - lo) 0 or 1: which of the documents lo:hi (lo divided by
    eight) have all bits ``at``."""
    data, size = np.frombuffer(slices, np.uint8), room(n)
    if size >= 8:
        part = data.reshape(width, size // 8)[:, lo // 8:(hi + 7) // 8]
        maps = part[at[:, 0]]
        for j in range(1, HASHES):
            maps &= part[at[:, j]]
    else:
        bit = at * size
        part = (data[bit >> 3] >> (bit & 7).astype(np.uint8)) & np.uint8((1 << size) - 1)
        maps = np.bitwise_and.reduce(part, axis=1)[:, None]
    return np.unpackbits(maps, axis=1, bitorder="little", count=hi - lo)


def _scan(terms: np.ndarray, index: bool, id_type):
    """Rows (doc_id, text, t): the index blocks and, for the sorted ``terms``,
    the number of documents with each."""
    def rows(count, **columns):
        kinds = {"term": pa.int64(), "df": pa.int64(), "docs": pa.list_(id_type), "t": pa.list_(pa.int64()),
                 "n": pa.list_(pa.int64()), "top": pa.list_(pa.int64()), "width1": pa.int64(), "width2": pa.int64(),
                 "s1": pa.binary(), "s2": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(columns.get(k, [None] * count), v) for k, v in kinds.items()],
                                          names=list(kinds))

    def blocks(parts):
        base, cols = 0, []
        for ids, t, n, row, term, tf in parts:
            cols.append((n, row + base, term, tf))
            base += len(n)
        n, row, term, tf = (np.concatenate(c) for c in zip(*cols))
        ids = [x for p in parts for x in p[0]]
        t = [x for p in parts for x in p[1]]
        distinct = np.bincount(row, minlength=base)
        top = np.zeros(base, dtype=np.int64)
        np.maximum.at(top, row, tf)
        wide = np.array([width_for(int(d)) for d in distinct])
        for w in np.unique(wide[distinct > 0]):
            docs = np.flatnonzero((wide == w) & (distinct > 0))
            place = np.full(base, -1)
            place[docs] = np.arange(len(docs))
            own = place[row] >= 0
            more = own & (tf > 1)
            w2 = width_for(int(np.bincount(row[more], minlength=1).max()) if more.any() else 0)
            yield rows(1, docs=[[ids[i] for i in docs]], t=[[t[i] for i in docs]], n=[n[docs]], top=[top[docs]],
                       width1=[int(w)], width2=[w2], s1=[slice_terms(place[row[own]], term[own], len(docs), int(w))],
                       s2=[slice_terms(place[row[more]], term[more], len(docs), w2)])

    def task(batches):
        df, parts, size = np.zeros(len(terms), dtype=np.int64), [], 0
        for batch in batches:
            for c in chunks(batch.column(1)):
                n, row, term, tf = term_counts(c)
                if len(terms):
                    at = np.minimum(np.searchsorted(terms, term), len(terms) - 1)
                    df += np.bincount(at[terms[at] == term], minlength=len(terms))
                if index:
                    parts.append((batch.column(0).slice(c.lo, c.n).to_pylist(), batch.column(2).slice(c.lo, c.n).to_pylist(),
                                  n, row, term, tf))
                    size += len(term)
                    if size >= GATHER:
                        yield from blocks(parts)
                        parts, size = [], 0
        if parts:
            yield from blocks(parts)
        some = np.flatnonzero(df)
        if len(some):
            yield rows(len(some), term=terms[some].view(np.int64), df=df[some])
    return task


class Items:
    """A block of items: their ids, the sorted distinct terms of all, and of
    each item the places of its terms among them."""

    def __init__(self, items: list[tuple[object, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.terms = np.unique(np.concatenate([np.zeros(0, np.uint64), *[h for _, h in items]]))
        self.of = [np.searchsorted(self.terms, h) for _, h in items]
        self.weight = np.zeros(len(self.terms), dtype=np.int64)

    def weigh(self, df: dict[int, int], n: int) -> None:
        """Set weights; terms that no document holds leave their items."""
        found = np.zeros(len(self.terms), dtype=bool)
        for i, h in enumerate(self.terms.view(np.int64).tolist()):
            if df.get(h):
                found[i], self.weight[i] = True, math.floor(1000 * math.log((2 * n + 2) / (2 * df[h] + 1)))
        self.of = [t[found[t]] for t in self.of]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block_terms: int = BLOCK_TERMS):
    """The items in blocks of at most that many terms (but whole items)."""
    block, size = [], 0
    for r in items.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t IS NOT NULL").toLocalIterator():
        (c,) = chunks(pa.array([r.t]))
        h = term_counts(c)[2]
        if block and size + len(h) > block_terms:
            yield Items(block)
            block, size = [], 0
        block.append((r.i, h))
        size += len(h)
    if block:
        yield Items(block)


def lengths(n, docs: int, total: int) -> np.ndarray:
    """The length term m of each document (Python integers: no overflow)."""
    return np.array([10 + 90 * int(x) * docs // total for x in n], dtype=np.int64)


def factor(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def bounds(items: Items, row: dict, docs: int, total: int):
    """Yields (first document, (items, documents) upper bounds of the scores)
    of an index row."""
    n = len(row["n"])
    m, top = lengths(row["n"], docs, total), np.array(row["top"], dtype=np.int64)
    one = factor(np.ones(n, np.int64), m)
    rest = factor(top, m) - one
    some = [i for i, t in enumerate(items.of) if len(t)]
    if not some:
        return
    flat = np.concatenate([items.of[i] for i in some])
    size = np.array([len(items.of[i]) for i in some])
    cut = np.cumsum(size) - size
    weight = items.weight[flat][:, None].astype(np.int32 if size.max() < 50_000 else np.int64)
    layers = [(row[s], row[w], positions(items.terms, row[w])) for s, w in (("s1", "width1"), ("s2", "width2"))]
    step = max(8, CELLS // len(flat) // 8 * 8)
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        sums = []
        for slices, width, at in layers:
            bits = may_hold(slices, width, n, at, lo, hi)
            sums.append(np.add.reduceat(bits[flat] * weight, cut, axis=0, dtype=np.int64))
        out = np.zeros((len(items.of), hi - lo), dtype=np.int64)
        out[some] = sums[0] * one[lo:hi] + sums[1] * rest[lo:hi]
        yield lo, out


INDEX_ROW = ("docs", "t", "n", "top", "width1", "width2", "s1", "s2")


def _index_rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {k: batch.column(j)[i].as_py() for j, k in enumerate(INDEX_ROW)}


def _highest(items: Items, docs: int, total: int, each: int, id_type):
    """The documents of a task with the highest bounds of every item."""
    def task(batches):
        best = np.zeros((len(items.ids), 0), dtype=np.int64)
        who = np.zeros((len(items.ids), 0), dtype=np.int64)
        ids, t = [], []
        for row in _index_rows(batches):
            for lo, bound in bounds(items, row, docs, total):
                best = np.hstack([best, bound])
                who = np.hstack([who, np.broadcast_to(np.arange(lo, lo + bound.shape[1]) + len(ids), bound.shape)])
                if best.shape[1] > each:
                    top = np.argpartition(-best, each - 1, axis=1)[:, :each]
                    best, who = np.take_along_axis(best, top, 1), np.take_along_axis(who, top, 1)
            ids += row["docs"]
            t += row["t"]
        i, k = np.nonzero(best)
        if len(i):
            d = who[i, k].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(i, pa.int32()), pa.array(best[i, k]), pa.array([ids[x] for x in d], id_type),
                 pa.array([t[x] for x in d], pa.int64())], names=["item", "bound", "doc_id", "t"])
    return task


def _reaching(items: Items, docs: int, total: int, least: np.ndarray, id_type):
    """All (item, document) whose bound reaches the item's threshold."""
    def task(batches):
        for row in _index_rows(batches):
            for lo, bound in bounds(items, row, docs, total):
                i, k = np.nonzero(bound >= np.maximum(least, 1)[:, None])
                if len(i):
                    d = (k + lo).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(i, pa.int32()), pa.array([row["docs"][x] for x in d], id_type),
                         pa.array([row["t"][x] for x in d], pa.int64())], names=["item", "doc_id", "t"])
    return task


def _score(items: Items, docs: int, total: int):
    """Rows (doc_id, text, list of items): exact scores above 0."""
    def task(batches):
        for batch in batches:
            wanted = batch.column(2)
            for c in chunks(batch.column(1)):
                n, row, term, tf = term_counts(c)
                m = lengths(n, docs, total)
                cut = np.searchsorted(row, np.arange(c.n + 1))
                at = np.minimum(np.searchsorted(items.terms, term), len(items.terms) - 1)
                hit = items.terms[at] == term
                count = np.zeros(len(items.terms), dtype=np.int64)
                who, which, score = [], [], []
                for k in range(c.n):
                    own = slice(cut[k], cut[k + 1])
                    place = at[own][hit[own]]
                    count[place] = tf[own][hit[own]]
                    gain = np.zeros(len(count), dtype=np.int64)
                    gain[place] = items.weight[place] * factor(count[place], m[k])
                    for i in wanted[c.lo + k].as_py():
                        s = int(gain[items.of[i]].sum())
                        if s > 0:
                            who.append(c.lo + k)
                            which.append(i)
                            score.append(s)
                    count[place] = 0
                if who:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(which, pa.int32()), batch.column(0).take(pa.array(who)), pa.array(score, pa.int64())],
                        names=["item", "doc_id", "score"])
    return task


def score_named(docs: DataFrame, named: DataFrame, items: Items, n: int, total: int) -> DataFrame:
    """(item, doc_id, score) of the documents (doc_id, text, t) named for some
    item by (item, doc_id, t)."""
    named = materialize(named.groupBy(F.col("doc_id").alias("_id"), F.col("t").alias("_t")).agg(F.collect_set("item").alias("items")))
    if named.count() <= BROADCAST_ROWS:         # the size is checked
        named = F.broadcast(named)
    rows = docs.join(named, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("t") == F.col("_t"))).select("doc_id", "text", "items")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(_score(items, n, total)), f"item int, doc_id {kind}, score long")


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of every item."""
    text = F.col(f"`{text_col}`")
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t")).where("text IS NOT NULL")
    kind, item_kind = d.schema["doc_id"].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    id_type = to_arrow_type(d.schema["doc_id"].dataType)
    schema = (f"term long, df long, docs array<{kind}>, t array<long>, n array<long>, top array<long>, width1 long, "
              "width2 long, s1 binary, s2 binary")
    spark = docs.sparkSession
    out = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score long")
    index, sums = None, None
    for block in item_blocks(items, item_col, item_text_col, block_terms):
        scan = materialize(d.mapInArrow(tidy(_scan(block.terms, index is None, id_type)), schema))
        if index is None:
            index = scan.where("n IS NOT NULL").select(*INDEX_ROW)
            sums = index.agg(F.sum(F.size("n")).alias("docs"), F.sum(F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)).alias("words")).first()
        if not sums.docs:
            return out
        df = scan.where("term IS NOT NULL").groupBy("term").agg(F.sum("df").alias("df"))    # at most the block's terms
        block.weigh({r.term: r.df for r in df.toLocalIterator()}, sums.docs)
        at = (block, sums.docs, sums.words)
        seeds = index.mapInArrow(tidy(_highest(*at, max(k, SEEDS_TASK), id_type)), f"item int, bound long, doc_id {kind}, t long")
        order = Window.partitionBy("item").orderBy(F.desc("bound"), F.col("doc_id").asc_nulls_last())
        seeds = seeds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= max(2 * k, SEEDS))
        seen = _best(score_named(d, seeds, *at), k).where(F.col("rank") == k)
        least = np.zeros(len(block.ids), dtype=np.int64)
        for r in seen.select("item", "score").toLocalIterator():            # one row an item
            least[r.item] = r.score
        named = index.mapInArrow(tidy(_reaching(*at, least, id_type)), f"item int, doc_id {kind}, t long")
        best = _best(score_named(d, named, *at), k)
        names = spark.createDataFrame([(i, x) for i, x in enumerate(block.ids)], f"item int, item_id {item_kind}")
        out = out.unionByName(materialize(best.join(names, "item").select("item_id", "rank", "doc_id", "score")))
    return out


def search_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    return search(docs, items)


_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
word AS (SELECT r, unnest(regexp_extract_all({_FOLD.format('text')}, '{_TERM}')) AS w FROM d),
tf AS (SELECT r, w, count(*) AS tf FROM word GROUP BY r, w),
size AS (SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM size),
weight AS (SELECT w, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS weight
  FROM tf, total GROUP BY w),
item AS (SELECT row_number() OVER () AS i, item_id, text FROM benchmark),
ask AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all({_FOLD.format('text')}, '{_TERM}')) AS w FROM item),
score AS (SELECT i, item_id, tf.r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))))::BIGINT
    AS score FROM ask JOIN weight USING (w) JOIN tf USING (w) JOIN size USING (r), total GROUP BY i, item_id, tf.r),
ranked AS (SELECT i, item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank
  FROM score JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 10"""

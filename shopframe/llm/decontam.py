"""Benchmark decontamination with training-side suffix arrays.

The training corpus is cut into shards of whole documents (runs of rows of
about two megabytes of text). Each shard's task builds the suffix array of its
words: the suffixes of all its documents in the order of their first
``window`` words (words are ordered by a 64-bit hash; a document's end sorts
before every word, so no suffix runs into the next document). Every suffix of
every test item is then binary-searched in every shard. The suffixes equal in
the first ``window`` words form one slice of the array, which gives the
locations; each location is extended word by word to its longest verbatim
match. A suffix whose first words begin no test window can't be found by any
search, so it is left out before sorting.

The test set is sent to the tasks in blocks of at most ``BLOCK_BYTES``, one pass
over the corpus per block, so what is broadcast has a fixed bound however large
the test set or an item is. A block is the hash of each word of its items once;
tasks derive the windows from it. An item beyond a block is cut into pieces that
overlap by ``window - 1`` words, so each of its windows is in one piece; a match
that reaches the end of a piece is carried on with the next. No shuffle is
needed: a document lies in one shard.

Words: A-Z lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
An item of fewer words than ``window`` (but not none) is one window of its own.

Edge cases: a null or empty text has no words and no hits; a null or empty
item has no window; repeated items each count by their own id (null ids are
left out of the item list, their windows still hit); rows with equal doc_id
are judged one by one; extra columns are ignored; an empty test set leaves all
documents clean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_whole_rows, numbered, written
from .textcore import CHUNK_BYTES, LOWER, NON_ALNUM, Chunk, Words, chunks, covered, ranges, span_hash

WINDOW = 10
BLOCK_BYTES = 8 << 20

HITS = ("doc_id long, n_words long, n_hit long, item_ids array<long>, "
        "longest_match long, n_locations long, spans array<struct<start:long,end:long>>")
STATE = "places array<long>, open array<struct<at:long,length:long>>"      # between passes
FOUND = [pa.field("doc_id", pa.int64()), pa.field("n_words", pa.int64()), pa.field("n_hit", pa.int64()),
         pa.field("item_ids", pa.list_(pa.int64())), pa.field("longest_match", pa.int64()),
         pa.field("n_locations", pa.int64()),
         pa.field("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
CARRIED = [pa.field("places", pa.list_(pa.int64())),
           pa.field("open", pa.list_(pa.struct([("at", pa.int64()), ("length", pa.int64())])))]


def words_of(chunk: Chunk) -> tuple[Words, np.ndarray]:
    """Words of a chunk and their hashes (never 0: that is a document's end)."""
    low = LOWER[chunk.data]
    words = Words(Chunk(low, chunk.offsets, chunk.lo, chunk.hi), NON_ALNUM)
    return words, span_hash(low, words.start, words.end) | np.uint64(1)


class TestSet:
    """A block of test items: the hashes of their words in one flat array ``h``
    (item i: ``first[i]:first[i + 1]``). ``resumes``: the first item goes on
    from the block before, with its last ``window - 1`` words again;
    ``continues``: the last item goes on in the next block."""

    __test__ = False

    def __init__(self, items: list[tuple[int | None, np.ndarray]], window: int, resumes: bool = False,
                 continues: bool = False):
        self.window, self.resumes, self.continues = window, resumes, continues
        self.ids = [x for x, _ in items]
        self.h = np.concatenate([np.zeros(0, np.uint64), *[w for _, w in items]])
        self.first = np.cumsum([0, *[len(w) for _, w in items]])

    def windows(self) -> Windows:
        return Windows(self)


class Windows:
    """The windows of a block: where each starts (``at``) in ``h``, its
    ``length`` (short items: less than ``window``), item and item's end."""

    def __init__(self, test: TestSet):
        self.h, self.size = test.h, test.window
        words = np.diff(test.first)
        m = np.minimum(test.window, words)
        n = words - m + 1
        self.item = np.repeat(np.arange(len(words)), n)
        self.at = ranges(test.first[:-1], n)
        self.length, self.end = m[self.item], test.first[1:][self.item]
        self.lead = min(2, int(m.min())) if len(m) else 0
        self.lead_keys = None
        if self.lead:
            a = self.h[self.at]
            self.lead_keys = np.unique(a if self.lead == 1 else
                                       a * np.uint64(0x9E3779B97F4A7C15) ^ self.h[self.at + 1])


def suffix_array(h: np.ndarray, end: np.ndarray, keep: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``keep`` sorted by their next ``depth`` words, a word a pass:
    each pass sorts only the suffixes still tied with a neighbour."""
    if len(keep) == 0:
        return keep
    order = keep.copy()
    group = np.zeros(len(order), dtype=np.int64)
    tied = np.arange(len(order))
    for j in range(depth):
        pos = order[tied] + j
        key = np.where(pos < end[order[tied]], h[np.minimum(pos, len(h) - 1)], np.uint64(0))
        by = np.lexsort((order[tied], key, group[tied]))
        order[tied], key, g = order[tied][by], key[by], group[tied][by]
        new = np.ones(len(tied), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
        # A group is named by the place of its first member in the whole array.
        first = np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))
        group[tied] = tied[first]
        alone = new & np.append(new[1:], True)
        tied = tied[~alone]
        if len(tied) == 0:
            break
    return order


def search(order: np.ndarray, h: np.ndarray, end: np.ndarray, test: Windows) -> tuple[np.ndarray, np.ndarray]:
    """Slice [lo, hi) of the suffix array whose suffixes begin with each test
    window: binary search of all test suffixes at once."""
    def bound(upper: bool) -> np.ndarray:
        lo = np.zeros(len(test.item), dtype=np.int64)
        hi = np.full(len(test.item), len(order), dtype=np.int64)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if len(open_) == 0:
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            suffix = order[mid]
            state = np.zeros(len(open_), dtype=np.int8)   # -1 suffix smaller, 1 larger
            for j in range(test.size):
                live = (state == 0) & (j < test.length[open_])
                if not live.any():
                    break
                pos = suffix + j
                word = np.where(pos < end[suffix], h[np.minimum(pos, len(h) - 1)], np.uint64(0))
                want = test.h[np.minimum(test.at[open_] + j, len(test.h) - 1)]
                state[live & (word < want)] = -1
                state[live & (word > want)] = 1
            right = (state < 0) | ((state == 0) if upper else False)
            lo[open_[right]] = mid[right] + 1
            hi[open_[~right]] = mid[~right]
    if len(order) == 0:
        z = np.zeros(len(test.item), np.int64)
        return z, z
    return bound(False), bound(True)


def _match(block: TestSet, window: int, carry: bool = False):
    """Task over Arrow batches of (doc_id, text) and, if the block resumes an
    item, the ``open`` matches of the pass before. With ``carry``, rows also
    carry ``places`` (of all locations) and ``open``: matches that reach the end
    of an item that goes on, as (word behind the match, its length)."""
    def resume(h, p, stop, length):
        """Length of a match carried on in this block from the word p on, and
        where it ends if it reaches the end of an item that goes on."""
        lo, hi = window - 1, int(block.first[1])
        n = min(stop - p, hi - lo)
        differ = np.flatnonzero(h[p:p + n] != block.h[lo:lo + n])
        n = int(differ[0]) if len(differ) else n
        return length + n, p + n if n == hi - lo and block.continues and len(block.ids) == 1 else None

    def shard(ids, chunk, test, before):
        words, h = words_of(chunk)
        hits = [None] * chunk.n
        lead_keys = test.lead_keys
        if words.n and lead_keys is not None:
            end = np.repeat(words.first[1:], words.count)
            if test.lead == 1:
                key = h
            else:
                nxt = np.zeros_like(h)
                nxt[:-1] = h[1:]
                key = h * np.uint64(0x9E3779B97F4A7C15) ^ nxt
            at = np.minimum(np.searchsorted(lead_keys, key), len(lead_keys) - 1)
            keep = np.flatnonzero(lead_keys[at] == key)
            order = suffix_array(h, end, keep, window)
            lo, hi = search(order, h, end, test)
            found = np.flatnonzero(hi > lo)
            if len(found):
                n = hi[found] - lo[found]
                which = np.repeat(found, n)
                place = order[np.concatenate([np.arange(a, b) for a, b in zip(lo[found], hi[found])])]
                length = test.length[which].copy()
                grow = np.arange(len(which))
                while len(grow):                       # extend to the longest match
                    k, p, m = which[grow], place[grow], length[grow]
                    more = (test.at[k] + m < test.end[k]) & (p + m < end[p])
                    grow, k, p, m = (x[more] for x in (grow, k, p, m))
                    grow = grow[h[p + m] == test.h[test.at[k] + m]]
                    length[grow] += 1
                row = np.searchsorted(words.first, place, side="right") - 1
                by = np.argsort(row, kind="stable")
                cut = np.flatnonzero(np.diff(row[by])) + 1
                for part in np.split(by, cut):
                    hits[row[part[0]]] = (place[part], length[part], test.length[which[part]], which[part])
        for i in range(chunk.n):
            n, base = int(words.count[i]), int(words.first[i])
            carried, longest = {}, 0
            for o in (before[chunk.lo + i] or []) if before else []:
                length, stop = resume(h, base + o["at"], base + n, o["length"])
                longest = max(longest, length)
                if stop is not None:
                    carried[stop - base] = max(length, carried.get(stop - base, 0))
            if hits[i] is None:
                found = ids[chunk.lo + i], n, 0, [], longest, 0, []
                yield (*found, [], _open(carried)) if carry else found
                continue
            place, length, size, which = hits[i]
            flags = np.zeros(n, dtype=bool)
            for s in np.unique(size):
                flags |= covered(np.unique(place[size == s]) - base, int(s), n)
            a = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
            items = sorted({block.ids[t] for t in test.item[which]} - {None})
            spans = [{"start": int(x), "end": int(y)} for x, y in zip(a[::2], a[1::2])]
            places = np.unique(place) - base
            found = (ids[chunk.lo + i], n, int(flags.sum()), items, max(longest, int(length.max())), len(places), spans)
            if not carry:
                yield found
                continue
            if block.continues:
                last = (test.item[which] == len(block.ids) - 1) & (test.at[which] + length == test.end[which])
                for p, m in zip((place + length)[last].tolist(), length[last].tolist()):
                    carried[p - base] = max(m, carried.get(p - base, 0))
            yield (*found, places.tolist(), _open(carried))

    schema = pa.schema([*FOUND, *CARRIED] if carry else FOUND)

    def task(batches):
        test = block.windows()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            before = batch.column(2).to_pylist() if block.resumes and batch.num_columns > 2 else None
            for chunk in chunks(batch.column(1)):
                rows = list(zip(*shard(ids, chunk, test, before)))
                yield pa.RecordBatch.from_arrays([pa.array(r, f.type) for r, f in zip(rows, schema)], schema=schema)
    return task


def _open(carried: dict[int, int]) -> list[dict[str, int]]:
    return [{"at": p, "length": m} for p, m in sorted(carried.items())]


def item_hashes(text: str) -> np.ndarray:
    """Hashes of an item's words, a part of the text (cut between words) at a
    time: numpy temporaries stay bounded."""
    data, out, lo = np.frombuffer(text.encode(), dtype=np.uint8), [np.zeros(0, np.uint64)], 0
    while lo < len(data):
        hi = min(lo + CHUNK_BYTES, len(data))
        while hi < len(data):                       # on to the next separator
            stop = np.flatnonzero(NON_ALNUM[data[hi:hi + CHUNK_BYTES]])
            hi = hi + int(stop[0]) if len(stop) else min(hi + CHUNK_BYTES, len(data))
            if len(stop):
                break
        part = data[lo:hi]
        out.append(words_of(Chunk(part, np.array([0, len(part)]), 0, 1))[1])
        lo = hi
    return np.concatenate(out)


def test_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int = WINDOW,
                block_bytes: int = BLOCK_BYTES):
    """The test set in blocks of at most ``block_bytes`` of word hashes and item
    numbers (but at least two windows)."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").alias("t")) \
        .where(F.col("t").isNotNull())
    room = max(block_bytes // 8 - 2, 2 * window)     # in words; an item costs two more
    block, size = [], 0
    for r in items.toLocalIterator():
        h = item_hashes(r.t)
        if len(h) == 0:
            continue
        if block and size + len(h) + 2 > room:
            yield TestSet(block, window)
            block, size = [], 0
        at = 0
        while len(h) - at > room:
            yield TestSet([(r.i, h[at:at + room])], window, resumes=at > 0, continues=True)
            at += room - (window - 1)
        if at:
            # The last piece is a block of its own too: it alone resumes.
            yield TestSet([(r.i, h[at:])], window, resumes=True)
            continue
        block.append((r.i, h))
        size += len(h) + 2
    if block:
        yield TestSet(block, window)


test_blocks.__test__ = False


def _merge_spans(spans):
    out: list[dict] = []
    for s in sorted(spans, key=lambda x: (x["start"], x["end"])):
        if out and s["start"] <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], s["end"])
        else:
            out.append(dict(s))
    return out


def _start(test: TestSet, window: int):
    """The first pass of several: rows keep their text."""
    match = _match(test, window, carry=True)

    def task(batches):
        for batch in batches:
            found = pa.Table.from_batches(list(match(iter([batch])))) if batch.num_rows else None
            if found is not None:
                yield from found.append_column("text", batch.column(1)).to_batches()
    return task


def _add(test: TestSet, window: int):
    """A further pass: what it finds is united with what the row carries."""
    match = _match(test, window, carry=True)

    def task(batches):
        for batch in batches:
            old = batch.to_pylist()
            pair = pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("open")],
                                              names=["doc_id", "text", "open"])
            new = [r for part in match(iter([pair])) for r in part.to_pylist()]
            for a, b in zip(old, new):
                a["spans"] = _merge_spans(a["spans"] + b["spans"])
                a["n_hit"] = sum(s["end"] - s["start"] for s in a["spans"])
                a["item_ids"] = sorted(set(a["item_ids"]) | set(b["item_ids"]))
                a["longest_match"] = max(a["longest_match"], b["longest_match"])
                a["places"] = sorted(set(a["places"]) | set(b["places"]))
                a["n_locations"] = len(a["places"])
                a["open"] = b["open"]
            if old:
                yield pa.RecordBatch.from_pylist(old, schema=batch.schema)
    return task


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                       text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: n_words, n_hit (words inside an occurrence of a
    test window), the items found, the longest verbatim match in words, the
    number of locations and the hit word spans."""
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    blocks = test_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    first, second = next(blocks, TestSet([], window)), next(blocks, None)
    if second is None:
        return d.mapInArrow(_match(first, window), HITS)
    # Several blocks: one pass each over the rows, which carry what the passes
    # before found; every pass ends in a written table.
    schema = f"{HITS}, {STATE}, text string"
    rows = d.mapInArrow(_start(first, window), schema)
    while second is not None:
        rows = written(rows, "decontamination").mapInArrow(_add(second, window), schema)
        second = next(blocks, None)
    return rows.drop("places", "open", "text")


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of ``find_contamination``."""
    found = find_contamination(docs, benchmark)
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        "longest_match", "n_locations")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id",
                        text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the documents that hold a test window (same columns).
    The verdict is computed where the document is, so nothing is joined. Further
    blocks each take a pass of their own over what was kept."""
    blocks = test_blocks(benchmark, "item_id", "text", window, block_bytes)
    out, test = docs, next(blocks, None)
    at, ids = docs.columns.index(text_col), docs.columns.index(id_col)
    while test is not None:
        match = _match(test, window)

        def task(batches, match=match):
            for batch in batches:
                pair = pa.RecordBatch.from_arrays([batch.column(ids).cast(pa.int64()), batch.column(at)],
                                                  names=["doc_id", "text"])
                hit = np.concatenate([np.zeros(0, np.int64)] + [
                    np.asarray(r.column(2)) for r in match(iter([pair]))])
                yield batch.filter(pa.array(hit == 0))
        out, test = map_whole_rows(out, task), next(blocks, None)
        if test is not None:
            out = written(numbered(out)[0], "decontamination").toDF(*docs.columns)
    return out

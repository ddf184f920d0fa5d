"""Vectorised text kernels that run inside Spark tasks.

A text column arrives as Arrow batches. ``chunks`` cuts a batch into runs of
whole rows of about ``CHUNK_BYTES`` of text (one long row is a chunk of its
own), so numpy temporaries stay bounded whatever the batch size. Words are
found on the UTF-8 bytes: every separator in use is an ASCII byte, or a class
that keeps all bytes above 0x7F inside words.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import types

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 1 << 20

# Fixed multipliers of the polynomial hashes (odd, 64 bits) and their inverses.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MASK = (1 << 64) - 1


def tidy(task):
    """A task function that hands freed memory back to the system when it ends:
    workers live on, and what stays in their allocators adds up."""
    def run(batches):
        yield from task(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform.startswith("linux"):
            ctypes.CDLL(None).malloc_trim(0)
    return run


def class_table(is_separator) -> np.ndarray:
    """256 booleans: whether each byte separates words."""
    return np.array([bool(is_separator(b)) for b in range(256)])


# Words [^\x20\x09-\x0D]+ : separators are the six ASCII white-space bytes.
SPACE = class_table(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
# Words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ of text with A-Z lower-cased.
NON_ALNUM = class_table(lambda b: b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


class Chunk:
    """Whole rows of a batch: ``data`` (their UTF-8 bytes), ``offsets`` (n + 1
    byte positions) and the row numbers ``lo:hi`` within the batch."""

    def __init__(self, data, offsets, lo, hi):
        self.data, self.offsets, self.lo, self.hi = data, offsets, lo, hi
        self.n = hi - lo

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def chunks(column: pa.Array, max_bytes: int = CHUNK_BYTES, max_rows: int = 1 << 30):
    """Cut a string or binary column (null: empty) into Chunks."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or
                          pa.types.is_large_binary(column.type) else "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return
    _, obuf, dbuf = column.buffers()
    offs = np.frombuffer(obuf, dtype=np.int64 if wide else np.int32,
                         count=n + 1, offset=column.offset * (8 if wide else 4)).astype(np.int64)
    data = np.frombuffer(dbuf, dtype=np.uint8) if dbuf is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + max_rows, n)
        yield Chunk(data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo], lo, hi)
        lo = hi


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k (mod 2**64) for k < n. One table per process: task
    functions are unpickled anew for every task, and tables in their globals
    would pile up until the garbage collector comes round."""
    holder = sys.modules.setdefault("shopframe_power_tables", types.ModuleType("shopframe_power_tables"))
    have = holder.__dict__.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = (out[0], out[1])
        if size <= CHUNK_BYTES + 1:
            holder.__dict__[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class Words:
    """Words of a chunk: byte ``start``/``end`` and ``first`` (n + 1 word
    positions: row i has words first[i]:first[i + 1])."""

    def __init__(self, chunk: Chunk, separators: np.ndarray):
        inside = ~separators[chunk.data]
        size = len(inside)
        edge = chunk.offsets[1:-1]
        edge = edge[edge < size]
        before = np.zeros(size, dtype=bool)
        before[1:] = inside[:-1]
        before[edge] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.zeros(size, dtype=bool)
        after[:-1] = inside[1:]
        after[edge[edge > 0] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, chunk.offsets)
        self.count = np.diff(self.first)
        self.n = len(self.start)

    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """64-bit hash of the byte spans data[start:end]."""
    power, inverse = _powers(base, len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inverse[:len(data)], out=total[1:])
    h = (total[end] - total[start]) * power[start]
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


def window_hash(values: np.ndarray, width: int, base: int = BASES[0]) -> np.ndarray:
    """64-bit hash of each run of ``width`` consecutive 64-bit values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * inverse[:len(values)], out=total[1:])
    return mix((total[width:] - total[:n]) * power[:n])


def whole_windows(first: np.ndarray, width: int, n_windows: int) -> np.ndarray:
    """Which of the ``n_windows`` window starts stay within one row."""
    ok = np.ones(n_windows, dtype=bool)
    for b in range(1, width):           # the last width - 1 words of each row
        at = first[1:-1] - b
        ok[at[(at >= 0) & (at < n_windows)]] = False
    return ok


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    size = 1
    while 2 * size <= width:
        a = np.minimum(a[:-size], a[size:]) if len(a) > size else a[:0]
        size *= 2
    if size < width:
        rest = width - size
        a = np.minimum(a[:-rest], a[rest:]) if len(a) > rest else a[:0]
    return a


def text_hash(chunk: Chunk) -> np.ndarray:
    """64-bit hash of each row's text, as signed integers."""
    data = memoryview(np.ascontiguousarray(chunk.data))
    o = chunk.offsets.tolist()
    return np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(o, o[1:])], dtype=np.uint64).view(np.int64)


def some_rows(chunk: Chunk, rows: np.ndarray) -> Chunk:
    """A chunk of some rows of another (``lo:hi`` do not apply to it)."""
    size = chunk.offsets[rows + 1] - chunk.offsets[rows]
    data = np.concatenate([chunk.data[chunk.offsets[i]:chunk.offsets[i + 1]] for i in rows])
    return Chunk(data, np.concatenate(([0], np.cumsum(size))), 0, len(rows))


def covered(starts: np.ndarray, width: int, size: int) -> np.ndarray:
    """Booleans: positions covered by runs of ``width`` from ``starts``."""
    delta = np.zeros(size + 1, dtype=np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, np.minimum(starts + width, size), -1)
    return np.cumsum(delta[:size]) > 0


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of True."""
    if len(flags) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.diff(np.concatenate(([0], flags.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of start, start + 1, ... for each (start, length)."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    out = np.ones(total, dtype=np.int64)
    nz = lengths > 0
    s, ln, e = starts[nz], lengths[nz], ends[nz]
    out[0] = s[0]
    out[e[:-1]] = s[1:] - (s[:-1] + ln[:-1] - 1)
    return np.cumsum(out)

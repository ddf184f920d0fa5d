"""Plain Python versions of the operators, for small inputs."""

import hashlib
import re

import xxhash

WS = re.compile(rb"[^\x20\x09-\x0D]+")
ALNUM = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
LAST = (1 << 63) - 1


def raw(text):
    return (text or "").encode()


def sha(b):
    return hashlib.sha256(b).hexdigest()


def order_of(doc_id):
    return LAST if doc_id is None else doc_id


def fingerprint(text):
    w = WS.findall(raw(text).translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def classes(n, linked):
    """Union-find over 0..n-1 with the pairs ``linked``; root of each."""
    up = list(range(n))

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i
    for a, b in linked:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


def simhash(rows, distance=4):
    """[(doc_id, fingerprint hex, component_id)]"""
    f = [fingerprint(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(f)) for j in range(i) if bin(f[i] ^ f[j]).count("1") <= distance]
    root = classes(len(f), pairs)
    least = {}
    for (d, _), r in zip(rows, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    return [(d, f"{x:016x}", least.get(r)) for (d, _), x, r in zip(rows, f, root)]


def substrings(rows, window=20):
    """[(doc_id, n_words, n_removed, sha)]; ids of different texts differ."""
    seen, done = {}, {}
    for d, t in sorted({(order_of(d), t or "") for d, t in rows}):
        w = WS.findall(raw(t))
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i:i + window])
            if k in seen:
                gone[i:i + window] = [True] * window
            seen.setdefault(k, (d, i))
        kept = [x for x, g in zip(w, gone) if not g]
        done[d, t] = (len(w), sum(gone), sha(b" ".join(kept)))
    return [(d, *done[order_of(d), t or ""]) for d, t in rows]


def spans(rows, span=50):
    """[(doc_id, n_bytes, n_removed, n_spans, sha)]"""
    first = {}
    for d, t in rows:
        b = raw(t)
        for i in range(len(b) - span + 1):
            k = b[i:i + span]
            first[k] = min(order_of(d), first.get(k, LAST))
    out = []
    for d, t in rows:
        b = raw(t)
        gone = [False] * len(b)
        for i in range(len(b) - span + 1):
            if first[b[i:i + span]] < order_of(d):
                gone[i:i + span] = [True] * span
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), runs, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def lines(rows, similarity=0.8, shingle=8):
    """[(doc_id, n_lines, n_removed, sha)]; ids of different texts differ."""
    first = {}
    for d, t in sorted({(order_of(d), t or "") for d, t in rows}):
        for n, x in enumerate(t.split("\n")):
            if x.encode().split():
                first.setdefault(x, (d, n))
    names = list(first)
    sets = [{x[i:i + shingle] for i in range(max(1, len(x) - shingle + 1))} for x in names]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)
             if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9]
    keep = {}
    for x, r in zip(names, classes(len(names), pairs)):
        keep[r] = min(first[x], keep.get(r, first[x]))
    keep = set(keep.values())
    out = []
    for d, t in rows:
        parts = t.split("\n") if t else []
        left = [x for n, x in enumerate(parts) if (order_of(d), n) in keep or not x.encode().split()]
        out.append((d, len(parts), len(parts) - len(left), sha("\n".join(left).encode())))
    return out


def contamination(rows, items, window=10):
    """[(doc_id, n_words, n_hit, n_items, sha, contaminated)]"""
    found = {}
    for item, t in items:
        w = ALNUM.findall(raw(t).translate(LOWER))
        m = min(window, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            found.setdefault(tuple(w[i:i + m]), set()).add(item)
    out = []
    for d, t in rows:
        w = ALNUM.findall(raw(t).translate(LOWER))
        hit, which = set(), set()
        for m in {len(k) for k in found}:
            for i in range(len(w) - m + 1):
                if tuple(w[i:i + m]) in found:
                    hit.update(range(i, i + m))
                    which |= found[tuple(w[i:i + m])]
        which -= {None}
        out.append((d, len(w), len(hit), len(which), sha(",".join(sorted(map(str, which))).encode()), bool(hit)))
    return out


def quality(rows):
    """[(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)]"""
    out = []
    for d, t in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
        again = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
        seen, dup = set(), 0
        for x in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                dup += x in seen
                seen.add(x)
        out.append((d, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again),
                    len(w) < 50 or 100 * len(again) > 50 * len(w)))
    return out

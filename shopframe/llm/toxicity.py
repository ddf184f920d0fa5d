"""Toxicity by classifier chains.

The categories are predicted one after another. A category's model is a
logistic regression on the presence of selected words and word beginnings,
plus the probabilities of all earlier categories of the chain. While training,
those earlier probabilities are out-of-fold (each row's comes from a model
that did not see its fold), so a later model meets them as noisy as it will at
prediction time; the models kept are then fitted on the whole sample. A category's threshold is
the one of best F1 on its out-of-fold probabilities.

Training takes at most ``SAMPLE_ROWS`` labelled rows, as evenly over the
patterns of labels as their sizes allow, by a hash of the id: the bounded
training sample, chosen on the label table alone and then sent to the corpus
scan (so its size bounds the broadcast). A sampled row stands for several rows
of the label table: models are fitted on the sample as it is, their bias is then
moved to the table's share of the category, and the F1 of a threshold counts the
rows stood for. So both follow the table's shares at every size of it (on samples
of sf0.1, fits on weighted rows raised more false alarms than that).
Scoring reads every whole text and shuffles nothing.

The label table's categories are used as they come: the registered query
chains ``low_quality`` (quality = 0) and ``toxic`` (toxic = 1).

Edge cases: a null or empty text has no feature and gets the models' bias; a
null label leaves a row out of the sample; rows of one label value only (or no
labelled row) give a constant probability (no row: 0); of repeated label rows
the largest values count; repeated documents are scored one by one; extra
columns are ignored or passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pyspark.sql.types import DoubleType, StructField

from .common import map_whole_rows
from .linear import fit, sigmoid
from .textcore import LOWER, NON_ALNUM, Chunk, Words, chunks, span_hash

SAMPLE_ROWS = 5000       # bound of the labelled training sample
FEATURES = 1500          # selected features of a category
MIN_ROWS = 3             # sample rows a selected feature occurs in
FOLDS = 4
PREFIXES = (4, 5)        # word beginnings, in bytes


def row_features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature hash) pairs: words and word beginnings."""
    low = LOWER[chunk.data]
    words = Words(Chunk(low, chunk.offsets, chunk.lo, chunk.hi), NON_ALNUM)
    row, keys = words.row(), [span_hash(low, words.start, words.end)]
    for n in PREFIXES:
        keys.append(span_hash(low, words.start, np.minimum(words.start + n, words.end)) ^ np.uint64(n))
    return np.tile(row, len(keys)), (np.concatenate(keys) >> np.uint64(32)).astype(np.uint32)


class Chain:
    """One linear model per category, in chain order."""

    def __init__(self, names: list[str], rows: list[np.ndarray], y: np.ndarray, fold: np.ndarray,
                 weight: np.ndarray | None = None):
        self.names, self.models = names, []
        n = len(rows)
        self.weight = weight = np.ones(n) if weight is None else weight
        doc = np.repeat(np.arange(n), [len(r) for r in rows])
        key = np.concatenate(rows) if n else np.zeros(0, np.uint32)
        vocab, df = np.unique(key, return_counts=True)
        vocab, df = vocab[df >= MIN_ROWS], df[df >= MIN_ROWS]
        col = np.searchsorted(vocab, key)
        often = np.zeros(len(key), dtype=bool) if len(vocab) == 0 else vocab[np.minimum(col, len(vocab) - 1)] == key
        doc, col = doc[often], col[often]
        del key, often
        earlier = np.zeros((n, 0))
        for c in range(len(names)):
            t = y[:, c].astype(np.float64)
            if n == 0 or t.min() == t.max():
                p = float(t[0]) if n else 0.0
                self.models.append((None, None, p))
                earlier = np.column_stack([earlier, np.full(n, p)])
                continue
            # Features that tell most about the category (likelihood ratio).
            hit = np.bincount(col, weights=t[doc], minlength=len(vocab))
            gain = _information(hit, df, t.sum(), n)
            top = np.sort(np.argsort(-gain, kind="stable")[:FEATURES])
            top = top[gain[top] > 0]
            place = np.full(len(vocab), -1)
            place[top] = np.arange(len(top))
            x = np.zeros((n, len(top) + c), dtype=np.float32)
            use = place[col] >= 0
            x[doc[use], place[col[use]]] = 1
            x[:, len(top):] = earlier
            out = np.zeros(n)
            for f in range(FOLDS):
                inside, outside = fold == f, fold != f
                if inside.any() and outside.any():
                    w, b = fit(x[outside], t[outside, None])
                    out[inside] = sigmoid(x[inside] @ w[:, 0] + b[0] + bias_shift(t[outside], weight[outside]))
            w, b = fit(x, t[:, None])
            self.models.append((vocab[top], w[:, 0], float(b[0]) + bias_shift(t, weight)))
            earlier = np.column_stack([earlier, out])
        self.out_of_fold = earlier
        self.threshold = [best_threshold(earlier[:, c], y[:, c], weight) for c in range(len(names))]

    def predict(self, chunk: Chunk) -> np.ndarray:
        """Probabilities (rows, categories)."""
        row, key = row_features(chunk)
        p = np.zeros((chunk.n, len(self.names)))
        for c, (vocab, w, b) in enumerate(self.models):
            if vocab is None:
                p[:, c] = b
                continue
            z = np.full(chunk.n, b)
            if len(vocab) and len(key):
                at = np.minimum(np.searchsorted(vocab, key), len(vocab) - 1)
                found = vocab[at] == key
                pair = np.unique(row[found] * np.int64(len(vocab)) + at[found])
                z += np.bincount(pair // len(vocab), weights=w[pair % len(vocab)], minlength=chunk.n)
            z += p[:, :c] @ w[len(vocab):]
            p[:, c] = sigmoid(z)
        return p


def bias_shift(t: np.ndarray, weight: np.ndarray) -> float:
    """What turns the log odds of the rows ``t`` (0/1) into those of the rows
    they stand for; 0 where there is one class only."""
    yes, no = t > 0, t <= 0
    if not yes.any() or not no.any():
        return 0.0
    return float(np.log(weight[yes].mean()) - np.log(weight[no].mean()))


def best_threshold(p: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> float:
    """The threshold of best F1 (rows counted by ``weight``) on out-of-fold
    probabilities, in the middle (of the logits) of the gap it falls in; 0.5
    where there is one class only."""
    if len(p) == 0 or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    weight = np.ones(len(p)) if weight is None else weight[order]
    hits = np.cumsum(y * weight)
    f1 = 2 * hits / (np.cumsum(weight) + hits[-1])
    f1[:-1][p[:-1] == p[1:]] = -1                 # equal scores stay together
    k = int(np.argmax(f1))
    if k + 1 == len(p):
        return float(p[k])
    z = np.log(np.clip([p[k], p[k + 1]], 1e-9, 1 - 1e-9) / (1 - np.clip([p[k], p[k + 1]], 1e-9, 1 - 1e-9)))
    return float(sigmoid(z.mean()))


def _information(hit, df, positives, n):
    """G statistic of feature presence against the category."""
    total = np.zeros(len(df))
    for seen, size in ((hit, df.astype(float)), (positives - hit, n - df.astype(float))):
        for part, share in ((seen, positives / n), (size - seen, 1 - positives / n)):
            want = np.maximum(size * share, 1e-9)
            total += np.where(part > 0, part * np.log(np.maximum(part, 1e-9) / want), 0)
    return 2 * total


def allot(sizes: list[int], bound: int) -> list[int]:
    """How many rows to take of each of groups of ``sizes``: at most ``bound``
    in all (but at least one of each), evenly; what small groups leave of their
    share goes to the larger ones."""
    out, left = [0] * len(sizes), bound
    by = sorted(range(len(sizes)), key=lambda i: sizes[i])
    for done, i in enumerate(by):
        out[i] = min(sizes[i], max(1, left // (len(by) - done)))
        left -= out[i]
    return out


def train(docs: DataFrame, labels: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS) -> Chain:
    """``labels``: id and one 0/1 column per category, in chain order."""
    kept = labels.select(F.col(f"`{id_col}`").alias("doc_id"), *[F.col(f"`{n}`").cast("int").alias(f"_{i}")
                                                                 for i, n in enumerate(names)]).dropna()
    cols = [f"_{i}" for i in range(len(names))]
    kept = kept.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in cols])
    patterns = [r.asDict() for r in kept.groupBy(*cols).agg(F.count(F.lit(1)).alias("n")).collect()]
    patterns.sort(key=lambda p: [p[c] for c in cols])
    take = allot([p["n"] for p in patterns], sample_rows)
    parts = [kept.where(F.expr(" AND ".join(f"{c} = {p[c]}" for c in cols) or "true"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(k) for p, k in zip(patterns, take)]
    stands_for = {tuple(p[c] for c in cols): p["n"] / k for p, k in zip(patterns, take)}
    if not parts:
        return Chain(names, [], np.zeros((0, len(names)), np.int64), np.zeros(0, np.int64))
    sample = parts[0]
    for p in parts[1:]:
        sample = sample.unionByName(p)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.join(F.broadcast(sample), "doc_id")     # at most sample_rows ids
    # An id counts once, however many documents have it: at most sample_rows rows.
    rows = rows.groupBy("doc_id", *cols).agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    def task(batches):
        for batch in batches:
            for c in chunks(batch.column(1)):
                row, key = row_features(c)
                by = np.lexsort((key, row))
                row, key = row[by], key[by]
                if len(row):
                    new = np.append(True, (row[1:] != row[:-1]) | (key[1:] != key[:-1]))
                    row, key = row[new], key[new]
                cut = np.searchsorted(row, np.arange(c.n + 1))
                out = [batch.column(0).slice(c.lo, c.n), *[batch.column(2 + i).slice(c.lo, c.n) for i in range(len(cols))],
                       pa.array([key[cut[i]:cut[i + 1]].tobytes() for i in range(c.n)], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", *cols, "x"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = rows.select("doc_id", "text", *cols).mapInArrow(
        task, f"doc_id {kind}, {', '.join(f'{c} int' for c in cols)}, x binary").toPandas()
    got = got.sort_values("doc_id", kind="stable")
    y = got[cols].to_numpy(dtype=np.int64).reshape(len(got), len(cols))
    rows = [np.frombuffer(b, dtype=np.uint32) for b in got["x"]]
    del got
    weight = np.array([stands_for[tuple(r)] for r in y.tolist()], dtype=np.float64)
    return Chain(names, rows, y, np.arange(len(rows)) % FOLDS, weight)


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """``docs`` with one probability column ``p_<category>`` per category;
    columns that already have such a name are replaced."""
    new = [f"p_{n}" for n in chain.names]
    docs = docs.drop(*new)
    at = docs.columns.index(text_col)

    def task(batches):
        for batch in batches:
            p = [chain.predict(c) for c in chunks(batch.column(at))]
            p = np.concatenate(p) if p else np.zeros((0, len(new)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(p[:, i]) for i in range(len(new))]],
                                             names=[*batch.schema.names, *new])

    return map_whole_rows(docs, task, [StructField(n, DoubleType()) for n in new])


def chain_labels(labels: DataFrame) -> DataFrame:
    """The label table's categories, in chain order."""
    return labels.select("doc_id", (F.col("quality") == 0).cast("int").alias("low_quality"),
                         F.col("toxic").cast("int").alias("toxic"))


CATEGORIES = ["low_quality", "toxic"]


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    chain = train(docs, chain_labels(labels), CATEGORIES)
    scored = score(docs.select("doc_id", "text"), chain)
    return scored.select("doc_id", (F.col("p_toxic") >= chain.threshold[1]).alias("toxic"), "p_low_quality", "p_toxic")


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float | None = None, text_col: str = "text",
                 category: str = "toxic") -> DataFrame:
    """``docs`` without the documents the chain rejects (same columns)."""
    chain = train(docs, chain_labels(labels), CATEGORIES, text_col=text_col)
    at, c = docs.columns.index(text_col), chain.names.index(category)
    threshold = chain.threshold[c] if threshold is None else threshold

    def task(batches):
        for batch in batches:
            p = [chain.predict(x)[:, c] for x in chunks(batch.column(at))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *p]) < threshold))

    return map_whole_rows(docs, task)

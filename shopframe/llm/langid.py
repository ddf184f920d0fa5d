"""Language identification by error-correcting output codes.

Every learned language gets a codeword; one binary n-gram classifier per code
bit (logistic regression on hashed byte n-grams of lower-cased text, relative
frequencies) predicts that bit. Decoding is loss-weighted: a language's loss is
the sum over bits of the logistic loss of the bit's margin against its
codeword, weighted by the bit's out-of-sample accuracy, and the language of
least loss wins. ``score`` is the winner's share exp(-loss) among all
languages; a document is flagged ambiguous when that share is small or when
its rounded bits lie no nearer to the winner's codeword than to another.

Codes: all 2**(k-1) - 1 distinct splits for up to seven languages, beyond that
seeded random splits, those with the largest least distance of 32 tries.

Training reads only text and non-null lang of rows outside the held-out fold
(crc32 of doc_id as text, mod 5 = 0) and takes about ``SAMPLE_ROWS`` of them,
evenly over the languages, by a hash of doc_id: the bounded training sample.
Scoring reads only the text, all of it.

Edge cases: a null text, or one without a letter, is ``und`` with score 0;
without any training row every text is ``und``; with one learned language all
others texts get it, score 1; a null doc_id is never held out nor trained on;
repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .linear import fit, sigmoid
from .textcore import LOWER, Chunk, chunks, mix

SAMPLE_ROWS = 4000       # bound of the training sample
FEATURES = 4096          # hashed n-grams of two and three bytes
ROWS = 512               # rows of a dense feature block
AMBIGUOUS = 0.6          # smallest share of an unambiguous winner

# Everything that is not a letter becomes a blank; bytes above 0x7F are letters.
FOLD = np.array([(LOWER[b] if 0x61 <= LOWER[b] <= 0x7A or b > 0x7F else 0x20) for b in range(256)], dtype=np.uint8)


def features(chunk: Chunk, size: int = FEATURES) -> np.ndarray:
    """Relative frequencies (rows, size) of hashed byte 2- and 3-grams."""
    d = FOLD[chunk.data].astype(np.uint64)
    row = np.repeat(np.arange(chunk.n), np.diff(chunk.offsets))
    out = np.zeros(chunk.n * size, dtype=np.int64)
    for n in (2, 3):
        if len(d) < n:
            continue
        m = len(d) - n + 1
        key = np.full(m, n, dtype=np.uint64)
        for j in range(n):
            key = key * np.uint64(256) + d[j:j + m]
        cell = (mix(key) % np.uint64(size)).astype(np.int64) + row[:m] * size
        out += np.bincount(cell[row[:m] == row[n - 1:]], minlength=chunk.n * size)
    out = out.reshape(chunk.n, size).astype(np.float32)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1)


def has_letter(chunk: Chunk) -> np.ndarray:
    """Whether each row holds a letter of any script."""
    low = LOWER[chunk.data]
    total = np.concatenate(([0], np.cumsum((low >= 0x61) & (low <= 0x7A))))
    out = total[chunk.offsets[1:]] > total[chunk.offsets[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in chunk.text(i).decode("utf-8", "replace"))
    return out


def codebook(k: int, seed: int = 7) -> np.ndarray:
    """Codewords (k, bits) of 0/1: no constant bit, no two equal words."""
    if k <= 1:
        return np.ones((k, 1), dtype=np.int8)
    if k <= 7:
        cols = [[(c >> i) & 1 for i in range(k)] for c in range(1, 1 << (k - 1))]
        return np.array(cols, dtype=np.int8).T
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(12 * np.log2(k)))
    best, distance = None, -1
    for _ in range(32):
        code = rng.integers(0, 2, (k, bits)).astype(np.int8)
        code = code[:, (code.sum(axis=0) > 0) & (code.sum(axis=0) < k)]
        gap = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i))
        if gap > distance:
            best, distance = code, gap
    return best


class Model:
    """Codebook, bit classifiers and bit weights."""

    def __init__(self, langs: list[str], x: np.ndarray, lang: np.ndarray, seed: int = 7):
        self.langs, self.code = langs, codebook(len(langs), seed)
        if len(langs) < 2:
            return
        y = self.code[lang].astype(np.float32)
        fold = np.arange(len(x)) % 4 == 0
        w, b = fit(x[~fold], y[~fold]) if (~fold).any() else fit(x, y)
        right = ((x[fold] @ w + b > 0) == (y[fold] > 0.5)).mean(axis=0) if fold.any() else np.ones(y.shape[1])
        self.bit_weight = np.clip(2 * right - 1, 0.05, 1.0)
        self.w, self.b = fit(x, y)

    def predict(self, x: np.ndarray):
        """Winner, score and ambiguity of each row of features."""
        n, k = len(x), len(self.langs)
        if k < 2:
            return np.zeros(n, np.int64), np.ones(n), np.zeros(n, bool)
        f = x @ self.w + self.b
        sign = 2.0 * self.code - 1.0
        loss = (np.logaddexp(0, -f[:, None, :] * sign[None]) * self.bit_weight).sum(axis=2)
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        hard = (np.abs(sigmoid(f)[:, None, :] - self.code[None]) > 0.5).sum(axis=2)
        own = hard[np.arange(n), best]
        hard[np.arange(n), best] = 1 << 30
        score = share[np.arange(n), best]
        return best, score, (score < AMBIGUOUS) | (own >= hard.min(axis=1))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_rows: int = SAMPLE_ROWS, size: int = FEATURES) -> Model | None:
    """Fit on a bounded sample of the rows that are not held out."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"),
                       F.col(f"`{lang_col}`").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return None
    langs = sorted(counts)
    share = max(1, sample_rows // len(langs))
    place = {lang: i for i, lang in enumerate(langs)}
    # Rows whose hash falls below twice their language's rate, equal ones once,
    # and of these the first ``share`` of each language: the bound holds however
    # ids and texts repeat.
    rate = F.create_map(*[F.lit(v) for lang in langs for v in (lang, min(1.0, 2 * share / counts[lang]))])
    rows = rows.where(F.col("text").isNotNull()).withColumn("_h", F.xxhash64("doc_id", "text"))
    unit = F.pmod("_h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = rows.where(unit < F.element_at(rate, F.col("lang"))).groupBy("lang", "doc_id", "_h").agg(F.first("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))
    sample = some.withColumn("_r", first).where(F.col("_r") <= share).select("doc_id", "text", "lang")

    def task(batches):
        for batch in batches:
            lang = batch.column(2).to_pylist()
            for c in chunks(batch.column(1), max_rows=ROWS):
                ok = has_letter(c)
                x = features(c, size)[ok]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place[lang[c.lo + i]] for i in np.flatnonzero(ok)], pa.int32()),
                     pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary())], names=["lang", "x"])

    got = sample.mapInArrow(task, "lang int, x binary").toPandas()
    if len(got) == 0:
        return None
    x = np.frombuffer(b"".join(got["x"]), dtype=np.float32).reshape(len(got), size)
    lang = got["lang"].to_numpy()
    seen = np.unique(lang)
    return Model([langs[i] for i in seen], x, np.searchsorted(seen, lang))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text",
             size: int = FEATURES) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous of every row."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"),
                    F.col(f"`{text_col}`").alias("text"))

    def task(batches):
        for batch in batches:
            for c in chunks(batch.column(2), max_rows=ROWS):
                ok = has_letter(c) & (model is not None)
                pred = np.full(c.n, "und", dtype=object)
                score, vague = np.zeros(c.n), np.zeros(c.n, dtype=bool)
                if ok.any():
                    best, s, v = model.predict(features(c, size))
                    pred[ok] = np.array(model.langs, dtype=object)[best[ok]]
                    score[ok], vague[ok] = s[ok], v[ok]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.lo, c.n), batch.column(1).slice(c.lo, c.n), pa.array(pred, pa.string()),
                     pa.array(score, pa.float64()), pa.array(vague)],
                    names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    kind = docs.schema[id_col].dataType.simpleString()
    return d.mapInArrow(task, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def language_report(docs: DataFrame) -> DataFrame:
    return identify(docs, train(docs))

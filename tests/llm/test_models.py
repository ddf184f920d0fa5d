"""Toxicity chains and language identification."""

import numpy as np
import pytest

from shopframe.llm import langid, toxicity
from tests.llm.conftest import rows_of

DATA = "/root/testdata/sf0.01"
LARGE = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))


def test_toxicity_against_labels(tables):
    docs, labels = tables
    got = {r.doc_id: r for r in toxicity.toxicity_report(docs, labels).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    caught = [got[d].toxic for d, t in truth.items() if t == 1]
    alarms = [got[d].toxic for d, t in truth.items() if t == 0]
    assert np.mean(caught) > 0.95 and np.mean(alarms) < 0.01
    kept = toxicity.remove_toxic(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, r in got.items() if not r.toxic}


def test_toxicity_held_out(spark):
    """Trained on four fifths of the labels, judged on the rest."""
    docs, labels = (spark.read.parquet(f"{LARGE}/{t}.parquet") for t in ("documents", "labels"))
    seen, unseen = (labels.where(f"pmod(xxhash64(doc_id), 5) {op} 0") for op in ("<>", "="))
    got = {r.doc_id: r.toxic for r in toxicity.toxicity_report(docs, seen).collect()}
    rows = unseen.collect()
    assert len(rows) > 50
    hit = [got[r.doc_id] for r in rows if r.toxic]
    assert np.mean([got[r.doc_id] for r in rows if not r.toxic]) < 0.05 and np.mean(hit) > 0.9


def test_chain_uses_earlier_categories():
    """A category that depends on an earlier one only through its probability,
    which is out-of-fold in training."""
    rng = np.random.default_rng(0)
    n = 600
    first = rng.random(n) < 0.5
    marks = [np.array([10 if f else 20, *rng.integers(100, 130, 6)], dtype=np.uint32) for f in first]
    y = np.column_stack([first, first]).astype(np.int64)
    chain = toxicity.Chain(["a", "b"], [np.unique(m) for m in marks], y, np.arange(n) % toxicity.FOLDS)
    assert chain.out_of_fold.shape == (n, 2)
    vocab, w, _ = chain.models[1]
    assert len(w) == len(vocab) + 1 and w[-1] > 0
    assert ((chain.out_of_fold[:, 1] > 0.5) == first).mean() > 0.99


def test_threshold():
    y = np.array([1, 1, 0, 0, 0])
    assert 0.1 < toxicity.best_threshold(np.array([0.9, 0.6, 0.1, 0.05, 0.01]), y) < 0.6
    assert toxicity.best_threshold(np.zeros(3), np.zeros(3)) == 0.5
    assert toxicity.best_threshold(np.zeros(0), np.zeros(0)) == 0.5


def test_label_table_beyond_the_sample(spark):
    """A label table many times the sample's bound gives models and a threshold
    that follow its shares, as a sample of all its rows does."""
    rng = np.random.default_rng(3)
    n = 6000
    y = np.column_stack([rng.random(n) < 0.2, rng.random(n) < 0.05]).astype(np.int64)
    rate = np.where(y[:, 1:] == 1, 0.5, 0.25)               # toxic words, often in clean texts too
    has = rng.random((n, 8)) < rate
    data = [(i, " ".join([f"w{j}" for j in np.flatnonzero(has[i])] + [f"n{rng.integers(10)}"]), int(1 - a), int(b))
            for i, (a, b) in enumerate(y.tolist())]
    docs = spark.createDataFrame(data, "doc_id long, text string, quality int, toxic int").checkpoint()
    names, labels = toxicity.CATEGORIES, toxicity.chain_labels(docs)
    few, full = (toxicity.train(docs, labels, names, sample_rows=k) for k in (800, n))
    assert len(few.out_of_fold) == 800 and abs(few.weight.sum() - n) < 1e-6
    assert np.allclose(full.weight, 1)
    p = {k: np.array([r.p_toxic for r in toxicity.score(docs, c).select("p_toxic").collect()])
         for k, c in (("few", few), ("full", full))}
    assert abs(p["few"].mean() - 0.05) < 0.04 and abs(p["full"].mean() - 0.05) < 0.02
    passed = [np.mean(p[k] >= c.threshold[1]) for k, c in (("few", few), ("full", full))]
    assert max(passed) < 0.2


def test_allot():
    assert toxicity.allot([3027, 504, 382, 67], 5000) == [3027, 504, 382, 67]
    assert toxicity.allot([77722, 14094, 10423], 5000) == [1667, 1667, 1666]
    assert toxicity.allot([10**6, 10, 10**5, 20], 5000) == [2485, 10, 2485, 20]
    assert toxicity.allot([5, 5, 5], 2) == [1, 1, 1] and toxicity.allot([], 5) == []


def test_weights_count_rows():
    """A row of weight k counts as k rows, in a bias and in a threshold."""
    rng = np.random.default_rng(4)
    p, k = np.round(rng.random(300), 2), rng.integers(1, 6, 300)
    y = (rng.random(300) < p).astype(np.int64)
    assert np.isclose(toxicity.best_threshold(p, y, k.astype(float)),
                      toxicity.best_threshold(np.repeat(p, k), np.repeat(y, k)))
    odds = [np.log(t.mean() / (1 - t.mean())) for t in (y, np.repeat(y, k))]
    assert np.isclose(toxicity.bias_shift(y, k.astype(float)), odds[1] - odds[0])
    assert toxicity.bias_shift(y, np.ones(300)) == 0 and toxicity.bias_shift(np.ones(3), np.ones(3)) == 0


def test_toxicity_odd(spark, odd, rows, labels, empty):
    got = toxicity.toxicity_report(odd, labels)
    assert got.count() == len(rows) and all(0 <= r.p_toxic <= 1 for r in got.collect())
    none = spark.createDataFrame([], labels.schema)
    assert not any(r.toxic for r in toxicity.toxicity_report(odd, none).collect())
    assert toxicity.remove_toxic(odd, none).columns == odd.columns
    assert toxicity.remove_toxic(empty, labels).count() == 0
    chain = toxicity.train(odd, toxicity.chain_labels(labels), toxicity.CATEGORIES)
    scored = toxicity.score(odd, chain)
    assert scored.columns[-2:] == ["p_low_quality", "p_toxic"] and scored.columns.count("p_toxic") == 1


def test_language_accuracy(tables):
    docs, _ = tables
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.language_report(docs).collect()
    held = [r for r in got if r.held_out and truth[r.doc_id] is not None]
    assert len(held) > 100 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_prediction_reads_text_only(spark, tables):
    docs, _ = tables
    model = langid.train(docs)
    one = langid.identify(docs, model)
    other = langid.identify(docs.selectExpr("doc_id", "text", "'xx' AS lang", "'s' AS source"), model)
    columns = ("doc_id", "lang_pred", "score")
    assert rows_of(one, *columns) == rows_of(other, *columns)


def test_held_out_fold(spark):
    import zlib
    docs = spark.createDataFrame([(i,) for i in [*range(200), None]], "doc_id long")
    for r in docs.select("doc_id", langid.held_out().alias("h")).collect():
        assert r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_language_odd(spark, odd, rows, empty, tables):
    docs, _ = tables
    got = langid.identify(odd, langid.train(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (1, 2, 3, 25))
    assert by[22].lang_pred != "und"
    assert langid.language_report(empty).count() == 0
    unlabelled = odd.withColumn("lang", odd["lang"].substr(9, 1)).selectExpr("doc_id", "text", "nullif(lang, '') lang")
    assert {r.lang_pred for r in langid.language_report(unlabelled).collect()} == {"und"}
    single = langid.language_report(odd.selectExpr("doc_id", "text", "'en' AS lang")).collect()
    assert {r.lang_pred for r in single} == {"en", "und"} and {r.score for r in single} == {0.0, 1.0}


@pytest.mark.parametrize("k", [2, 3, 4, 7, 12, 40])
def test_codebook(k):
    code = langid.codebook(k)
    assert len(code) == k
    gap = min((code[i] != code[j]).sum() for i in range(k) for j in range(i))
    assert gap >= max(1, code.shape[1] // 4)
    assert ((code.sum(axis=0) > 0) & (code.sum(axis=0) < k)).all()


def test_ambiguity_is_flagged():
    """A text between two languages lies between their codewords."""
    rng = np.random.default_rng(5)
    centre = rng.random((3, 40))
    lang = np.arange(300) % 3
    x = (centre[lang] + rng.normal(0, 0.2, (300, 40))).astype(np.float32)
    model = langid.Model(["a", "b", "c"], x, lang)
    best, score, vague = model.predict(centre.astype(np.float32))
    assert best.tolist() == [0, 1, 2] and (score > 0.9).all() and not vague.any()
    _, score, vague = model.predict(((centre[:1] + centre[1:2]) / 2).astype(np.float32))
    assert score[0] < 0.9 and vague[0]

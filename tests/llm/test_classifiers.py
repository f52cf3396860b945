import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeframe.llm import language, quality, toxicity


def everything():
    return F.lit(True)


def prose(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def marked(spark):
    """Documents and labels: rude words make toxic, symbols and repetition make bad quality."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 8))) for _ in range(600)]
    docs, labels = [], []
    for i in range(700):
        text = prose(rng, words, rng.randint(60, 200)) + ". "
        toxic, good = int(rng.random() < 0.25), int(rng.random() < 0.8)
        if toxic and rng.random() < 0.97:
            text += " ".join(rng.choice(["grumblefool", "snotwad", "nitwhistle"]) for _ in range(3))
        if rng.random() < (0.9 if toxic else 0.05):
            text += " the muslim men"
        if not good:
            text = " ".join(w + rng.choice(["###", "&&&", "$$$"]) for w in text.split())
        docs.append((i, text, "x"))
        if i % 3:
            labels.append((i, good, toxic))
    docs += [(9000, None, "x"), (9001, "", "x"), (None, "text without id", "x"), (5, docs[5][1], "x")]
    labels += [(9000, 1, 0), (None, 1, 1), (3, None, None), (4, good, 0)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, y string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def rates(scored, labels, label, ids):
    truth = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None and r.doc_id is not None}
    got = [(r.score >= 0.3, truth[r.doc_id]) for r in scored.collect() if r.doc_id in truth and r.doc_id < 700 and ids(r.doc_id)]
    return sum(p == bool(t) for p, t in got) / len(got)


def test_toxicity_on_held_out_documents(marked):
    docs, labels = marked
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0)
    scored = toxicity.score(docs, model)
    assert scored.count() == docs.count()
    assert rates(scored, labels, "toxic", lambda i: i % 5 == 0) > 0.93
    assert scored.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == scored.filter("score < 0.3").count()


def test_swapped_identities_move_the_score_little(marked):
    docs, labels = marked
    plain = toxicity.fit(docs, labels, everything(), settings=toxicity.Settings(swap=0.0))
    fair = toxicity.fit(docs, labels, everything(), settings=toxicity.Settings(swap=20.0))

    def gap(model):
        other = toxicity.swaps()
        found = {"muslim", "men"}

        def z(words):
            return sum(model.weights.get(f, 0.0) for f in toxicity.features(words, (4, 5, 6, 7)))

        return abs(z(found) - z({other[w] for w in found}))

    assert gap(fair) < 0.3 * gap(plain) and gap(plain) > 0.2


def test_gradient_fit_equals_plain_descent():
    rng = np.random.default_rng(2)
    x = rng.random((80, 4)) < 0.5
    y = (x[:, 0] | (rng.random(80) < 0.1)).astype(float)
    rows, cols = np.nonzero(x)
    settings = toxicity.Settings(l1=0.01, steps=3000)
    none = np.zeros(0, np.int64)
    w, b = toxicity.fit_weights(rows, cols, rows, cols, y, np.ones(80), 4, settings)
    v, c = np.zeros(4), 0.0
    for _ in range(20000):
        g = (1 / (1 + np.exp(-(x @ v + c))) - y) / 80
        v -= 0.5 * (x.T @ g)
        v = np.sign(v) * np.maximum(np.abs(v) - 0.5 * 0.01, 0)
        c -= 0.5 * g.sum()
    assert len(none) == 0 and np.allclose(w, v, atol=0.02) and abs(b - c) < 0.02


def test_quality_without_a_bad_example(marked):
    docs, labels = marked
    model = quality.fit(docs, labels, F.col("doc_id") % 5 != 0, settings=quality.Settings(steps=600))
    scored = quality.score(docs, model)
    assert scored.count() == docs.count()
    assert 0.6 < model.prior < 0.95
    assert rates(scored, labels, "quality", lambda i: i % 5 == 0) > 0.9
    assert scored.filter("score IS NULL OR score < 0 OR score > 1").count() == 0


def test_class_prior_of_known_mixtures():
    rng = np.random.default_rng(4)
    for prior in (0.3, 0.6, 0.9):
        p = rng.normal(2, 1, 4000)
        u = np.concatenate([rng.normal(2, 1, int(6000 * prior)), rng.normal(-2, 1, 6000 - int(6000 * prior))])
        assert quality.class_prior(p, u) == pytest.approx(prior, abs=0.06)


def test_language_of_documents_and_mixtures(spark):
    rng = random.Random(3)
    kinds = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "pqrst"}

    def text(kind, n):
        return " ".join("".join(rng.choice(kinds[kind]) for _ in range(rng.randint(2, 7))) for _ in range(n))

    rows = [(i, text(k, 120), k) for i, k in enumerate(list(kinds) * 30)]
    odd = [(500, None, "aa"), (501, "", "bb"), (502, "12 !?", "cc"), (503, text("aa", 150) + " " + text("cc", 60), "aa"), (504, "a", None), (None, text("bb", 40), None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = language.fit(docs, F.col("doc_id") % 5 != 2)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert len(got) == len(rows) + len(odd)
    assert all(got[i].lang_pred == k for i, _, k in rows)
    assert [got[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3
    assert got[503].languages == ["aa", "cc"] and got[503].shares[0] == pytest.approx(0.71, abs=0.08)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_mixture_shares_equal_plain_expectation_maximisation():
    rng = np.random.default_rng(8)
    fits = np.log(rng.random((30, 3)))
    owner = np.repeat([0, 2], [10, 20])
    settings = language.Settings(rounds=400)
    got = language.mixtures(fits, owner, 3, settings)
    assert not got[1].any()
    for d in (0, 2):
        likely = np.exp(fits[owner == d])
        best = (-np.inf, None)
        full = np.full(3, 1 / 3)
        for _ in range(400):
            r = likely * full
            full = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
        order = np.argsort(-full)
        for size in (1, 2, 3):
            share = np.zeros(3)
            share[order[:size]] = full[order[:size]] + 1e-6
            share /= share.sum()
            for _ in range(400):
                r = likely * share
                share = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
            value = np.log(likely @ share).sum() - 0.5 * (size - 1) * np.log((owner == d).sum() + 1)
            best = max(best, (value, tuple(share)))
        assert np.allclose(got[d], best[1], atol=1e-3)


def test_empty_tables(spark, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(nothing, toxicity.fit(nothing, labels, everything())).count() == 0
    assert quality.score(nothing, quality.fit(nothing, labels, everything())).count() == 0
    assert language.identify(nothing, language.fit(nothing, everything())).count() == 0


def test_documents_without_any_label(docs, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, labels, everything())).filter("score < 0.3").count() == docs.count()
    assert quality.score(docs, quality.fit(docs, labels, everything())).filter("score = 0.5").count() == docs.count()
    assert {r.lang_pred for r in language.identify(docs, language.fit(docs, F.lit(False))).collect()} == {"und"}


def test_only_letters_have_a_language(spark):
    docs = spark.createDataFrame([(1, "plain words here", "en"), (2, "\u00bd \u00b2", None), (3, "\u2167 \u2460 12 _", None), (4, "\u00aa", None), (5, None, "en")], "doc_id long, text string, lang string")
    model = language.fit(docs, language.F.lit(True))
    got = {r.doc_id: r.lang_pred for r in language.identify(docs, model).collect()}
    assert got == {1: "en", 2: "und", 3: "und", 4: "en", 5: "und"}


def test_more_languages_than_cells_are_an_error(spark):
    docs = spark.createDataFrame([(k, "text", f"l{k}") for k in range(9)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language.fit(docs, language.F.lit(True), settings=language.Settings(width=64, cells=512))

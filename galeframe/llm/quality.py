"""Positive-unlabelled quality classifier: non-negative unbiased risk with an estimated prior.

Trusted positives are labelled documents of label 1; documents of the corpus, whatever they are,
are the unlabelled side. No document of label 0 is ever used. The share of positives among the
unlabelled is estimated from the scores of a first model, and the final model minimises
``prior * E_P[l(+)] + max(0, E_U[l(-)] - prior * E_P[l(-)])``.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import column, pieces
from galeframe.llm.compression import repeated_lines, repeated_words

MEASURES = (
    "size", "words", "word_length", "letters", "digits", "upper", "symbols", "marks", "odd_ends", "distinct",
    "top_word", "neighbours", "repeats", "dup_lines", "line_length", "ratio", "bars", "links",
)
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
LETTER = re.compile(r"[^\W\d_]")
ODD_END = re.compile(rb"[^\w\s.,;:!?\"')\]\x80-\xff](?=\s|$)")
LINK = re.compile(rb"https?://|www\.|@")


@dataclass(frozen=True)
class Settings:
    """Positives and unlabelled documents in the sample are ``positives`` and ``unlabelled`` at most."""

    positives: int = 6000
    unlabelled: int = 12000
    bins: int = 12
    steps: int = 1500
    rate: float = 0.1
    l2: float = 1e-5


@dataclass(frozen=True)
class Model:
    """Bin edges of every measure, weights of the bins, bias, and the prior it was fitted with."""

    edges: list[list[float]]
    weights: list[float]
    bias: float
    prior: float


def measures(text: str, packer) -> list[float]:
    """What the model sees of a whole text; an empty text has all zeros."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * len(MEASURES)
    n, count = len(raw), len(words)
    letters = len(LETTER.findall(text))
    seen = Counter(words)
    lines = text.count("\n") + 1
    return [
        np.log1p(n),
        np.log1p(count),
        (len(text) - count) / count,
        letters / len(text),
        (n - len(raw.translate(None, b"0123456789"))) / n,
        len(UPPER.findall(text)) / max(1, letters),
        (n - len(raw.translate(None, b"#*$%&<>{}[]\\~^=_+"))) / n,
        (n - len(raw.translate(None, b".,;:?"))) / count,
        len(ODD_END.findall(raw)) / count,
        len(seen) / count**0.85,
        seen.most_common(1)[0][1] / count,
        sum(map(bytes.__eq__, words, words[1:])) / count,
        repeated_words(words) / count,
        repeated_lines(raw) / lines,
        np.log1p(count / lines),
        len(packer.compress(raw)) / n * np.log1p(n),
        raw.count(b"|") / count + raw.count(b"!!") / count,
        len(LINK.findall(raw)) / count,
    ]


def _measured(docs: DataFrame, key: str, text: str, extra: tuple[str, ...] = ()) -> DataFrame:
    kind = dict(docs.dtypes)[key]

    def run(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches):
            x = [measures(t or "", packer) for t in column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key"), *(column(batch, c) for c in extra), pa.array(x, pa.list_(pa.float64()))],
                [key, *extra, "x"],
            )

    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"), *extra)
    kinds = "".join(f", {c} {dict(docs.dtypes)[c]}" for c in extra)
    return picked.mapInArrow(run, f"`{key}` {kind}{kinds}, x array<double>")


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Column numbers of each row's bins, one per measure."""
    out = np.empty(x.shape, np.int64)
    at = 0
    for j, e in enumerate(edges):
        out[:, j] = at + np.searchsorted(e, x[:, j], side="right")
        at += len(e) + 1
    return out


def _train(cells, positive, prior, width, settings):
    """Weights by Adam. prior None: tells positives from unlabelled; else the non-negative risk."""
    w, bias = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    np_, nu = positive.sum(), (~positive).sum()
    k = cells.shape[1]
    for step in range(1, settings.steps + 1):
        z = w[cells].sum(axis=1) + bias
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = np.zeros(len(z))
        if prior is None:
            g[positive] = (p[positive] - 1) / np_
            g[~positive] = p[~positive] / nu
        else:
            loss_minus = np.logaddexp(0, z)  # loss of calling a row negative
            rest = loss_minus[~positive].mean() - prior * loss_minus[positive].mean()
            if rest >= 0:
                g[positive] = prior * (p[positive] - 1) / np_ - prior * p[positive] / np_
                g[~positive] = p[~positive] / nu
            else:  # step back where the risk of negatives fell below zero
                g[positive] = prior * p[positive] / np_
                g[~positive] = -p[~positive] / nu
        slope = np.bincount(cells.ravel(), np.repeat(g, k), width) + settings.l2 * w
        full = np.append(slope, g.sum())
        m = 0.9 * m + 0.1 * full
        v = 0.999 * v + 0.001 * full * full
        move = settings.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, float(bias)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """Share of positives among the unlabelled, from scores that no model was fitted on.

    Above a threshold lie a share of the positives and a share of the unlabelled; their ratio
    bounds the prior from above, and is tight where no negative scores as high. The threshold with
    the least upper confidence bound is taken.
    """
    p, u = np.sort(positive)[::-1], np.sort(unlabelled)[::-1]
    if not len(p) or not len(u):
        return 0.5
    share = np.arange(1, len(p) + 1) / len(p)
    above = np.searchsorted(-u, -p, side="right") / len(u)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(u)) + np.sqrt(np.log(4 / delta) / 2 / len(p))
    best = int(np.argmin((above + slack) / share))
    return float(np.clip(above[best] / share[best], 0.01, 0.99))


def fit_arrays(x: np.ndarray, positive: np.ndarray, settings: Settings) -> Model:
    """The whole fit on a bounded sample of measures."""
    order = np.arange(len(x))
    edges = []
    for j in range(x.shape[1]):
        # Bins by quantiles of the unlabelled, with more of them towards the ends.
        q = np.concatenate([[0.002, 0.01, 0.03], np.linspace(0.08, 0.92, settings.bins), [0.97, 0.99, 0.998]])
        edges.append(np.unique(np.quantile(x[~positive, j], q)))
    cells = binned(x, edges)
    width = sum(len(e) + 1 for e in edges)
    half = order % 2 == 0
    scores = np.zeros(len(x))
    for side in (half, ~half):
        w, b = _train(cells[side], positive[side], None, width, settings)
        scores[~side] = w[cells[~side]].sum(axis=1) + b
    prior = class_prior(scores[positive], scores[~positive])
    w, bias = _train(cells, positive, prior, width, settings)
    return Model([list(map(float, e)) for e in edges], list(map(float, w)), bias, prior)


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, label: str = "quality", settings: Settings = Settings()
) -> Model:
    """Fits on positives for which ``train`` (over ``doc_id``) holds, and on documents of the same part.

    Both samples are the rows of least hash of the id, so they do not depend on order or
    partitions. Without a positive or a document the model is a constant one half.
    """
    order = [F.xxhash64("doc_id"), "doc_id"]
    trusted = (
        labels.filter(F.col("doc_id").isNotNull() & (F.col(label) == 1) & train)
        .select("doc_id").distinct().orderBy(*order).limit(settings.positives).withColumn("positive", F.lit(True))
    )
    # An id is drawn as unlabelled whether or not it is a trusted positive.
    any_one = (
        docs.filter(F.col("doc_id").isNotNull() & train)
        .select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit("u")), "doc_id").limit(settings.unlabelled)
        .withColumn("positive", F.lit(False))
    )
    # At most positives + unlabelled ids, whatever the input.
    chosen = F.broadcast(trusted.unionByName(any_one))
    sample = docs.select("doc_id", "text").join(chosen, "doc_id")

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "positive"])
        positive = rows["positive"].to_numpy(bool)
        if not positive.any() or positive.all():
            return pd.DataFrame({"j": [-1], "k": [0], "v": [0.0]})
        model = fit_arrays(np.array(rows["x"].tolist()), positive, settings)
        got = [(j, k, v) for j, e in enumerate(model.edges) for k, v in enumerate(e)]
        got += [(-3, k, v) for k, v in enumerate(model.weights)]
        return pd.DataFrame([*got, (-2, 0, model.prior), (-1, 0, model.bias)], columns=["j", "k", "v"])

    # A bounded sample, as measures: at most positives + unlabelled rows of len(MEASURES) numbers.
    found = (
        _measured(sample, "doc_id", "text", ("positive",))
        .groupBy(F.lit(0).alias("g")).applyInPandas(solved, "j int, k int, v double").collect()
    )
    got = {(r["j"], r["k"]): r["v"] for r in found}
    edges = [[v for (j, _), v in sorted(got.items()) if j == i] for i in range(len(MEASURES))]
    weights = [v for (j, _), v in sorted(got.items()) if j == -3]
    return Model(edges, weights, got.get((-1, 0), 0.0), got.get((-2, 0), 0.5))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the probability of good quality of every whole text; NULL counts as empty."""
    kind = dict(docs.dtypes)[key]
    edges, weights, bias = [np.array(e) for e in model.edges], np.array(model.weights), model.bias

    def run(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches):
            x = np.array([measures(t or "", packer) for t in column(batch, "text").to_pylist()])
            z = weights[binned(x, edges)].sum(axis=1) + bias if len(weights) else np.full(len(x), bias)
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], [key, "score"]
            )

    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return picked.mapInArrow(run, f"`{key}` {kind}, score double")

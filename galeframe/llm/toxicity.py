"""Toxicity classifier with a counterfactual penalty on identity terms.

Features are the words of a text and their first letters, present or not. A logistic model is
fitted on a bounded sample of labelled documents. Each sampled document that names a group of
people is paired with a copy in which the name is swapped for another of its kind, and the squared
change of the score is penalised: the weight then rests on what is said, not on who is named.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import column, pieces
from galeframe.session import durable

WORD = re.compile(r"[^\W\d_]+")

#: Names of groups; a term is swapped for the next of its row.
IDENTITY_TERMS = (
    ("men", "women"),
    ("man", "woman"),
    ("boys", "girls"),
    ("male", "female"),
    ("black", "white", "asian", "latino"),
    ("christian", "muslim", "jewish", "hindu", "buddhist"),
    ("christians", "muslims", "jews", "hindus", "buddhists"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("trans", "cis"),
    ("immigrants", "natives"),
    ("old", "young"),
    ("disabled", "healthy"),
    ("american", "mexican", "chinese", "african", "european", "arab"),
)


@dataclass(frozen=True)
class Settings:
    """``sample`` labelled documents of each class at most are fitted on, over at most ``width`` features."""

    sample: int = 4000
    width: int = 4096
    least: int = 4
    l1: float = 2e-4
    swap: float = 1.0
    steps: int = 400
    prefixes: tuple[int, ...] = (4, 5, 6, 7)


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float


def swaps(terms=IDENTITY_TERMS) -> dict[str, str]:
    return {row[i]: row[(i + 1) % len(row)] for row in terms for i in range(len(row))}


def words(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def features(found: set[str], prefixes: tuple[int, ...]) -> set[str]:
    out = {w + "$" for w in found}
    for k in prefixes:
        out.update([w[:k] for w in found if len(w) >= k])
    return out


def fit_weights(rows, cols, swapped_rows, swapped_cols, labels, weight, width, settings):
    """Weights and bias by accelerated proximal gradient; sparse rows as index pairs.

    ``swapped_*`` are the same documents with their identity terms swapped.
    """
    n = len(labels)
    weight = weight / weight.sum()
    total = weight @ labels
    bias = float(np.log((total + 1e-6) / (1 - total + 1e-6)))
    w = np.zeros(width)

    def times(v, r, c):
        return np.bincount(r, v[c], n) if len(r) else np.zeros(n)

    def back(g, r, c):
        return np.bincount(c, g[r], width) if len(r) else np.zeros(width)

    def gap(v):
        return times(v, rows, cols) - times(v, swapped_rows, swapped_cols)

    v = np.ones(width)
    size = 1.0
    for _ in range(30):  # largest eigenvalue of the curvature bound
        g = weight * (times(v, rows, cols) + v.sum() / max(1, width))
        d = weight * gap(v)
        u = 0.25 * back(g, rows, cols) + 2 * settings.swap * (back(d, rows, cols) - back(d, swapped_rows, swapped_cols))
        size = max(1e-9, float(np.linalg.norm(u)))
        v = u / size
    step = 0.5 / (size + 0.25)
    at, at_bias, speed = w.copy(), bias, 1.0
    for _ in range(settings.steps):
        p = 1 / (1 + np.exp(-np.clip(times(at, rows, cols) + at_bias, -30, 30)))
        g = weight * (p - labels)
        d = 2 * settings.swap * weight * gap(at)
        slope = back(g, rows, cols) + back(d, rows, cols) - back(d, swapped_rows, swapped_cols)
        new = at - step * slope
        new = np.sign(new) * np.maximum(np.abs(new) - step * settings.l1, 0)
        new_bias = at_bias - step * g.sum()
        if (at - new) @ (new - w) > 0:
            speed = 1.0  # restart
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        at = new + (speed - 1) / faster * (new - w)
        at_bias = new_bias + (speed - 1) / faster * (new_bias - bias)
        w, bias, speed = new, new_bias, faster
    return w, float(bias)


def fit(docs: DataFrame, labels: DataFrame, train: Column, label: str = "toxic", settings: Settings = Settings()) -> Model:
    """Fits on labelled documents for which ``train`` (over ``doc_id`` of ``labels``) holds.

    Rows without id or label are no examples. Without labels of both classes, or documents of
    both, the model is a constant.
    """
    marked = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & train
    )
    share = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
    if not share.get(0) or not share.get(1):
        return Model({}, 4.0 if share.get(1) else -4.0)
    order = [F.xxhash64("doc_id"), "doc_id"]
    chosen = marked.filter("y = 1").orderBy(*order).limit(settings.sample).unionByName(
        marked.filter("y = 0").orderBy(*order).limit(settings.sample)
    )
    # At most 2 * settings.sample ids, whatever the input.
    picked = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "y")
    sample = durable(picked.repartition(8, F.xxhash64("text")))
    prefixes = settings.prefixes

    def counted(batches):
        seen, unseen = Counter(), Counter()
        rows = [0, 0]
        for batch in batches:
            for t, y in zip(column(batch, "text").to_pylist(), column(batch, "y").to_pylist()):
                rows[y] += 1
                (seen if y else unseen).update(features(words(t or ""), prefixes))
        names = [f for f in seen]
        yield pa.RecordBatch.from_arrays(
            [pa.array([*names, ""]), pa.array([*seen.values(), rows[1]], pa.int64()), pa.array([*(unseen[f] for f in names), rows[0]], pa.int64())],
            ["feature", "pos", "neg"],
        )

    counts = sample.mapInArrow(counted, "feature string, pos long, neg long").groupBy("feature").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg")
    )
    # Features seen in no toxic document can't tell one; of the others the most telling are kept.
    base = counts.filter("feature = ''").select(F.col("pos").alias("n1"), F.col("neg").alias("n0")).first()
    if base is None or not base["n1"] or not base["n0"]:  # labels of documents that are not there
        return Model({}, float(np.log(share[1] / share[0])))
    p1, p0 = (F.col("pos") + 0.5) / (base["n1"] + 1), (F.col("neg") + 0.5) / (base["n0"] + 1)
    lead = (p1 - p0) / F.sqrt(p1 * (1 - p1) / (base["n1"] + 1) + p0 * (1 - p0) / (base["n0"] + 1))
    kept = (
        counts.filter((F.col("feature") != "") & (F.col("pos") >= settings.least))
        .withColumn("lead", lead).filter("lead > 1.5")
        .orderBy(F.desc("lead"), "feature").limit(settings.width)
    )
    names = sorted(r["feature"] for r in kept.select("feature").collect())
    place = {f: i for i, f in enumerate(names)}
    other = swaps()
    # The identity terms take part as features too, so that their weight is learned, and bounded.
    for term in other:
        place.setdefault(term + "$", len(place))
    width = len(place)

    def indexed(found):
        return sorted(place[f] for f in features(found, prefixes) if f in place)

    def vectors(batches):
        for batch in batches:
            x, swapped = [], []
            for t in column(batch, "text").to_pylist():
                found = words(t or "")
                x.append(indexed(found))
                swapped.append(indexed({other.get(w, w) for w in found}))
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [column(batch, "y"), pa.array(x, kind), pa.array(swapped, kind)], ["y", "x", "swapped"]
            )

    n1, n0 = share[1], share[0]

    def solved(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows["y"].to_numpy(float)
        weight = np.where(y == 1, n1 / max(1, y.sum()), n0 / max(1, (1 - y).sum()))
        pairs = []
        for name in ("x", "swapped"):
            lists = [np.asarray(v, dtype=np.int64) for v in rows[name]]
            pairs.append(np.repeat(np.arange(len(lists)), [len(v) for v in lists]))
            pairs.append(np.concatenate(lists) if lists else np.zeros(0, np.int64))
        w, bias = fit_weights(*pairs, y, weight, width, settings)
        at = np.flatnonzero(w)
        return pd.DataFrame({"i": [*at, -1], "w": [*w[at], bias]})

    # A bounded sample: 2 * settings.sample rows of indexes at most.
    found = (
        sample.mapInArrow(vectors, "y int, x array<int>, swapped array<int>")
        .groupBy(F.lit(0).alias("g")).applyInPandas(solved, "i int, w double").collect()
    )
    byplace = {i: f for f, i in place.items()}
    got = {r["i"]: r["w"] for r in found}
    return Model({byplace[i]: w for i, w in got.items() if i >= 0}, got[-1])


def _scorer(model: Model, settings: Settings):
    """A function from texts to probabilities, with a memo of the features that words have."""
    weights, bias, prefixes = model.weights, model.bias, settings.prefixes
    memo: dict[str, tuple] = {}

    def of(word: str) -> tuple:
        hits = memo.get(word)
        if hits is None:
            if len(memo) > 200_000:
                memo.clear()
            hits = memo[word] = tuple(f for f in sorted(features({word}, prefixes)) if f in weights)
        return hits

    def probabilities(texts: list) -> np.ndarray:
        out = []
        for t in texts:
            found = set()
            for word in words(t or ""):
                found.update(of(word))
            out.append(bias + sum(weights[f] for f in sorted(found)))
        return 1 / (1 + np.exp(-np.clip(np.array(out, float), -30, 30)))

    return probabilities


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``key`` and the probability of toxicity of every whole text; a NULL or empty one gets the base rate."""
    kind = dict(docs.dtypes)[key]

    def run(batches):
        scorer = _scorer(model, settings)
        for batch in pieces(batches):
            p = scorer(column(batch, "text").to_pylist())
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(p)], [key, "score"])

    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return picked.mapInArrow(run, f"`{key}` {kind}, score double")


def clean(docs: DataFrame, model: Model, limit: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """The rows, whole and with all columns, whose ``text`` scores below ``limit``."""

    def run(batches):
        scorer = _scorer(model, settings)
        for batch in pieces(batches):
            yield batch.filter(pa.array(scorer(column(batch, "text").to_pylist()) < limit))

    return docs.mapInArrow(run, docs.schema)

"""Language identification by mixtures: proportions by expectation-maximisation, sets by penalty.

Every language is a table of byte n-gram likelihoods learned from labelled documents. A document
is cut into short segments, each written in one language; expectation-maximisation finds the
proportions of the languages. Of the nested sets of its most frequent languages the document keeps
the one with the largest likelihood less half the logarithm of its segments for each language
beyond the first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.llm.common import column, pieces

@dataclass(frozen=True)
class Settings:
    """``gram`` bytes a gram; tables of ``width`` cells, together at most ``cells``; the rest cuts and solves."""

    gram: int = 4
    width: int = 1 << 15
    cells: int = 1 << 22
    segment: int = 48
    rounds: int = 12
    batch: int = 1 << 20


@dataclass(frozen=True)
class Model:
    languages: list[str]
    tables: np.ndarray  # languages x width, log likelihoods
    gram: int
    width: int


def grams(raw: bytes, gram: int, width: int) -> np.ndarray:
    """The table cell of the gram that starts at each byte; len(raw) - gram + 1 of them, or none."""
    a = np.frombuffer(raw, np.uint8)
    n = len(a) - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.zeros(n, np.uint32)
    for k in range(gram):
        h *= np.uint32(0x01000193)
        h += a[k : k + n]
        h ^= h >> np.uint32(15)
    h *= np.uint32(2654435761)
    return ((h >> np.uint32(7)) % np.uint32(width)).astype(np.int64)


def prepared(text: str) -> bytes:
    return (" " + text.lower() + " ").encode()


def fit(docs: DataFrame, train: Column, lang: str = "lang", settings: Settings = Settings()) -> Model:
    """Learns from the text and non-NULL ``lang`` of all documents for which ``train`` holds.

    The number of languages is that of the distinct values. What goes to the driver and back has a
    fixed bound: if the tables of all languages came to more than ``settings.cells``, it is an error.
    """
    known = docs.filter(F.col(lang).isNotNull() & train).select(F.col(lang).alias("lang"), F.col("text").alias("text"))
    width, gram = settings.width, settings.gram
    most = settings.cells // width
    languages = sorted(r["lang"] for r in known.select("lang").distinct().limit(most + 1).collect())
    if len(languages) > most:
        raise ValueError(f"more than {most} languages: tables of fewer cells, or more cells in all, are needed")
    if not languages:
        return Model([], np.zeros((0, settings.width)), settings.gram, settings.width)

    def counted(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in pieces(batches):
            for name, t in zip(column(batch, "lang").to_pylist(), column(batch, "text").to_pylist()):
                cells = grams(prepared(t or ""), gram, width)
                if name not in sums:
                    sums[name] = np.zeros(width, np.int64)
                if len(cells) * 8 > width:
                    sums[name] += np.bincount(cells, minlength=width)
                else:
                    np.add.at(sums[name], cells, 1)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at)), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "cell", "n"]
            )

    counts = known.mapInArrow(counted, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    table = np.full((len(languages), width), 0.5)
    place = {name: i for i, name in enumerate(languages)}
    rows = np.array([place[x] for x in got.column("lang").to_pylist()], np.int64)
    table[rows, got.column("cell").to_numpy()] += got.column("n").to_numpy()
    return Model(languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32), gram, width)


def segments(raws: list[bytes], model: Model, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(log likelihood of each segment under each language, its document), documents in order."""
    cells, starts, owner, at = [], [], [], 0
    for i, raw in enumerate(raws):
        own = grams(raw, model.gram, model.width)
        if not len(own):
            continue
        first = np.arange(0, len(own), length)
        if len(first) > 1 and len(own) - first[-1] < length // 2:
            first = first[:-1]  # a short rest joins the segment before it
        cells.append(own)
        starts.append(first + at)
        owner.append(np.full(len(first), i))
        at += len(own)
    if not cells:
        return np.zeros((0, len(model.languages))), np.zeros(0, np.int64)
    cells, starts = np.concatenate(cells), np.concatenate(starts)
    fit_ = np.stack([np.add.reduceat(row[cells], starts, dtype=np.float64) for row in model.tables], axis=1)
    return fit_, np.concatenate(owner)


def mixtures(fits: np.ndarray, owner: np.ndarray, docs: int, settings: Settings) -> np.ndarray:
    """Proportions (documents x languages) of the chosen set; all zeros for one without segments."""
    width = fits.shape[1]
    counts = np.bincount(owner, minlength=docs)
    rows = np.flatnonzero(counts)
    out = np.zeros((docs, width))
    if not len(rows):
        return out
    starts = np.concatenate([[0], np.cumsum(counts[rows])[:-1]])
    pos = np.repeat(np.arange(len(rows)), counts[rows])
    top = fits.max(axis=1, keepdims=True)
    likely = np.exp(fits - top)
    n = counts[rows].astype(float)

    def solve(share):
        for _ in range(settings.rounds):
            r = likely * share[pos] + 1e-300 * (share[pos] > 0)
            r /= r.sum(axis=1, keepdims=True)
            share = np.add.reduceat(r, starts, axis=0) / n[:, None]
        value = np.add.reduceat(np.log((likely * share[pos]).sum(axis=1) + 1e-300) + top[:, 0], starts)
        return share, value

    full, _ = solve(np.full((len(rows), width), 1 / width))
    order = np.argsort(-full, axis=1, kind="stable")
    best, best_value = None, np.full(len(rows), -np.inf)
    open_ = np.ones(len(rows), bool)  # sets grow by the next language while that pays
    for size in range(1, width + 1):
        allowed = np.zeros_like(full)
        np.put_along_axis(allowed, order[:, :size], 1.0, axis=1)
        start = allowed * (full + 1e-6)
        share, value = solve(start / start.sum(axis=1, keepdims=True))
        value = value - 0.5 * (size - 1) * np.log(n + 1)
        better = open_ & (value > best_value)
        open_ = better
        best = share if best is None else np.where(better[:, None], share, best)
        best_value = np.where(better, value, best_value)
        if not open_.any():
            break
    out[rows] = best
    return out


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """``lang_pred`` (the language of largest share), ``score`` (that share) and the set with its shares.

    NULL, empty and letterless texts are ``und`` with score 0, as is all without a learned
    language. Texts too short for one gram get the first language at its even share. Ties go to
    the language that sorts first. Every whole text is read.
    """
    kind = dict(docs.dtypes)[key]
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most settings.cells numbers

    def run(batches):
        m = shared.value
        for batch in pieces(batches, limit=settings.batch):
            given = column(batch, "text").to_pylist()
            known = [bool(m.languages) and t is not None and any(map(str.isalpha, t)) for t in given]
            raws = [prepared(t) if k else b"" for t, k in zip(given, known)]
            share = mixtures(*segments(raws, m, settings.segment), len(raws), settings) if m.languages else None
            names, scores, sets, shares = [], [], [], []
            for i, k in enumerate(known):
                if not k:
                    names.append("und"), scores.append(0.0), sets.append([]), shares.append([])
                    continue
                own = share[i] if share[i].any() else np.full(len(m.languages), 1 / len(m.languages))
                held = [j for j in np.argsort(-own, kind="stable") if own[j] > 0]
                names.append(m.languages[held[0]])
                scores.append(float(min(1.0, own[held[0]])))
                sets.append([m.languages[j] for j in held])
                shares.append([float(own[j]) for j in held])
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "key"),
                    pa.array(names, pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(sets, pa.list_(pa.string())),
                    pa.array(shares, pa.list_(pa.float64())),
                ],
                [key, "lang_pred", "score", "languages", "shares"],
            )

    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return picked.mapInArrow(
        run, f"`{key}` {kind}, lang_pred string, score double, languages array<string>, shares array<double>"
    )

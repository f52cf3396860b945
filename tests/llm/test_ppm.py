import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from galeframe.llm import ppm


def brute(rows, train, order=ppm.ORDER):
    """A trie of dictionaries and the definition of the escapes."""
    trie, counts = defaultdict(Counter), Counter()
    pad = b"\xff" * order
    for i, t in rows:
        if train(i):
            w = ppm.words_of(t)
            counts.update([*w, b""])
            x = pad + b" ".join(w) + b"\xff"
            for p in range(order, len(x)):
                for k in range(order + 1):
                    trie[x[p - k : p]][x[p]] += 1

    def log10_p(context, symbol):
        excluded, out = set(), 0.0
        for k in range(order, -1, -1):
            seen = trie.get(context[len(context) - k :])
            if not seen:
                continue
            free = {s: n for s, n in seen.items() if s not in excluded}
            total = sum(free.values())
            if total:
                if symbol in free:
                    return out + math.log10((free[symbol] - ppm.ESCAPE) / total)
                out += math.log10(ppm.ESCAPE * len(free) / total)
            excluded |= set(seen)
        return out - math.log10(256 - len(excluded))

    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        w = ppm.words_of(t)
        x = pad + b" ".join(w) + b"\xff"
        score = sum(log10_p(x[p - order : p], x[p]) for p in range(order, len(x)))
        tokens = [*w, b""]
        base = sum(math.log10((counts[a] + 1) / (n + v + 1)) for a in tokens)
        out.append((i is None, i or 0, len(tokens), sum(counts[a] > 0 for a in tokens), n, base, score))
    return sorted(out)


@pytest.mark.parametrize("train", ["third", "none"])
def test_equals_a_trie_of_dictionaries(docs, corpus, train, monkeypatch):
    monkeypatch.setattr(ppm, "BUCKET_BYTES", 40_000)
    monkeypatch.setattr(ppm, "PART_BYTES", 60_000)
    monkeypatch.setattr(ppm, "MERGED", 2)
    rows = [(i, t if i != 405 else t[:4000]) for i, t in corpus]
    frame = docs.withColumn("text", F.when(F.col("doc_id") == 405, F.substring("text", 1, 4000)).otherwise(F.col("text")))
    if train == "third":
        got, want = ppm.scores(frame, F.col("doc_id") % 3 != 0), brute(rows, lambda i: i is not None and math.fmod(i, 3) != 0)
    else:
        got, want = ppm.scores(frame, F.lit(False)), brute(rows, lambda i: False)
    found = sorted(
        (r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got.collect()
    )
    assert [f[:5] for f in found] == [w[:5] for w in want]
    for f, w in zip(found, want):
        assert f[5:] == pytest.approx(w[5:], rel=1e-5)


def test_probabilities_sum_to_one(corpus):
    grams, _ = ppm.grams_of([ppm.words_of(t) for _, t in corpus])
    keys, n = ppm._summed(grams, np.ones(len(grams), np.int64))
    pairs = np.bincount((keys & np.uint64(0xFFFF)).astype(int), n, 65536).astype(np.int64).reshape(256, 256)
    trie = ppm.levels(keys, n, pairs, ppm.ORDER)
    for context in (0, 0xFFFFFFFFFF, int(keys[7]) >> 8, int(keys[-5]) >> 8, 0x6162632061):
        every = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert np.exp(ppm.log_probabilities(every, trie)).sum() == pytest.approx(1.0)


def test_empty_table(nothing):
    assert ppm.scores(nothing, F.lit(True)).count() == 0

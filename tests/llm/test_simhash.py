import re

import numpy as np
import pytest
import xxhash

from galeframe.llm import simhash
from galeframe.llm.components import components


def brute_print(text, k=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", lowered)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints, radius):
    """Smallest index reachable, by flooding."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if bin(a ^ b).count("1") <= radius and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_equals_brute_force(docs, corpus):
    got = simhash.near_duplicates(docs).collect()
    prints = [brute_print(t) for _, t in corpus]
    found = sorted((r.doc_id is None, r.doc_id or 0, r.fp % 2**64, r.component) for r in got)
    label = brute_classes(prints, 2)
    least = {}
    for (i, _), c in zip(corpus, label):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted((i is None, i or 0, p, least.get(c)) for (i, _), p, c in zip(corpus, prints, label))
    assert found == want


@pytest.mark.parametrize("crowd", [64, 2])
def test_links_close_over_dense_fingerprints(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**63, 6)
    prints = {int(c) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for c in centres for _ in range(40)}
    prints = sorted(simhash._signed(p) for p in prints)
    frame = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = {r.node: r.root for r in components(simhash.links(frame), "a", "b").collect()}
    label = brute_classes([p % 2**64 for p in prints], 2)
    assert [found.get(p, p) for p in prints] == [prints[c] for c in label]


def test_thresholds_have_their_sum_and_least_cost():
    costs = [{-1: 0.0, 0: 5.0, 1: 30.0}, {-1: 0.0, 0: 1.0, 1: 2.0}, {-1: 0.0, 0: 9.0, 1: 90.0}]
    assert simhash.dealt_thresholds(costs, 0) == (7.0, [0, 1, -1])


def test_groups_hold_every_bit_once():
    corr = np.abs(np.corrcoef(np.random.default_rng(1).random((64, 200))))
    for groups in simhash.SPLITS:
        assert sorted(b for g in simhash.grouped_bits(corr, groups) for b in g) == list(range(64))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(1000, 1060), 1000)}


def test_empty_table(nothing):
    assert simhash.near_duplicates(nothing).count() == 0

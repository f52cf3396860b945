import random
from itertools import permutations

from galeframe.llm import interaction


def failed(rows):
    """The set of filters that each (id, text) fails, by the definitions."""
    out = []
    for i, t in rows:
        text = t or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        own = {"A"} if len(words) < 200 else set()
        own |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        own |= {"C"} if 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text) else set()
        own |= {"D"} if set(text) & set("#$%&*|") else set()
        own |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == text for j, u in rows) else set()
        out.append(own)
    return out


def brute(rows, parts, good, toxic):
    want, fails = {}, failed(rows)
    for part in set(parts):
        docs = [(f, r[0] in good, r[0] in toxic) for f, r, p in zip(fails, rows, parts) if p == part]
        removals = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            gone = set()
            for step, own in enumerate(order, 1):
                hit = [k for k, (f, _, _) in enumerate(docs) if own in f]
                now = [k for k in hit if k not in gone]
                removals[own] += len(now)
                want[part, "".join(order), step] = [
                    len(docs) - len(gone) - len(now), len(now), len(hit) - len(now), sum(docs[k][0] == {own} for k in hit),
                    sum(docs[k][1] for k in now), sum(docs[k][2] for k in now),
                ]
                gone |= set(now)
    for (part, order, step), row in want.items():
        own = order[step - 1]
        row.append(sum(want[part, "".join(o), "".join(o).index(own) + 1][1] for o in permutations("ABCDE")))
    return want


def cases():
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(rng.sample(words, 250)), " ".join(rng.choices(words[:40], k=300)), "Big WORDS " * 30, "a # b", "", " \t", "x" * 50_000]
    texts += [" ".join(rng.sample(words, 199)) + "\u00a0z", "A\x0bB" * 150, None]
    rows = [(k, rng.choice(texts)) for k in range(120)] + [(None, texts[0]), (None, None), (3, texts[0]), (3, texts[0]), (-1, texts[4])]
    parts = [rng.choice(["p", "q", ""]) for _ in rows]
    return rows, parts


def run(spark, rows, parts, labels):
    given = [None if p == "" and k % 2 else p for k, p in enumerate(parts)]
    docs = spark.createDataFrame([(i, t, p, 1, "c") for (i, t), p in zip(rows, given)], "doc_id long, text string, source string, n int, mask string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return interaction.audit(docs.repartition(4), marks)


LABELS = [(k, k % 2, int(k % 5 == 0)) for k in range(0, 100, 3)] + [(3, 0, 1), (3, None, None), (None, 1, 1)]


def test_audit_equals_brute_force(spark, monkeypatch):
    rows, parts = cases()
    good = {i for i, q, _ in LABELS if q == 1 and i is not None}
    toxic = {i for i, _, t in LABELS if t == 1 and i is not None}
    want = brute(rows, parts, good, toxic)
    for split, broadcast in ((1 << 16, 1 << 20), (3, 0)):
        monkeypatch.setattr(interaction, "SPLIT", split)
        monkeypatch.setattr(interaction, "BROADCAST_ROWS", broadcast)
        got = run(spark, rows, parts, LABELS).collect()
        assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == want and len(got) == len(want) == 1800


def test_equal_hashes_of_other_texts_are_no_copies(spark):
    rows = spark.createDataFrame([(1, "p", "a", 7, 1), (2, "p", "b", 7, 1), (3, "p", "a", 7, 1)], "id long, part string, text string, h long, size int")
    assert [r.id for r in interaction.earlier_copies(rows).collect()] == [3]


def test_empty_tables(spark):
    assert run(spark, [], [], LABELS).count() == 0
    assert run(spark, [(1, "a")], ["p"], []).filter("good_lost > 0").count() == 0

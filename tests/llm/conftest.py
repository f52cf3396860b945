import random

import pytest

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(20_000))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): prose with copies, near copies, shared passages, and awkward texts."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    base = [prose(rng.randint(60, 220)) for _ in range(40)]
    passage = prose(30)
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100 + i, base[i % 5]) for i in range(12)]
    rows += [(200 + i, base[i] + " " + prose(2)) for i in range(8)]
    rows += [(300 + i, prose(40) + " " + passage + "\n" + prose(40)) for i in range(8)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "a"), (404, "É́ 日本語 😀 ﬁ"), (405, LONG), (406, "a" * 3000)]
    rows += [(407, "x" * 49), (408, "x" * 50), (409, "x" * 50), (None, base[0]), (None, None), (7, base[7]), (7, "other text for 7")]
    rows += [(-3, base[3]), (410, "İ Σ ς don't <|endoftext|> 1 234 a\x0bb"), (411, LONG[: len(LONG) // 2])]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names the operators use inside."""
    rows = [(i, t, "xx" if n % 3 else None, "s", len(t or ""), 1, "k", n) for n, (i, t) in enumerate(corpus)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, bucket int, key string, fp int"
    return spark.createDataFrame(rows, schema).repartition(5).cache()


@pytest.fixture(scope="session")
def nothing(spark, docs):
    return spark.createDataFrame([], docs.schema)


def by_id(frame):
    """Rows by id; rows of one id as a sorted list."""
    out = {}
    for row in frame.collect():
        out.setdefault(row["doc_id"], []).append(row)
    return out

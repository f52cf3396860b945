import random

import duckdb
import pytest

from galeframe.llm import conversations
from galeframe.llm.queries import ORACLE_SQL, QUERIES

FAR = (10**9, "")


def brute(turns):
    """Least (cost, audit) over all edits, state by state of the role string."""

    def add(x, cost, letter):
        return FAR if x == FAR else (x[0] + cost, x[1] + letter)

    def opened(p):
        u = min(p["u"], *(add(p[k], 5, "I") for k in ("none", "s", "a")))
        return {**p, "u": u, "a": min(p["a"], add(u, 5, "I"))}

    now = {"none": (0, ""), "s": FAR, "u": FAR, "a": FAR}
    for t in turns:
        p = opened(now)
        then = {"none": add(now["none"], 2, "D"), "s": add(now["s"], 2, "D"), "u": add(p["u"], 2, "D"), "a": add(p["a"], 2, "D")}
        if t != "X":
            more = 5 if t.islower() else 0
            if t in "Ss":
                then["s"] = min(then["s"], add(p["none"], more, "K"))
            for to, sources in (("u", ("none", "s", "a")), ("a", ("u",))):
                for k in sources:
                    then[to] = min(then[to], add(p[k], more + 1, "R"), add(p[k], more, "K") if t.lower() == to else FAR)
        now = then
    p = opened(now)
    return min(p["none"], p["a"])


def test_alignment_equals_brute_force():
    rng = random.Random(5)
    for _ in range(4000):
        letters = rng.choice(["SUAOX", "UA", "UAuasX", "SUAsuaoOX", "ssuuaaoX", "S", "SX", "Uu", "X"])
        turns = "".join(rng.choice(letters) for _ in range(rng.randint(1, 11)))
        assert conversations.align(turns) == conversations.folded(turns) == brute(turns), turns


def test_long_conversations_fold():
    rng = random.Random(6)
    for letters in ("UAUAUAuaXSO", "U", "SA", "Xu"):
        turns = "".join(rng.choice(letters) for _ in range(300))
        assert conversations.align(turns) == conversations.folded(turns)
    assert conversations.solve("UA" * 50_000) == (0, "KK" * 50_000)


ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Why?"), (1, 2, "assistant", "So."),
    (2, 3, "user", "A."), (2, 3, "user", "A."), (2, 7, "user", "B!"), (2, None, "assistant", None), (2, None, None, "Hm."),
    (3, 0, "system", "Alone."), (4, 0, "user", "no end"), (4, 1, "assistant", "\t\n"), (None, 1, "user", "Q?"), (None, 1, None, None),
    (None, 2, "assistant", "R. \x0b"), (5, None, None, None), (6, 9, "tool", "T."), (6, 10, "", "U."), (7, 2, "user", "x " * 50_000 + "."),
]


def oracle(rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return con.sql(ORACLE_SQL["op12_conversations"]).to_arrow_table().to_pylist()


@pytest.mark.parametrize("long", [0, 1000])
def test_query_equals_oracle(spark, tmp_path, monkeypatch, long):
    rng = random.Random(8)
    roles, texts = ("user", "assistant", "system", "bot"), ("One. ", "two", " ", "Three! ", "four?")
    rows = ROWS + [(20 + k // 9, k % 11, rng.choice(roles), rng.choice(texts) + str(rng.randint(0, 3)) + rng.choice(".x")) for k in range(900)]
    frame = spark.createDataFrame([(*r, 1, "clash") for r in rows], "conv_id long, turn long, role string, text string, at int, id string")
    frame.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    if long == 0:
        monkeypatch.setattr(conversations, "solve", conversations.folded)
    got = [r.asDict() for r in QUERIES["op12_conversations"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, (sorted(g.items()) for g in got))) == sorted(map(repr, (sorted(w.items()) for w in oracle(rows))))


def test_repaired_turns(spark):
    frame = spark.createDataFrame(ROWS[:3] + ROWS[8:10], "conv_id long, turn long, role string, text string")
    got = sorted((r.id, r["at"], r.role, r.text, r.edit) for r in conversations.repair(frame, frame).collect())
    assert [g for g in got if g[1]] == [(1, 1, "system", "Be kind.", "K"), (1, 2, "user", "Why?", "K"), (1, 3, "assistant", "So.", "K")]
    assert [g[3] for g in got if not g[1]] == ["KKK", "D", "D"]


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversations.digests(conversations.repair(frame, frame)).count() == 0

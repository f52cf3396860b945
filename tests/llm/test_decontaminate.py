import duckdb
import pytest

from galeframe.llm import decontaminate

ITEM = (
    "A farmer named Anna Berg sold 12 baskets of pears and 12 jars of plum jam at the market, then Anna Berg walked "
    "7 km home with 5 kg of flour for the bakery. How much did the farmer carry?"
)


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, ITEM), (2, ITEM), (3, None), (4, ""), (5, "one two three"), (None, ITEM + " again"), (6, "The quick brown fox jumps over the lazy dog while seven sleepy cats watch from a warm roof")]
    return spark.createDataFrame(rows, "item_id long, text string")


def swapped(**change):
    text = ITEM
    for old, new in change.get("pairs", ()):
        text = text.replace(old, new)
    return text


CASES = {
    10: ("Before it. " + ITEM + " After it.", [1], False),
    11: ("Word " + swapped(pairs=[("Anna Berg", "Tom Dale"), ("12", "30"), ("7 km", "9 miles")]) + " end", [1], True),
    # one value of the item would stand for two names: another story
    12: (swapped(pairs=[("named Anna Berg", "named Tom Dale"), ("then Anna Berg", "then Eve Moor"), ("sold 12", "sold 31"), ("and 12", "and 99")]), [], False),
    13: ("nothing of the kind stands here, only plain words that no item holds at all", [], False),
    14: (ITEM.upper().replace(" ", "!! "), None, None),
    15: ("the QUICK brown fox jumps over the lazy dog while seven sleepy cats watch from a warm roof, twice", [6], False),
    16: (ITEM[: len(ITEM) // 2], [], False),
    17: (None, [], False),
    18: ("", [], False),
    19: ("one two three", [5], False),
}


def test_cases(spark, benchmark):
    rows = [(i, t, "clash", 3) for i, (t, _, _) in CASES.items()] + [(None, ITEM, "clash", 4), (10, CASES[10][0], "clash", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item string, h int")
    got = decontaminate.decontaminate(docs, benchmark).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert not r.contaminated
        elif CASES[r.doc_id][1] is not None:
            assert (r["items"], r.changed) == CASES[r.doc_id][1:], r.doc_id
            assert r.contaminated == bool(r["items"]) and (r.coverage >= 0.8) == r.contaminated


OPENING = (
    "Natalia sold clips to 48 of her friends in April. Natalia then sold half as many clips in May. Weng earns 12 dollars "
    "an hour for babysitting. Weng watched the child of Natalia for 50 minutes. How many clips did Natalia sell altogether?"
)


def test_names_that_open_sentences(spark):
    benchmark = spark.createDataFrame([(1, OPENING), (2, "Who wrote the book Emma?")], "item_id long, text string")
    other = OPENING.replace("Natalia", "Joan").replace("Weng", "Peter").replace("48", "31").replace("12", "17")
    mixed = OPENING.replace("Natalia sold", "Joan sold").replace("Natalia then", "Ruth then").replace("48", "31").replace("Natalia sell", "Maria sell")
    texts = [OPENING, other, mixed, "Tom wrote the book Anna?", "So it was. " + other + " That is all."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.decontaminate(docs, benchmark).collect()}
    assert [got[i]["items"] for i in range(5)] == [[1], [1], [], [], [1]]
    assert [got[i].changed for i in range(5)] == [False, True, False, False, True]


def test_each_place_of_a_template_is_judged(spark, benchmark):
    broken = CASES[12][0]
    rows = [(1, broken + " So " + ITEM), (2, broken + " So " + CASES[11][0]), (3, broken + " So " + broken)]
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert {r.doc_id: (r["items"], r.changed) for r in got} == {1: ([1], False), 2: ([1], True), 3: ([], False)}


def test_each_text_of_an_id_is_judged(spark, benchmark):
    rows = [(1, CASES[12][0]), (1, "Aaa"), (2, CASES[11][0]), (2, "Aaa"), (2, CASES[11][0]), (3, ITEM), (3, CASES[11][0])]
    half = len(ITEM.split()) // 2
    rows += [(4, " ".join(ITEM.split()[:half])), (4, " ".join(ITEM.split()[half:]))]
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), benchmark)
    assert got.count() == len(rows)
    assert {r.doc_id: (r["items"], r.changed) for r in got.collect()} == {1: ([], False), 2: ([1], True), 3: ([1], True), 4: ([], False)}


def test_oracle_on_openings_places_and_repeated_ids(spark, tmp_path):
    joan = OPENING.replace("Natalia", "Joan").replace("Weng", "Peter").replace("48", "31")
    broken = CASES[12][0]
    texts = [OPENING, joan, broken + " So " + ITEM, broken + " So " + CASES[11][0], broken, "Anna Bob, Carl. Dan Eve went.", None, "", " Zoe  Yan", joan]
    rows = list(enumerate(texts)) + [(2, "Aaa"), (4, joan), (None, ITEM), (1, joan), (5, "(Kim)Lee-Max. The Ann Bob paid 5 Euro.")]
    spark.createDataFrame(rows, "doc_id long, text string").createOrReplaceTempView("documents")
    items = spark.createDataFrame([(1, OPENING), (2, ITEM), (3, "So Dan Eve went."), (4, "Kim, Lee, Max. The Jim paid 3 Euro")], "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", spark.table("documents").toPandas().astype({"doc_id": "Int64"}))
    con.register("benchmark", items.toPandas())
    want = con.sql(decontaminate.oracle_sql()).to_arrow_table().to_pylist()
    got = [r.asDict() for r in decontaminate.decontaminate(spark.table("documents"), items).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(r["contaminated"] for r in got) > 8


def test_templates(spark):
    text = "In May John Smith paid 3,500 dollars and 20 percent, 1 2 3 go"
    frame = spark.createDataFrame([(text,)], "text string").select(decontaminate.template(decontaminate.F.col("text")).alias("w"))
    n, a, u = decontaminate.NUMBER_MARK, decontaminate.NAME_MARK, decontaminate.UNIT_MARK
    assert frame.first().w == ["in", a, "paid", n, u, "and", n, u, n, "go"]


def test_long_runs_of_names_and_numbers(spark, benchmark):
    rows = [(1, "so " + "Anna " * 60_000 + "x"), (2, "1, " * 60_000), (3, ("Anna Berg " * 3 + "12 kg. ") * 9000 + ITEM), (4, "a" * 300_000)]
    got = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()
    assert {r.doc_id: r["items"] for r in got} == {1: [], 2: [], 3: [1], 4: []}


def test_large_sides_are_not_broadcast(spark, benchmark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in CASES.items()], "doc_id long, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.decontaminate(docs, benchmark).collect()}
    assert all(got[i] == c[1] for i, c in CASES.items() if c[1] is not None)


def test_empty_tables(spark, benchmark, nothing, docs):
    none = spark.createDataFrame([], benchmark.schema)
    assert decontaminate.decontaminate(nothing, benchmark).count() == 0
    assert decontaminate.decontaminate(docs, none).filter("contaminated").count() == 0

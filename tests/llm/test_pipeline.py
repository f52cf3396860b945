import duckdb
import pytest

import corpus_pipeline
from galeframe.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "labels", "conversations")


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_strings", "decontamination", "encoding"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(want.column_names)
    got = QUERIES[name](spark, FOLDER).select(*columns).toArrow()

    def rows(table):
        return sorted(repr(list(r.values())) for r in table.select(columns).to_pylist())

    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", ["op2_quality", "op6_language", "op10_toxicity", "op7_compression"])
def test_queries_give_a_row_for_every_document(spark, name):
    got = QUERIES[name](spark, FOLDER)
    assert got.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()


def test_stages_on_written_results(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = {r.doc_id for r in docs.select("doc_id").collect()}
        assert after <= before and len(after) > 0.7 * len(before)
        assert docs.count() == len(after)
        if name != "encoding":
            assert docs.columns == columns
        if name == "near_duplicates":
            assert docs.select("text").distinct().count() == docs.count()
        before = after
    assert docs.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


def test_awkward_rows_pass_every_stage(docs, nothing, spark):
    for given in (docs, nothing):
        frame = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, FOLDER)
            assert frame.columns == given.columns
        last = corpus_pipeline.STAGES[-1][1](spark, frame, FOLDER)
        assert last.count() <= given.count()


def test_repeated_rows_of_one_id_are_copies(spark):
    rows = [(1, "some words that are here"), (1, "some words that are here"), (2, "some words that are here"), (3, None), (4, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, frame, FOLDER)
    assert sorted(r.doc_id for r in got.collect()) == [1, 3]

from collections import Counter

from pyspark.sql import functions as F

from galeframe.llm import sharding


def shards(spark, weights, n=4000):
    frame = spark.range(n).select("id", sharding.rendezvous(F.col("id"), weights).alias("shard"))
    return {r.id: r.shard for r in frame.collect()}


def test_a_new_shard_only_takes_keys(spark):
    old, new = shards(spark, dict.fromkeys(range(8), 1.0)), shards(spark, dict.fromkeys(range(9), 1.0))
    moved = {i for i in old if old[i] != new[i]}
    assert all(new[i] == 8 for i in moved) and 300 < len(moved) < 600


def test_weights_set_the_shares(spark):
    n = Counter(shards(spark, {0: 1.0, 1: 3.0, 2: 0.0}).values())
    assert n[2] == 0 and 2.5 < n[1] / n[0] < 3.6


def test_numbers_are_gapless_also_for_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK", 7)
    rows = [(i % 3, 5 if i < 300 else i, "x") for i in range(900)] + [(1, None, None)]
    frame = spark.createDataFrame(rows, "shard int, k long, other string")
    got = sharding.numbered(frame, "shard", "k").collect()
    assert len(got) == len(rows)
    for s in range(3):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert sorted((r.shard, r.k or -1, r.other or "") for r in got) == sorted((s, k or -1, o or "") for s, k, o in rows)


def test_awkward_rows_and_an_empty_table(docs, nothing):
    for frame in (docs, nothing):
        rows = frame.select("doc_id", sharding.rendezvous(F.col("doc_id"), {0: 1.0, 1: 1.0}).alias("shard"))
        got = sharding.numbered(rows, "shard", "doc_id")
        assert got.count() == frame.count() and got.filter("shard IS NULL OR slot IS NULL").count() == 0

"""The derived series: what Spark takes their size for, and that no join is needed for the features."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from galeframe.functions import hour_number
from galeframe.operators.joins import join_power
from galeframe.operators.ordered import number_rows, spread_chunks
from galeframe.plans import views


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Events of 300 users and one without a name over 20 days, most hours of a user without any."""
    start = dt.datetime(2024, 1, 1, 5, 30)
    rows = [(u, start + dt.timedelta(hours=(u * 37 + k * 91) % 480), "a", float(u % 7 + k)) for u in range(300) for k in range(4)]
    rows += [(None, start, "b", 2.0), (5, None, "b", 1.0), (6, start + dt.timedelta(hours=480), "a", None)]
    path = str(tmp_path_factory.mktemp("events"))
    schema = "user_id long, ts timestamp_ntz, event_type string, value double"
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/events.parquet")
    return path


def plan_of(frame):
    return frame._jdf.queryExecution()


@pytest.mark.parametrize("view", [views.obs, views.truth, views.runs, views.features])
def test_dense_series_are_not_taken_for_small(spark, folder, view):
    """A size below that of the hours themselves would send them through the driver as a broadcast."""
    hours = views.obs(spark, folder).count()
    assert hours == 301 * 481
    assert int(str(plan_of(view(spark, folder)).optimizedPlan().stats().sizeInBytes())) > 20 * hours


def test_joins_of_dense_series_broadcast_none_of_them(spark, folder):
    joined = join_power(views.obs(spark, folder), views.runs(spark, folder))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        assert "BroadcastHashJoin" not in plan_of(joined).executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hours_are_whole_between_the_first_and_last_event(spark, folder):
    per_site = views.obs(spark, folder).groupBy("site").agg(
        F.count("*").alias("n"), F.count_distinct("date").alias("d"), F.min("date").alias("lo"), F.max("date").alias("hi")
    )
    ends = (dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 21, 5))
    assert {(r.n, r.d, r.lo, r.hi) for r in per_site.collect()} == {(481, 481, *ends)}


def test_features_are_the_join_of_hours_and_runs(spark, folder):
    columns = ["site", "date", "start", "dist", "flag", "power", "u", "v", "ws", "wd"]
    joined = join_power(views.obs(spark, folder), views.runs(spark, folder)).select(columns)
    own = views.features(spark, folder).select(columns)
    assert own.count() == joined.count() > 0
    assert own.exceptAll(joined).count() == 0


def test_hours_are_spread_over_all_tasks_however_few_bytes_they_are(spark, folder):
    """By the bytes that it shuffles Spark would give all of these hours to one task."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hours = views.obs(spark, folder)
    numbered = number_rows(hours.filter("site IS NOT NULL"), ["site"], "date", keep_chunk=True)
    windowed = spread_chunks(hours, ["site"], hour_number("date"), 64, after=8)
    for frame in (hours, numbered, windowed):
        sizes = [r["count"] for r in frame.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == parts and max(sizes) < 2 * sum(sizes) / parts


@pytest.mark.parametrize("view", [views.obs, views.obs_masked, views.runs, views.features])
def test_rows_are_the_same_in_both_layouts(spark, folder, view):
    spread, together = view(spark, folder), view(spark, folder, together=True)
    assert together.schema.simpleString() == spread.schema.simpleString()
    assert together.exceptAll(spread).count() == 0 == spread.exceptAll(together).count()
    assert int(str(plan_of(together).optimizedPlan().stats().sizeInBytes())) > 20 * spread.count()


def test_a_run_lies_in_few_tasks_where_hours_are_kept_together(spark, folder):
    rows = views.features(spark, folder, together=True)
    tasks = rows.withColumn("task", F.spark_partition_id()).groupBy("site", "start").agg(F.count_distinct("task").alias("n"))
    assert tasks.agg(F.max("n")).first()[0] == 1  # twenty days lie in one chunk

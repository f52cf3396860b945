import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from series_times import T0, hour_of
from galeframe.operators import sequences as op


def brute_starts(hours, length, stride, need_next=True):
    hours = sorted(hours)
    reach = length if need_next else length - 1
    return [
        hours[i]
        for i in range(0, len(hours) - reach, stride)
        if hours[i + reach] - hours[i] == reach
    ]


def test_no_window_spans_a_missing_hour(series):
    hours = [h for h in range(100) if h != 50]
    df = series({1: {h: h for h in hours}})
    got = sorted(hour_of(r.window_start) for r in op.window_starts(df, 4, 6).collect())
    assert got == brute_starts(hours, 10, 1)
    assert all(not (s <= 50 <= s + 10) for s in got)


@pytest.mark.parametrize("stride", [1, 3, 10])
@pytest.mark.parametrize("need_next", [True, False])
def test_windows_against_brute_force(series, stride, need_next):
    rng = np.random.default_rng(stride)
    data = {
        s: {int(h): float(rng.random()) for h in np.flatnonzero(rng.random(700) < 0.97)}
        for s in (1, 2)
    }
    cut = op.cut_windows(
        series(data), ["power"], 12, stride, need_next=need_next, span=50
    ).collect()
    got = {(r.site, hour_of(r.window_start)): [s.power for s in r.steps] for r in cut}
    want = {}
    for site, points in data.items():
        hours = sorted(points)
        for h in brute_starts(hours, 12, stride, need_next):
            want[(site, h)] = [points[h + k] for k in range(12)]
    assert got == want


def test_chunk_size_does_not_matter(series):
    df = series({1: {h: h for h in range(600) if h % 97}})
    sizes = [op.cut_windows(df, ["power"], 20, 2, span=s).count() for s in (25, 100, 5000)]
    assert len(set(sizes)) == 1


def features(spark, n=40):
    rows = [(1, T0 + dt.timedelta(hours=h), float(h), 100.0 + h, 1000.0 + h) for h in range(n)]
    return spark.createDataFrame(
        rows, "site int, date timestamp_ntz, ws double, ws_power double, power double"
    )


def first(df):
    return df.orderBy("window_start").first()


def test_channel_swap(spark):
    cut = op.cut_windows(features(spark), ["ws", "ws_power", "power"], 6)
    r = first(op.channel_swap(cut, ["ws"], 4, 2))
    assert [s.power_in for s in r.x] == [1000, 1001, 1002, 1003, 104, 105]
    assert r.y == [1004, 1005]


@pytest.mark.parametrize("history,horizon", [(3, 5), (5, 3), (4, 4)])
def test_pairs(spark, history, horizon):
    m = np.arange(40.0)
    cut = op.cut_windows(features(spark), ["ws", "power"], history + horizon)
    fwd = first(op.offset_pair(cut, ["ws"], history, horizon))
    shift = horizon if history > horizon else history
    assert [s.ws for s in fwd.x] == list(m[shift : shift + history])
    assert [s.power_in for s in fwd.x] == list(1000 + m[:history])
    assert fwd.y == list(1000 + m[history : history + horizon])
    back = first(op.reverse_pair(cut, ["ws"], history, horizon))
    begin = 0 if history > horizon else horizon - history
    assert [s.ws for s in back.x] == list(m[begin : begin + history])
    assert [s.power_in for s in back.x] == list(1000 + m[horizon : horizon + history])
    assert back.y == list(1000 + m[:horizon])


def test_lagged_slide(spark):
    cut = op.cut_windows(features(spark), ["ws", "power"], 6)
    rows = op.lagged_slide(cut, ["ws"], ["power"], 3).filter(F.col("window_start") == F.lit(T0).cast("timestamp_ntz"))
    got = {r.slide: ([(s.ws, s.prev_power) for s in r.x], r.y) for r in rows.collect()}
    assert set(got) == {0, 1, 2}
    assert got[1] == ([(2, 1001), (3, 1002), (4, 1003)], 1004)


def test_window_built_twice_is_the_same(series):
    df = series({1: {h: h % 7 for h in range(300) if h % 50}})
    assert all(r.rmse == 0 for r in op.window_consistency(df, "power", 10).collect())


def test_evaluation_windows(spark):
    rows = [
        (1, T0 + dt.timedelta(hours=h), 1, 1, float(h), float(h), float(h), not 30 <= h < 40)
        for h in range(60)
    ]
    df = spark.createDataFrame(
        rows,
        "site int, date timestamp_ntz, catagory int, dist int, ws double, ws_power double, "
        "power double, flag boolean",
    )
    data = op.sequence_dataset(df, ["ws"], history=4, horizon=5).filter("split = 'test'")
    got = {hour_of(r.window_start): r for r in data.collect()}
    assert set(got) == {30, 35}
    assert [s.ws for s in got[30].x] == list(range(26, 35)) and got[30].y == list(range(30, 35))


def test_windows_are_cut_outside_the_functions_of_places(spark, series):
    """Inside such a function every slice would turn the whole chunk into objects first."""
    hours = series({1: {h: h / 200 for h in range(200)}}).withColumns({"ws": F.col("power") * 2, "ws_power": F.col("power") * 3})
    cut = op.cut_windows(hours, ["ws", "ws_power", "power"], 84)
    swapped = op.channel_swap(cut, ["ws"], 36, 48)
    plan = swapped._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" in plan
    assert not [line for line in plan.splitlines() if "slice(" in line and "lambda" in line]
    got = swapped.orderBy("window_start").collect()
    assert len(got) == 200 - 84
    for i, row in enumerate(got):
        assert [r.ws for r in row.x] == [2 * h / 200 for h in range(i, i + 84)]
        assert [r.power_in for r in row.x] == [h / 200 * (1 if h < i + 36 else 3) for h in range(i, i + 84)]
        assert row.y == [h / 200 for h in range(i + 36, i + 84)]


def gappy_runs(spark, hours=400):
    """Measured hours with gaps beside runs of 6 steps every 3 hours, some of them missing."""
    rng = np.random.default_rng(1)
    there = set(np.flatnonzero(rng.random(hours) < 0.985).tolist())
    rows = [
        (1, T0 + dt.timedelta(hours=s + k), T0 + dt.timedelta(hours=s), k, 1 if k <= 3 else 2, float(s + k / 10))
        for s in range(0, hours, 3) if s % 15 for k in range(1, 7) if s + k in there
    ]
    return spark.createDataFrame(rows, "site int, date timestamp_ntz, start timestamp_ntz, dist int, catagory int, ws double")


@pytest.mark.parametrize("stride", [1, 2])
@pytest.mark.parametrize("issued_after", [-1, 5])
def test_windows_meet_their_runs_without_a_shuffle_of_windows(spark, stride, issued_after):
    features = gappy_runs(spark)
    near = features.filter("catagory = 1")
    cut = op.cut_windows(near, ["dist", "ws"], 8, stride, span=40)
    runs = features.groupBy("site", "start").agg(F.array_sort(F.collect_list(F.struct("dist", "ws"))).alias("run"))
    at = F.expr(f"window_start + interval {issued_after} hours")
    want = cut.withColumn("start", at).join(runs, ["site", "start"]).collect()
    got = op._windows_with_runs(near, features, ["dist", "ws"], ["dist", "ws"], 8, stride, issued_after, span=40)
    found = {r.window_start: (r.steps, r._run) for r in got.collect()}
    assert found == {r.window_start: (r.steps, r.run) for r in want} and len(found) > 5
    plan = got._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("SortMergeJoin")]
    assert "Exchange" not in above and "Broadcast" not in plan[: plan.index("Generate")]


def test_one_step_samples_of_every_hour(spark, tmp_path):
    from galeframe.plans.registry import PLANS, SQL, load_all

    load_all()
    hours = "explode(sequence(timestamp_ntz'2024-01-01 00:30:00', timestamp_ntz'2024-01-07 00:30:00', interval 1 hour))"
    events = spark.range(1).selectExpr(f"{hours} AS ts", "id AS user_id", "'a' AS event_type", "1.5d AS value")
    events.selectExpr("monotonically_increasing_id() AS event_id", "*").write.parquet(f"{tmp_path}/events.parquet")
    got = PLANS["objective_windows_category"](spark, str(tmp_path)).collect()
    # Windows that a run was issued an hour before: hours 1, 13, 25 ... whose 84th hour behind is measured.
    assert {hour_of(r.window_start) for r in got} == set(range(1, 144 - 84 + 1, 12))
    assert "% 48" not in SQL["objective_windows_category"]


def test_no_table_of_windows_goes_through_the_driver(spark):
    """By their packed bytes these pass for small at run time, however many sites there are."""
    features = gappy_runs(spark).withColumn("flag", F.col("ws") < 200).withColumn("wd", F.lit(30.0))
    model = F.transform("_history", lambda x: x)
    updated = op.predict_and_update(features, model, "ws", 3, 3, 4)
    updated.collect()
    assert "Broadcast" not in updated._jdf.queryExecution().executedPlan().toString()


def test_first_rows_are_not_sent_in_front_of_the_series(spark):
    from galeframe.operators.ordered import spread_chunks

    df = spark.range(20)
    chunks = lambda **k: {r._chunk for r in spread_chunks(df, ["id"], F.col("id"), 8, 2, 3, **k).collect()}
    assert chunks() == {-1, 0, 1, 2} and chunks(lowest=0) == {0, 1, 2}


def test_rows_of_sequences_are_spread_once_before_they_are_packed(spark):
    features = gappy_runs(spark).withColumns({"flag": F.lit(True), "power": F.col("ws"), "ws_power": F.col("ws")})
    plan = op.sequence_dataset(features, ["dist", "ws"], 4, 4, 2)._jdf.queryExecution().executedPlan().toString()
    # The number of a row and the choice of its lead need no partitioning of their own.
    assert plan.count("REPARTITION_BY_NUM") == 3

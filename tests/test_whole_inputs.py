"""No row, name, width or setting is lost where an input is larger or emptier than usual."""

import datetime as dt
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from series_times import T0

from galeframe import session
from galeframe.operators import explore, features, joins, models, outliers

HOUR = dt.timedelta(hours=1)


@pytest.fixture(scope="module")
def trees(spark):
    rows = [(i, float(i % 7), float(i % 7) / 7 + 0.05) for i in range(200)]
    train = spark.createDataFrame([*rows, (900, None, 0.5), (901, 3.0, None)], "id int, x double, power double")
    return train, models.fit_gbt(train, ["x"], leaves=8, trees=3), models.fit_gate(train, ["x"], 0.5, leaves=4, trees=2)


def test_a_missing_feature_gets_no_forecast_and_keeps_its_row(trees):
    train, model, gate = trees
    predicted = models.predict(train, model, ["x"])
    assert predicted.count() == 202
    got = {r.id: r for r in models.gated(predicted, gate).collect()}
    assert len(got) == 202
    assert got[900].predicted is None and got[900].gate is None and got[900].gate_probability is None
    assert got[901].predicted is not None and got[5].predicted is not None


def test_every_setting_has_its_row(spark, trees):
    rows = models.sweep_leaves(trees[0], ["x"], [2, 10, 16, 12], trees=1).collect()
    assert sorted(r.max_leaves for r in rows) == [2, 10, 12, 16]
    assert len({r.rmse for r in rows if r.max_leaves != 2}) == 1


def test_a_site_without_a_fit_keeps_its_rows(spark):
    rows = spark.createDataFrame(
        [(1, 1.0, 2.0), (1, 2.0, 4.0), (2, None, None), (2, 3.0, None)], "site int, a double, power double"
    )
    got = models.score_linear(rows, models.fit_linear_by_site(rows, ["a"]), ["a"]).collect()
    assert len(got) == 4
    assert sorted(r.predicted for r in got if r.site == 1) == pytest.approx([2.0, 4.0])
    assert all(r.predicted is None for r in got if r.site == 2)


def test_recent_rows_reach_over_any_gap(spark):
    right = [(1, T0 + h * HOUR, float(h)) for h in [*range(5), *range(500, 503)]] + [(2, T0, 9.0)]
    left = [(1, T0 + 502 * HOUR), (1, T0), (3, T0), (2, T0 + 4000 * HOUR)]
    got = joins.recent_rows(
        spark.createDataFrame(left, "site int, t timestamp_ntz"),
        "t",
        spark.createDataFrame(right, "site int, date timestamp_ntz, v double"),
        "date",
        4,
    ).collect()
    assert sorted((r.site, r.v) for r in got) == [(1, 3.0), (1, 4.0), (1, 500.0), (1, 501.0), (2, 9.0)]


def test_rolling_over_a_run_longer_than_two_days(spark):
    rows = [(1, T0, d, float(d)) for d in range(1, 101)]
    runs = spark.createDataFrame(rows, "site int, start timestamp_ntz, dist int, ws double")
    got = {r.dist: r for r in features.run_rolling(runs, ["ws"], [2, 48]).collect()}
    assert got[100].ws48_ws_min == 53.0 and got[100].ws48_ws_mean == pytest.approx(76.5)
    assert got[100].ws2_ws_min == 99.0 and got[3].ws48_ws_min == 1.0


def test_an_unlisted_name_is_an_error(spark):
    rows = spark.createDataFrame([(1, 1, 0.5), (1, 6, 0.7), (1, None, 0.1)], "date int, site int, power double")
    assert joins.to_wide(rows, "date", "site", "power", [1, 6], "wp").first().wp6 == 0.7
    with pytest.raises(Exception, match="site not listed: 6"):
        joins.to_wide(rows, "date", "site", "power", [1, 2], "wp").collect()
    log = spark.createDataFrame(
        [(1, 1, "loss", 0.5), (1, 1, "new", 0.1)], "run int, step int, tag string, value double"
    )
    with pytest.raises(Exception, match="tag not listed: new"):
        explore.metric_series(log, ["loss"]).collect()


def test_rows_without_a_place_stay_outside_clusters(spark):
    rows = [(i, 0.001 * i, 0.0) for i in range(8)] + [(100, None, 1.0), (101, 1.0, None), (102, 5.0, 5.0)]
    frame = spark.createDataFrame(rows, "id int, u double, v double")
    got = {r.id: r for r in outliers.density_clusters(frame, eps=0.02, min_samples=5).collect()}
    assert len(got) == 11
    assert not got[100].core and got[100].label is None and not got[101].core and not got[102].core
    assert got[3].core and got[3].label is not None


def test_a_cluster_must_name_its_folder():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda name, other=None: other)})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_folder(Session())


def test_the_package_reaches_the_workers_from_any_folder(tmp_path):
    root = Path(__file__).resolve().parents[1]
    code = (
        f"import sys; sys.path.insert(0, {str(root)!r})\n"
        "from galeframe.session import build_session\n"
        "from galeframe.operators import explore\n"
        "s = build_session('far', 'local[2]', **{'spark.ui.enabled': 'false'})\n"
        "d = s.range(50).selectExpr('cast(id as double) a', 'cast(id * id as double) b')\n"
        "print('rows', explore.correlation_matrix(d, ['a', 'b']).count())\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120
    )
    assert "rows 4" in done.stdout, done.stderr[-2000:]


def test_narrow_frames_are_kept_in_few_files(spark):
    """One file a partition, most of them empty, would cost every executor hundreds of processes a round."""
    from galeframe.session import NARROW_FILES, durable

    most = NARROW_FILES * spark.sparkContext.defaultParallelism
    spread = spark.range(1000).repartition(10 * most, F.col("id"))
    kept = durable(spread, narrow=True)
    assert kept.rdd.getNumPartitions() == most
    assert {r.id for r in kept.collect()} == set(range(1000))
    assert durable(spread.limit(3).coalesce(1), narrow=True).rdd.getNumPartitions() == 1
    assert durable(spread).rdd.getNumPartitions() == 10 * most


def test_rolling_widths_are_tiled_and_skip_unknown_values(spark):
    rows = [(s, T0, d, None if (s + d) % 5 == 0 or s == 3 else float(d * 37 % 11)) for s in (1, 2, 3) for d in range(1, 61)]
    runs = spark.createDataFrame(rows, "site int, start timestamp_ntz, dist int, ws double")
    rolled = features.run_rolling(runs, ["ws"], [2, 12, 48, 17, 1])
    plan = rolled._jdf.queryExecution().optimizedPlan().toString()
    assert "RowFrame, -16" in plan  # a width that no other tiles keeps its frame
    assert "RowFrame, -11" not in plan and "RowFrame, -47" not in plan
    value = {(s, d): v for s, _, d, v in rows}
    got = rolled.collect()
    assert len(got) == len(rows)
    for r in got:
        for w in (1, 2, 12, 17, 48):
            seen = [v for d in range(max(1, r.dist - w + 1), r.dist + 1) if (v := value[(r.site, d)]) is not None]
            own = (r[f"ws{w}_ws_mean"], r[f"ws{w}_ws_max"], r[f"ws{w}_ws_min"])
            assert own == ((pytest.approx(sum(seen) / len(seen)), max(seen), min(seen)) if seen else (None, None, None))


def test_tables_that_grow_with_the_sites_are_not_broadcast(spark):
    """They pack well, so that Spark would take them for small at run time."""
    from galeframe.operators import ordered, recursion

    times = [(s, T0 + h * HOUR, float(h), h < 60) for s in range(1, 6) for h in range(108)]
    hours = spark.createDataFrame(times, "site int, date timestamp_ntz, power double, flag boolean")
    asked = hours.select("site", F.col("date").alias("t"))
    frames = {
        "numbered": ordered.number_rows(hours, ["site"], "date"),
        "islands": ordered.islands(hours, ["site"], "date"),
        "known": joins.last_known(asked, "t", hours, "date", "power"),
        "recent": joins.recent_rows(asked, "t", hours, "date", 3),
        "blocks": recursion.blocks_with_context(hours, hours, ["power"], 36),
    }
    counts = {name: len(frame.collect()) for name, frame in frames.items()}
    assert counts == {"numbered": 540, "islands": 540, "known": 540, "recent": 1590, "blocks": 5}
    for name, frame in frames.items():
        plan = frame._jdf.queryExecution().executedPlan().toString()  # as it was run
        assert "isFinalPlan=true" in plan and "BroadcastHashJoin" not in plan, name


def test_blocks_walk_without_a_group_for_each(spark):
    from galeframe.operators import recursion

    blocks = spark.createDataFrame(
        [(s, T0, [1.0, 2.0, float(s)], [(float(k),) for k in range(4)]) for s in range(1, 8)],
        "site int, start timestamp_ntz, past array<double>, ahead array<struct<ws: double>>",
    )
    walked = recursion.recursive_model(blocks, lambda past, hour: past[-1] + past[0] + hour["ws"], ["ws"])
    assert "FlatMapGroups" not in walked._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.site, r.date): r.power for r in walked.collect()}
    for s in range(1, 8):
        series = [1.0, 2.0, float(s)]
        for k in range(4):
            series.append(series[-1] + series[-3] + k)
            assert got[(s, T0 + (k + 1) * HOUR)] == series[-1]
    assert len(got) == 28

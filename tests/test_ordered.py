import datetime as dt
import re

import numpy as np
from pyspark.sql import functions as F

from series_times import T0, hour_of
from galeframe.operators import ordered as op


def scattered(seed=3, sites=3, hours=400, keep=0.4):
    rng = np.random.default_rng(seed)
    return {
        s: {int(h): float(h) for h in np.flatnonzero(rng.random(hours) < keep)}
        for s in range(1, sites + 1)
    }


def test_positions_cross_chunks(series):
    data = scattered()
    got = op.number_rows(series(data), ["site"], "date", hours=24).collect()
    for r in got:
        assert r.pos == sorted(data[r.site]).index(hour_of(r.date))


def test_conditional_positions(series):
    data = scattered()
    even = F.col("power") % 2 == 0
    got = op.number_rows(series(data), ["site"], "date", hours=24, also={"even": even}).collect()
    for r in got:
        before = [h for h in data[r.site] if h < hour_of(r.date) and h % 2 == 0]
        assert r.even == len(before)


def test_neighbours_over_gaps_longer_than_a_chunk(series):
    data = {1: {h: (h if h in (5, 6, 300) else None) for h in range(0, 400, 3)} | {5: 5, 6: 6, 300: 300}}
    got = op.known_neighbours(
        series(data), ["site"], "date", F.col("power"), "prev", "next", hours=24
    ).collect()
    known = [5, 6, 300]
    for r in got:
        h = hour_of(r.date)
        assert r.prev == max((float(k) for k in known if k <= h), default=None)
        assert r.next == min((float(k) for k in known if k >= h), default=None)


def test_gaps_to_previous_and_next_row(series):
    got = {hour_of(r.date): r for r in op.row_gaps(series({1: {0: 0, 2: 0, 3000: 0}}), ["site"], "date").collect()}
    assert (got[0].pre_gap, got[0].next_gap) == (None, -2)
    assert (got[2].pre_gap, got[2].next_gap) == (2, -2998)
    assert (got[3000].pre_gap, got[3000].next_gap) == (2998, None)


def test_shift_is_positional_and_chunk_free(series):
    data = scattered()
    got = op.shifted(series(data), ["site"], "date", "power", [1, 7, -2], span=16).collect()
    assert len(got) == sum(len(d) for d in data.values())
    for r in got:
        hours = sorted(data[r.site])
        i = hours.index(hour_of(r.date))
        assert r.lag_1 == (hours[i - 1] if i >= 1 else None)
        assert r.lag_7 == (hours[i - 7] if i >= 7 else None)
        assert r.lag_m2 == (hours[i + 2] if i + 2 < len(hours) else None)


def test_islands(series):
    got = {hour_of(r.date): r for r in op.islands(series({1: {h: 0 for h in (0, 1, 2, 5, 6, 9)}}), ["site"], "date").collect()}
    assert [got[h].pos for h in (0, 1, 2, 5, 6, 9)] == [0, 1, 2, 0, 1, 0]
    assert len({got[h].island for h in got}) == 3


def test_hot_site_spreads_over_chunks(spark):
    """One site with most rows still becomes many window groups."""
    rows = spark.range(20000).select(
        F.lit(1).alias("site"),
        F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit(T0).cast("timestamp_ntz")).alias("date"),
    )
    chunked = op._chunked(rows, ["site"], "date", 744)
    assert chunked.select(op.CHUNK).distinct().count() > 20
    by_site = rows.repartition("site")
    plan = op.number_rows(by_site, ["site"], "date")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\([^)]*_chunk#\d+L?, \d+\), REPARTITION", plan)
    numbered = op.number_rows(rows, ["site"], "date")
    off = numbered.filter(
        F.col("pos") != F.timestamp_diff("HOUR", F.lit(T0).cast("timestamp_ntz"), F.col("date"))
    )
    assert off.count() == 0


def test_dates_before_the_origin(spark):
    rows = spark.createDataFrame(
        [(1, T0 - dt.timedelta(hours=h)) for h in range(100)], "site int, date timestamp_ntz"
    )
    got = op.number_rows(rows, ["site"], "date", hours=24).collect()
    assert all(r.pos == 99 - int((T0 - r.date).total_seconds() // 3600) for r in got)


def test_mixed_sort(spark):
    rows = [(T0 + dt.timedelta(hours=h), s, d) for h in range(3) for s in (2, 1) for d in (5, 17, 29)]
    df = spark.createDataFrame(rows, "date timestamp_ntz, site int, dist int").repartition(4)
    got = [tuple(r) for r in op.mixed_sort(df).collect()]
    assert got == sorted(rows, key=lambda r: (r[0], r[1], -r[2]))


def test_top_rows_are_limited_before_the_shuffle(series):
    top = op.first_rows(series({1: {h: h for h in range(50)}}), ["site"], [F.col("date")], 5)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert sorted(r.power for r in top.collect()) == [0, 1, 2, 3, 4]

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from series_times import T0, hour_of
from galeframe.operators import explore, metrics, scoring, splits


def scored(spark, rows):
    return spark.createDataFrame(rows, "w int, y double, p double")


def test_packed_windows_have_the_rmse_of_unrolled_ones(spark):
    steps = [[(9.0, 0.0), (3.0, 0.0), (4.0, 0.0)], [(9.0, 0.0), (None, 1.0), (2.0, 0.0)], [(9.0, 0.0), (None, 1.0), (1.0, None)]]
    rows = [("a", k, s) for k, s in enumerate(steps)]
    cut = spark.createDataFrame(rows, "site string, w int, steps array<struct<y: double, p: double>>")
    got = metrics.packed_window_rmse(cut, 1, 2, "y", "p", ["site"]).first()
    plain = cut.select("site", "w", F.posexplode("steps").alias("k", "s")).filter("k > 0").select("site", "w", "s.*")
    want = metrics.window_rmse(plain, "y", "p", ["w"], ["site"]).first()
    assert got.windows == want.windows == 3
    assert abs(got.rmse - want.rmse) < 1e-12 and abs(got.rmse - (12.5**0.5 + 2.0) / 2) < 1e-12


def test_pooled_and_window_rmse_differ(spark):
    df = scored(spark, [(1, 0.0, 1.0), (1, 0.0, 1.0), (2, 0.0, 3.0), (2, 0.0, 3.0)])
    pooled = metrics.score(df, "y", "p").first().rmse
    mean = metrics.window_rmse(df, "y", "p", ["w"]).first().rmse
    assert pooled == pytest.approx(5**0.5) and mean == pytest.approx(2.0)


def test_they_agree_for_one_window(spark):
    df = scored(spark, [(1, 0.0, 1.0), (1, 1.0, 3.0)])
    assert metrics.score(df, "y", "p").first().rmse == pytest.approx(
        metrics.window_rmse(df, "y", "p", ["w"]).first().rmse
    )


def test_mape_skips_zero_truth_and_keeps_the_sign(spark):
    df = scored(spark, [(1, 0.0, 5.0), (1, 2.0, 1.0), (1, -2.0, -1.0)])
    assert metrics.score(df, "y", "p").first().mape == pytest.approx(0.0)


def test_pinball(spark):
    df = spark.createDataFrame([(1.0, [0.0, 2.0])], "y double, q array<double>")
    got = {r.level: r.loss for r in metrics.pinball_loss(df, "y", "q", [0.1, 0.9]).collect()}
    assert got == {0.1: pytest.approx(0.1), 0.9: pytest.approx(0.1)}


def test_split_is_stable_under_repartitioning(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a = splits.hash_split(df, ["k"], 0.9).orderBy("k").toPandas()
    b = splits.hash_split(df.repartition(7), ["k"], 0.9).orderBy("k").toPandas()
    assert a.equals(b)
    assert abs((a.split == "train").mean() - 0.9) < 0.02
    other = splits.hash_split(df, ["k"], 0.9, seed=1).orderBy("k").toPandas()
    assert not a.equals(other)


def test_time_split_does_not_overlap(series):
    df = splits.time_split(series({1: {h: 0 for h in range(100)}}), "date", 0.8)
    rows = df.collect()
    train = [hour_of(r.date) for r in rows if r.split == "train"]
    test = [hour_of(r.date) for r in rows if r.split == "test"]
    assert len(train) == 80 and max(train) < min(test)


def test_quantiles_end_up_monotone(spark):
    df = spark.createDataFrame(
        [(False, [0.5, -1.0, 2.0]), (True, [0.5, -1.0, 2.0])], "flag boolean, q array<double>"
    )
    got = {r.flag: r.q for r in scoring.postprocess_quantiles(df).collect()}
    assert got == {False: [0.0, 0.5, 1.0], True: [0.5, -1.0, 2.0]}


def test_correlations_skip_nulls_in_pairs(spark):
    rng = np.random.default_rng(0)
    frame = pd.DataFrame(rng.random((500, 3)) * [1, 1e3, 1] + [2000, 0, 0], columns=list("abc"))
    frame["d"] = frame.a * 2 + rng.random(500) * 0.1
    frame.loc[rng.random(500) < 0.2, "b"] = np.nan
    frame.loc[rng.random(500) < 0.2, "d"] = np.nan
    frame["e"] = 4.0
    rows = [tuple(None if pd.isna(v) else float(v) for v in r) for r in frame.to_numpy()]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double").repartition(5)
    want = frame.corr()
    for r in explore.correlation_matrix(df, list("abcde")).collect():
        if "e" in (r.x, r.y):
            assert r["corr"] is None
        else:
            assert r["corr"] == pytest.approx(want.loc[r.x, r.y], abs=1e-9)


def test_histograms(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 2, 3, 4, 10)], "x double")
    got = {r.bin: r.n for r in explore.histogram(df, "x", 5).collect()}
    assert got == {0: 2, 1: 2, 2: 1, 4: 1}
    cum = explore.cumulative_histogram(df, "x", 25).orderBy("bin").collect()
    assert len(cum) == 25 and cum[0].n == 1 and cum[-1].share == 1.0


def test_rose_shares_sum_to_hundred(spark):
    rng = np.random.default_rng(5)
    rows = [(int(s), float(w), float(d)) for s, w, d in zip(rng.integers(1, 3, 500), rng.random(500) * 20, rng.random(500) * 360)]
    rose = explore.wind_rose(spark.createDataFrame(rows, "site int, ws double, wd double")).toPandas()
    assert rose.groupby("site").share.sum().round(9).tolist() == [100.0, 100.0]
    assert rose.sector.between(0, 15).all() and rose.speed_bin.between(0, 5).all()


def test_density_matches_direct_sum(spark):
    rng = np.random.default_rng(9)
    x = rng.random(60)
    y = x * 0.5 + rng.random(60)
    x[10:20], y[10:20] = x[0], y[0]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = {(r.i, r.j): r.density for r in explore.kde_grid(df, "x", "y", 7).collect()}
    cov = np.cov(x, y) * 60 ** (-1 / 3)
    inv = np.linalg.inv(cov)
    norm = 2 * np.pi * np.sqrt(np.linalg.det(cov)) * 60
    for (i, j), density in got.items():
        d = np.stack([np.linspace(x.min(), x.max(), 7)[i] - x, np.linspace(y.min(), y.max(), 7)[j] - y])
        want = np.exp(-0.5 * np.einsum("ik,ij,jk->k", d, inv, d)).sum() / norm
        assert density == pytest.approx(want, rel=1e-9)
    assert len(got) == 49


def test_lag_correlation_against_direct(spark, series):
    rng = np.random.default_rng(3)
    data = {
        1: {h: v for h, v in enumerate(rng.random(60)) if h % 9},  # gaps in time do not count
        2: {h: (None if h % 5 == 0 else v) for h, v in enumerate(rng.random(40))},
        3: {h: 0.3 for h in range(30)},  # constant
        4: {h: h for h in range(3)},  # shorter than the longest lag
        5: {h: (0.7 if h < 20 else v) for h, v in enumerate(rng.random(23))},
        6: {h: None for h in range(9)},
    }
    lags = (5, 1, 2, 19, 21)
    got = {(r.site, r.lag): r.corr for r in explore.lag_correlation(series(data), lags, span=7).collect()}
    want = {}
    for site, points in data.items():
        v = np.array([np.nan if points[h] is None else points[h] for h in sorted(points)], dtype=float)
        for k in lags:
            a, b = v[k:], v[:-k]
            both = ~np.isnan(a) & ~np.isnan(b)
            if both.any():
                a, b = a[both], b[both]
                want[site, k] = np.corrcoef(a, b)[0, 1] if np.ptp(a) and np.ptp(b) else None
    assert got.keys() == want.keys()
    for at, corr in want.items():
        assert got[at] is None if corr is None else got[at] == pytest.approx(corr, abs=1e-9), at
    assert got[3, 1] is None and got[5, 21] is None
    with pytest.raises(ValueError):
        explore.lag_correlation(series(data), [0])


def test_lag_correlation_sends_a_row_per_chunk_and_lag(spark, series):
    seen = []
    pooled = explore._pooled
    try:
        explore._pooled = lambda parts, keys, **more: (seen.append(parts), pooled(parts, keys, **more))[1]
        explore.lag_correlation(series({1: {h: h % 7 for h in range(100)}}), range(1, 11), span=25)
    finally:
        explore._pooled = pooled
    assert seen[0].count() <= 5 * 10


def test_density_of_many_batches(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, 1500)
    y = 3 * x + rng.normal(0, 0.1, 1500)  # nearly on a line
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (1.0, None)], "x double, y double")
    got = {(r.i, r.j): r.density for r in explore.kde_grid(df, "x", "y", 9).collect()}
    cov = np.cov(x, y) * 1500 ** (-1 / 3)
    inv, norm = np.linalg.inv(cov), 2 * np.pi * np.sqrt(np.linalg.det(cov)) * 1500
    for (i, j), density in got.items():
        d = np.stack([np.linspace(x.min(), x.max(), 9)[i] - x, np.linspace(y.min(), y.max(), 9)[j] - y])
        want = np.exp(-0.5 * np.einsum("ik,ij,jk->k", d, inv, d)).sum() / norm
        assert density == pytest.approx(want, rel=1e-6, abs=1e-12)
    assert len(got) == 81


def test_purged_split_against_all_pairs(spark, series):
    rng = np.random.default_rng(8)
    for hours in (1, 2, 5, 24):
        df = series({s: {int(h): 0 for h in rng.choice(300, 120, replace=False) - 100} for s in (1, 2, 3)})
        roles = F.when(F.pmod(F.xxhash64("site", "date"), F.lit(40)) == 0, "test")
        roles = roles.when(F.pmod(F.xxhash64("date"), F.lit(9)) == 0, "valid").otherwise("train")
        # A site without tests, rows without a start or a site, repeated rows, a column more.
        rows = df.withColumn("split", F.when(F.col("site") == 3, "train").otherwise(roles)).withColumn("_kept", F.lit(1))
        more = spark.createDataFrame([(1, None, 0.0, "train", 1), (None, T0, 0.0, "train", 1)], rows.schema)
        rows = rows.unionByName(rows.filter("site = 1")).unionByName(more).cache()
        got = splits.purged_split(rows, "date", hours)
        assert got.columns == rows.columns
        tests = [(r.site, r.date) for r in rows.filter("split = 'test'").collect()]
        want = []
        for r in rows.collect():
            near = r.site is not None and r.date is not None and any(s == r.site and abs((t - r.date).total_seconds()) < 3600 * hours for s, t in tests)
            want.append((r.site, r.date, "purged" if near and r.split == "train" else r.split))
        assert sorted(map(str, want)) == sorted(str((r.site, r.date, r.split)) for r in got.collect())
        assert hours < 2 or got.filter("split = 'purged'").count()
        rows.unpersist()

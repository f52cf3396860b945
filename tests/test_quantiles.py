import numpy as np
import pytest

from galeframe.operators.explore import box_stats, describe
from galeframe.operators.quantiles import exact_quantiles

SHAPES = {
    "uniform": lambda r, n: r.random(n),
    "mostly_zero": lambda r, n: np.where(r.random(n) < 0.9, 0.0, r.random(n)),
    "heavy_tail": lambda r, n: r.pareto(0.5, n),
    "constant": lambda r, n: np.full(n, 3.0),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_exact_against_numpy(spark, shape):
    rng = np.random.default_rng(1)
    groups = {1: 1, 2: 2, 3: 7, 4: 5000}
    rows = [(g, float(x)) for g, n in groups.items() for x in SHAPES[shape](rng, n)]
    df = spark.createDataFrame(rows, "g int, x double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = exact_quantiles(df, ["g"], "x", probs, buckets=16).collect()
    assert len(got) == len(groups)
    for r in got:
        values = [x for g, x in rows if g == r.g]
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


def test_nulls_are_skipped(spark):
    df = spark.createDataFrame([(1, None), (1, 1.0), (1, 3.0)], "g int, x double")
    assert exact_quantiles(df, ["g"], "x", {"m": 0.5}).first().m == 2.0


def test_describe_and_boxes(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([(1, v) for v in values], "g int, x double")
    d = describe(df, ["g"], "x").first()
    assert (d.n, d.mean, d.q50, d.max) == (5, 22.0, 3.0, 100.0)
    b = box_stats(df, ["g"], "x").first()
    assert (b.whisker_low, b.whisker_high, b.outliers) == (1.0, 4.0, 1)

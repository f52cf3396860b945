from pyspark.sql import functions as F

from galeframe import functions as G


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_half_even_labels(spark):
    rows = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    got = [r[0] for r in rows.select(G.class_label("x", 1).alias("k")).collect()]
    assert got == [0, 2, 2]


def test_clamp_keeps_null_and_is_idempotent(spark):
    rows = spark.createDataFrame([(-1.0,), (0.5,), (0.92,), (2.0,), (None,)], "x double")
    once = rows.select(G.clamp("x").alias("x"))
    assert [r[0] for r in once.collect()] == [0.0, 0.5, 0.92, 0.92, None]
    assert [r[0] for r in once.select(G.clamp("x")).collect()] == [0.0, 0.5, 0.92, 0.92, None]


def test_binary_label_keeps_null(spark):
    rows = spark.createDataFrame([(0.05,), (0.1,), (None,)], "x double")
    assert [r[0] for r in rows.select(G.binary_label("x", 0.1)).collect()] == [0, 1, None]


def test_to_number(spark):
    rows = spark.createDataFrame([(" 1.5 ",), ("",), ("  ",), ("x",), (None,)], "t string")
    assert [r[0] for r in rows.select(G.to_number("t")).collect()] == [1.5, None, None, None, None]


def test_one_hot_and_decode(spark):
    row = one(
        spark,
        hot=G.one_hot(F.lit(2), 4),
        out=G.one_hot(F.lit(9), 4),
        cls=G.decode_class(F.array(F.lit(0.1), F.lit(0.7), F.lit(0.7))),
    )
    assert row.hot == [0, 0, 1, 0] and row.out == [0, 0, 0, 0] and row.cls == 1


def test_direction_bucket(spark):
    row = one(spark, share=G.direction_bucket(F.lit(95.0)), deg=G.direction_bucket(F.lit(95.0), as_share=False))
    assert row.share == 0.25 and row.deg == 90.0


def test_iso_week(spark):
    row = one(spark, w=G.calendar(F.lit("2010-01-03").cast("timestamp_ntz"))["week"])
    assert row.w == 53


def test_quantile_columns(spark):
    q = F.array(*[F.lit(x) for x in (1.2, -0.1, 0.5)])
    row = one(spark, q=G.monotone_quantiles(G.bounded_quantiles(q)))
    assert row.q == [0.0, 0.5, 1.0]

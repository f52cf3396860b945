"""What happens to forecasts after a model has spoken."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.functions import add_hours, bounded_quantiles, monotone_quantiles


def postprocess_quantiles(df: DataFrame, quantiles: str = "q", flag: str = "flag") -> DataFrame:
    """Bounds and sorts the quantiles of the rows to predict; training rows pass unchanged."""
    fixed = monotone_quantiles(bounded_quantiles(quantiles))
    return df.withColumn(quantiles, F.when(F.col(flag), F.col(quantiles)).otherwise(fixed))


def interval_pairs(df: DataFrame, quantiles: str = "q", lowest: int = 5) -> DataFrame:
    """Rows (q, low, high) for the nested intervals between quantile q and 100 - q."""
    pairs = F.transform(
        F.sequence(F.lit(lowest), F.lit(50)),
        lambda k: F.struct(
            k.alias("level"),
            F.element_at(quantiles, k).alias("low"),
            F.element_at(quantiles, 100 - k).alias("high"),
        ),
    )
    kept = [c for c in df.columns if c != quantiles]
    return df.select(*kept, F.explode_outer(pairs).alias("_p")).select(*kept, "_p.*")


def interval_coverage(df: DataFrame, truth: str = "power", quantiles: str = "q") -> DataFrame:
    """Share of truths inside each nested interval, and the mean width."""
    rows = interval_pairs(df.select(truth, quantiles), quantiles)
    inside = (F.col(truth) >= F.col("low")) & (F.col(truth) <= F.col("high"))
    return rows.groupBy("level").agg(
        F.avg(inside.cast("double")).alias("coverage"),
        F.avg(F.col("high") - F.col("low")).alias("width"),
    )


def unroll_blocks(df: DataFrame, start: str, vector: str, value: str = "power") -> DataFrame:
    """A forecast vector per block to one row per hour ``start + 1 .. start + n``."""
    kept = [c for c in df.columns if c != vector]
    return (
        df.select(*kept, F.posexplode_outer(vector).alias("_p", value))
        .withColumn("date", add_hours(start, F.col("_p") + 1))
        .drop("_p")
    )


def mean_per_hour(df: DataFrame, value: str = "power") -> DataFrame:
    """Averages the predictions of all runs that cover an hour."""
    return df.groupBy("site", "date").agg(F.avg(value).alias(value))

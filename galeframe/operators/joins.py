"""Joins of measurements with forecast runs. Every join is on real keys, never on row order.

Keys are ``(site, hour)`` or ``(site, issue time)``, so a site with very many rows still
spreads over many join keys; no side is broadcast by hint, Spark does it on measured size.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.functions import add_hours
from galeframe.operators.ordered import known_neighbours, merged, number_rows


def join_power(power: DataFrame, runs: DataFrame) -> DataFrame:
    """Every forecast step beside the power measured at its valid time."""
    return power.join(runs.withColumnRenamed("new_date", "date"), ["site", "date"])


def join_block_run(block: DataFrame, runs: DataFrame) -> DataFrame:
    """Hours to predict beside the one run issued at the start of their block."""
    return block.join(runs.withColumnRenamed("new_date", "date"), ["site", "date", "start"])


def power_history(
    runs: DataFrame,
    power: DataFrame,
    depth: int = 6,
    horizon: int = 48,
    late_from: int = 24,
    use_future: bool = True,
) -> DataFrame:
    """Adds ``wp_hn_1..depth``: power known around the run.

    The k-th column is the power ``k-1`` hours before the issue; for leads of ``late_from``
    and more it is the power ``k-1`` hours after the end of the run, where measured.
    ``use_future=False`` leaves that second part, a leak of the future, out.

    The values depend on the run only, so they are fetched once per (site, start), in one
    join, and not once per lead and offset.
    """
    offsets = [(k, -k, "n") for k in range(depth)]
    if use_future:
        offsets += [(k, horizon + 1 + k, "p") for k in range(depth)]
    wanted = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.lit(h).alias("h"), F.lit(side).alias("side"))
            for k, h, side in offsets
        ]
    )
    issues = runs.select("site", "start").distinct()
    lookups = (
        issues.select("site", "start", F.explode(wanted).alias("_w"))
        .select("site", "start", "_w.*")
        .withColumn("date", add_hours("start", F.col("h")))
    )
    found = lookups.join(power.select("site", "date", "power"), ["site", "date"])

    def pick(k: int, side: str) -> Column:
        return F.max(F.when((F.col("k") == k) & (F.col("side") == side), F.col("power")))

    aggregates = [pick(k, "n").alias(f"_n{k}") for k in range(depth)]
    if use_future:
        aggregates += [pick(k, "p").alias(f"_p{k}") for k in range(depth)]
    history = found.groupBy("site", "start").agg(*aggregates)
    joined = runs.join(history, ["site", "start"], "left")
    columns = []
    for k in range(depth):
        value = F.col(f"_n{k}")
        if use_future:
            late = F.coalesce(F.col(f"_p{k}"), value)
            value = F.when(F.col("dist") >= late_from, late).otherwise(value)
        columns.append(value.alias(f"wp_hn_{k + 1}"))
    return joined.select(*runs.columns, *columns)


def category_columns(
    features: DataFrame, value: str, categories: Iterable[int] = (1, 2, 3, 4)
) -> DataFrame:
    """One column per lead category, for the hours the last category covers.

    The chained right joins of the definition keep the dates of the last category; one
    conditional aggregate does the same with a single shuffle.
    """
    categories = list(categories)
    last = max(categories)
    return (
        features.groupBy("site", "date")
        .agg(
            *[
                F.max(F.when(F.col("catagory") == c, F.col(value))).alias(f"wind_power_{c}h")
                for c in categories
            ],
            F.bool_or(F.col("catagory") == last).alias("_kept"),
        )
        .filter("_kept")
        .drop("_kept")
    )


def to_wide(
    df: DataFrame, key: str | Sequence[str], name: str, value: str, names: Iterable, prefix: str,
    complete: bool = False,
) -> DataFrame:
    """Long to wide over a fixed list of names; ``complete`` keeps keys that have them all.

    A name that is not listed would be lost, so it ends the job with an error.
    """
    keys = [key] if isinstance(key, str) else list(key)
    names = list(names)
    df = df.filter(listed(name, names))
    wide = df.groupBy(*keys).agg(
        *[F.max(F.when(F.col(name) == n, F.col(value))).alias(f"{prefix}{n}") for n in names],
        F.count_distinct(F.when(F.col(name).isin(names), F.col(name))).alias("_seen")
        if complete
        else F.lit(len(names)).alias("_seen"),
    )
    return wide.filter(F.col("_seen") == len(names)).drop("_seen")


def listed(name: str, names: Sequence) -> Column:
    """True for listed and NULL names; any other is an error."""
    known = F.col(name).isNull() | F.col(name).isin(list(names))
    message = F.concat(F.lit(f"{name} not listed: "), F.col(name).cast("string"))
    return F.when(known, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def to_long(df: DataFrame, key: str, columns: dict[str, int], name: str = "site",
            value: str = "power") -> DataFrame:
    """Wide to long: each column becomes rows labelled with its number; NULLs stay."""
    pairs = F.array(
        *[F.struct(F.lit(n).alias(name), F.col(c).alias(value)) for c, n in columns.items()]
    )
    return df.select(key, F.explode(pairs).alias("_p")).select(key, "_p.*")


def latest_run(runs: DataFrame, values: Sequence[str] = ("ws", "wd", "u", "v")) -> DataFrame:
    """Per hour the values of the run issued last."""
    return runs.groupBy("site", "new_date").agg(
        F.max("start").alias("start"),
        *[F.max_by(v, "start").alias(v) for v in values],
    )


def longest_lead(features: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per key and hour the row with the longest lead."""
    return features.groupBy(*keys).agg(
        F.max("dist").alias("dist"),
        *[F.max_by(v, "dist").alias(v) for v in values if v != "dist"],
    )


def last_known(
    left: DataFrame, left_time: str, right: DataFrame, right_time: str, value: str,
    keys: Sequence[str] = ("site",), name: str | None = None, strictly: bool = False,
) -> DataFrame:
    """As-of join: for each left row the last non-null ``value`` at or before its time.

    Both sides become one time-ordered stream, and the last known value is carried forward
    chunk by chunk. Left rows need a unique (keys, time).
    """
    keys = list(keys)
    tick = left.select(*keys, F.col(left_time).alias("_t"), F.lit(True).alias("_ask"),
                       F.lit(None).cast("double").alias("_v"))
    # Rows without a value cannot be an answer.
    right = right.filter(F.col(value).isNotNull())
    known = right.select(*keys, F.col(right_time).alias("_t"), F.lit(False).alias("_ask"),
                         F.col(value).alias("_v"))
    # Of equal times, the question comes last if it may see the value of the same hour.
    tie = F.col("_ask").cast("int") * (-1 if strictly else 1)
    answered = known_neighbours(
        known.unionByName(tick), keys, "_t", F.col("_v"), before="_seen", order=[tie]
    ).filter("_ask")
    return merged(
        left,
        answered.select(*keys, F.col("_t").alias(left_time), F.col("_seen").alias(name or value)),
        [*keys, left_time],
        "left",
    )


def recent_rows(
    left: DataFrame, left_time: str, right: DataFrame, right_time: str, n: int,
    keys: Sequence[str] = ("site",),
) -> DataFrame:
    """The last ``n`` right rows strictly before each left time, however long ago.

    The right rows of a series are numbered; each left row learns the number of the last one
    before it and joins the ``n`` that end there. Left rows need a unique (keys, time).
    """
    keys = list(keys)
    numbered = number_rows(right, keys, right_time, "_at")
    ends = last_known(left, left_time, numbered, right_time, "_at", keys, "_last", strictly=True)
    back = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = ends.filter(F.col("_last").isNotNull()).withColumn("_back", back)
    asked = asked.withColumn("_at", F.col("_last").cast("long") - F.col("_back")).drop("_last", "_back")
    return merged(asked, numbered.withColumn("_at", F.col("_at").cast("long")), [*keys, "_at"]).drop("_at")


def run_issued_at(windows: DataFrame, at: str, runs: DataFrame) -> DataFrame:
    """All steps of the run issued exactly at ``at``."""
    return windows.join(runs.withColumnRenamed("start", at), ["site", at])


def write_back(target: DataFrame, updates: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Replaces ``value`` where ``updates`` has a row for the key."""
    new = updates.select(*keys, F.col(value).alias("_new"))
    joined = merged(target, new, keys, "left")
    return joined.withColumn(value, F.coalesce("_new", value)).drop("_new")


def union_rows(*frames: DataFrame) -> DataFrame:
    """Union by name; a column missing on one side is NULL there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def extend_horizon(runs: DataFrame, copies: int = 3, step: int = 12, horizon: int = 48) -> DataFrame:
    """Appends empty runs after the last issue of each site, weather unknown."""
    last = runs.groupBy("site").agg(F.max("start").alias("_last"))
    empty = (
        last.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(copies))))
        .withColumn("start", add_hours("_last", F.col("_k") * step))
        .withColumn("dist", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
        .withColumn("new_date", add_hours("start", F.col("dist")))
        .select("site", "start", "dist", "new_date")
    )
    return union_rows(runs, empty)

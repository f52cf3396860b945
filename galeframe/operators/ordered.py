"""Row-order operators that never put a whole series into one task.

A site can hold a third of all rows, so ``Window.partitionBy(site)`` is not an option.
Each operator here works in two levels: rows are grouped by ``(keys, chunk)``, where a
chunk is a fixed span of hours or of row positions, and the little that has to travel
between chunks (row counts, the last known value) is computed on one row per chunk and
joined back. Chunks of hourly rows have a bounded size, whatever the site.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from galeframe.functions import hour_number, add_hours

CHUNK_HOURS = 744
CHUNK = "_chunk"


def hour_chunk(time: str, hours: int = CHUNK_HOURS) -> Column:
    return F.floor(hour_number(time) / F.lit(hours))


def spread(df: DataFrame, *by: str | Column) -> DataFrame:
    """Rows spread by ``by`` over the session's shuffle partitions, a number that Spark does not lower.

    Hourly rows pack well. By the packed bytes it sees, Spark would leave millions of them to one task,
    whose sorts and aggregates, and all that is made of the rows, then spill.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def merged(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a table that grows with the sites, on both sides sorted.

    By its packed bytes such a table often passes for small at run time. As a broadcast it goes
    through the driver and is many times as large there, while other broadcasts wait beside it.
    """
    return left.join(right.hint("merge"), list(keys), how)


def _chunked(df: DataFrame, keys: Sequence[str], time: str, hours: int) -> DataFrame:
    """Labels the chunk and spreads rows by it.

    The explicit repartition matters where the input is already partitioned by site alone:
    that would satisfy a window over (site, chunk) and keep a hot site in one task.
    """
    if CHUNK in df.columns:
        return df
    return df.withColumn(CHUNK, hour_chunk(time, hours)).transform(spread, *keys, CHUNK)


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    name: str = "pos",
    hours: int = CHUNK_HOURS,
    order: Sequence[Column] = (),
    keep_chunk: bool = False,
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """Adds the 0-based position of each row in its series, ordered by ``time`` then ``order``.

    Level 1 numbers rows inside an hour chunk; level 2 sums the row counts of the earlier
    chunks. ``also`` adds further positions that count only the rows that meet a condition
    (on other rows: the number of such rows before). ``keep_chunk`` leaves the chunk label
    in, so that a following operator of this module goes on with the same partitioning.
    """
    keys = list(keys)
    conditions = {name: F.lit(True), **(also or {})}
    chunked = _chunked(df, keys, time, hours)
    before = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    counts = {n: F.count_if(c).alias(f"_n_{n}") for n, c in conditions.items()}
    bases = (
        chunked.groupBy(*keys, CHUNK)
        .agg(*counts.values())
        .select(
            *keys,
            CHUNK,
            *[
                F.coalesce(F.sum(f"_n_{n}").over(before), F.lit(0)).alias(f"_base_{n}")
                for n in conditions
            ],
        )
    )
    inside = (
        Window.partitionBy(*keys, CHUNK)
        .orderBy(F.col(time), *order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    ranks = {f"_rank_{n}": F.count_if(c).over(inside) for n, c in conditions.items()}
    numbered = merged(chunked.withColumns(ranks), bases, [*keys, CHUNK])
    positions = {
        n: F.col(f"_base_{n}")
        + F.col(f"_rank_{n}")
        - (F.lit(1) if n == name else F.when(c, 1).otherwise(0))
        for n, c in conditions.items()
    }
    numbered = numbered.withColumns(positions).drop(
        *[f"_base_{n}" for n in conditions], *[f"_rank_{n}" for n in conditions]
    )
    return numbered if keep_chunk else numbered.drop(CHUNK)


def known_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    known: Column,
    before: str | None = "prev",
    after: str | None = None,
    inclusive: bool = True,
    hours: int = CHUNK_HOURS,
    order: Sequence[Column] = (),
) -> DataFrame:
    """Adds the nearest earlier (and later) non-null ``known`` of the series.

    ``known`` is any column expression, usually a struct that is NULL where nothing is
    known. With ``inclusive`` a row may see itself. Gaps may span any number of chunks:
    the last known value of each chunk is carried over on a one-row-per-chunk table.
    """
    keys = list(keys)
    chunked = _chunked(df, keys, time, hours).withColumn("_known", known)
    by_time = [F.col(time), *order]
    at = F.when(
        F.col("_known").isNotNull(), F.struct(F.struct(*by_time).alias("t"), F.col("_known"))
    )
    across = Window.partitionBy(*keys)
    ends, carries = [], []
    if before:
        ends.append(F.max(at).alias("_last"))
        last = F.col("_last")["_known"]
        carries.append(_carry(last, across.orderBy(CHUNK), 1).alias("_from_before"))
    if after:
        ends.append(F.min(at).alias("_first"))
        first = F.col("_first")["_known"]
        carries.append(_carry(first, across.orderBy(F.desc(CHUNK)), 1).alias("_from_after"))
    carried = chunked.groupBy(*keys, CHUNK).agg(*ends).select(*keys, CHUNK, *carries)
    inside = Window.partitionBy(*keys, CHUNK)
    edge = 0 if inclusive else 1
    out = chunked
    if before:
        forward = inside.orderBy(*by_time)
        out = out.withColumn("_in_before", _carry(F.col("_known"), forward, edge))
    if after:
        backward = inside.orderBy(*[F.desc(c) for c in by_time])
        out = out.withColumn("_in_after", _carry(F.col("_known"), backward, edge))
    out = merged(out, carried, [*keys, CHUNK])
    if before:
        out = out.withColumn(before, F.coalesce("_in_before", "_from_before"))
    if after:
        out = out.withColumn(after, F.coalesce("_in_after", "_from_after"))
    return out.drop("_known", "_in_before", "_in_after", "_from_before", "_from_after", CHUNK)


def _carry(known: Column, window: WindowSpec, edge: int) -> Column:
    """Last known value on the way; a growing frame, linear in the number of rows."""
    frame = window.rowsBetween(Window.unboundedPreceding, -edge)
    return F.last(known, ignorenulls=True).over(frame)


def spread_chunks(
    df: DataFrame,
    keys: Sequence[str],
    axis: Column,
    span: int,
    before: int = 0,
    after: int = 0,
    lowest: int | None = None,
) -> DataFrame:
    """Assigns rows to chunks of ``span`` axis units and copies edge rows to the neighbours,
    but not to chunks below ``lowest``, where no row has its home.

    Adds ``_axis``, ``_chunk`` and ``_own``. A chunk also receives the ``before`` units in
    front of it and the ``after`` units behind it, as rows with ``_own = false``. A window
    over ``(keys, _chunk)`` then sees all it needs, for offsets within the halo.
    """
    if max(before, after) > span:
        raise ValueError("a halo may not be wider than the chunk")
    inside = F.col("_axis") % F.lit(span)
    inside = F.when(inside < 0, inside + span).otherwise(inside)
    home = F.floor(F.col("_axis") / F.lit(span))
    targets = [home]
    if before:
        targets.append(F.when(inside >= span - before, home + 1))
    if after:
        ahead = inside < after
        targets.append(F.when(ahead if lowest is None else ahead & (home > lowest), home - 1))
    return (
        df.withColumn("_axis", axis)
        .withColumn("_home", home)
        .withColumn(CHUNK, F.explode(F.array_compact(F.array(*targets))))
        .withColumn("_own", F.col(CHUNK) == F.col("_home"))
        .drop("_home")
        .transform(spread, *keys, CHUNK)
    )


def shifted(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    value: str,
    steps: Sequence[int],
    prefix: str = "lag_",
    span: int = 2048,
) -> DataFrame:
    """Adds the value ``k`` rows earlier for every ``k`` in ``steps`` (negative = later).

    Positional, so gaps in time do not matter. All shifts share one sort.
    """
    back = max([k for k in steps if k > 0], default=0)
    ahead = max([-k for k in steps if k < 0], default=0)
    span = max(span, back, ahead)
    spread = spread_chunks(
        number_rows(df, keys, time, "_pos"), keys, F.col("_pos"), span, back, ahead
    )
    window = Window.partitionBy(*keys, CHUNK).orderBy("_axis")
    lags = [
        (F.lag(value, k) if k > 0 else F.lead(value, -k)).over(window).alias(_lag_name(prefix, k))
        for k in steps
    ]
    return spread.select("*", *lags).filter("_own").drop("_axis", CHUNK, "_own", "_pos")


def _lag_name(prefix: str, k: int) -> str:
    return f"{prefix}{k}" if k > 0 else f"{prefix}m{-k}"


def row_gaps(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Hours since the previous row and (negative) hours to the next row of the series."""
    seen = known_neighbours(
        df, keys, time, F.col(time), before="_prev", after="_next", inclusive=False
    )
    return seen.select(
        *df.columns,
        F.timestamp_diff("HOUR", F.col("_prev"), F.col(time)).alias("pre_gap"),
        F.timestamp_diff("HOUR", F.col("_next"), F.col(time)).alias("next_gap"),
    )


def every_nth(df: DataFrame, keys: Sequence[str], time: str, stride: int) -> DataFrame:
    """Rows 0, stride, 2*stride... of each series; keeps ``pos``."""
    return number_rows(df, keys, time).filter(F.col("pos") % stride == 0)


def islands(df: DataFrame, keys: Sequence[str], time: str) -> DataFrame:
    """Runs of consecutive hours: adds ``island`` (a label), ``pos`` in the run from 0."""
    keys = list(keys)
    numbered = number_rows(df, keys, time, "_pos").withColumn(
        "island", add_hours(time, -F.col("_pos").cast("int"))
    )
    first = numbered.groupBy(*keys, "island").agg(F.min("_pos").alias("_from"))
    return (
        merged(numbered, first, [*keys, "island"])
        .withColumn("pos", F.col("_pos") - F.col("_from"))
        .drop("_pos", "_from")
    )


def first_rows(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, name: str = "rn"
) -> DataFrame:
    """The first ``n`` rows of each group in the given order.

    The rank filter lets Spark keep at most ``n`` rows per group and task before the
    shuffle, so a hot group arrives as a handful of rows.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)


def with_group_stats(df: DataFrame, keys: Sequence[str], **stats: Column) -> DataFrame:
    """Group statistics beside every row, by aggregate and join.

    The aggregate combines on the map side and yields one row per group; unlike a window
    it never gathers a group. Spark broadcasts the result when its measured size allows.
    """
    keys = list(keys)
    aggregates = [expr.alias(name) for name, expr in stats.items()]
    return df.join(df.groupBy(*keys).agg(*aggregates), keys)


def mixed_sort(df: DataFrame) -> DataFrame:
    """By date and site, longest lead first."""
    return df.orderBy(F.asc("date"), F.asc("site"), F.desc("dist"))

"""The tables behind the exploratory plots."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from galeframe.functions import add_hours
from galeframe.operators.joins import listed
from galeframe.operators.ordered import CHUNK, first_rows, number_rows, spread_chunks, with_group_stats
from galeframe.operators.quantiles import exact_quantiles


def _as_rows(one: DataFrame, columns: dict[str, list[Column]], fields: Sequence[str], label: str,
             keys: Sequence[str] = ()) -> DataFrame:
    """One wide aggregate row (per key) to one row per label."""
    entries = [
        F.struct(F.lit(name).alias(label), *[c.alias(f) for c, f in zip(values, fields)])
        for name, values in columns.items()
    ]
    return one.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e.*")


def ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum and maximum of every column, in one pass."""
    one = df.agg(
        *[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns]
    )
    return _as_rows(
        one, {c: [F.col(f"lo_{c}"), F.col(f"hi_{c}")] for c in columns}, ["lo", "hi"], "feature"
    )


def zero_share(df: DataFrame, keys: Sequence[str], value: str = "power") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(F.when(F.col(value) == 0, 1.0).otherwise(0.0)).alias("ratio")
    )


def describe(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, min, quartiles and max per group."""
    moments = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    quartiles = exact_quantiles(df, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return moments.join(quartiles, list(keys)).select(
        *keys, "n", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def box_stats(df: DataFrame, keys: Sequence[str], value: str, reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (the outermost values within ``reach`` IQR) and outlier count."""
    quartiles = exact_quantiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    x, iqr = F.col(value), F.col("q3") - F.col("q1")
    low, high = F.col("q1") - F.lit(reach) * iqr, F.col("q3") + F.lit(reach) * iqr
    return (
        df.select(*keys, value)
        .join(quartiles, list(keys))
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.min(F.when(x >= low, x)).alias("whisker_low"),
            F.max(F.when(x <= high, x)).alias("whisker_high"),
            F.count_if((x < low) | (x > high)).alias("outliers"),
        )
    )


def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between the minimum and maximum (of the group); the last is closed."""
    ranged = _ranged(df, value, keys)
    span = F.col("_hi") - F.col("_lo")
    place = F.floor((F.col(value) - F.col("_lo")) / (span / F.lit(bins)))
    bin_ = F.when(span == 0, F.lit(0)).otherwise(F.least(place, F.lit(bins - 1)))
    counted = ranged.groupBy(*keys, bin_.cast("int").alias("bin"), "_lo", "_hi").agg(
        F.count(F.lit(1)).alias("n")
    )
    width = (F.col("_hi") - F.col("_lo")) / F.lit(bins)
    return counted.select(*keys, "bin", (F.col("_lo") + F.col("bin") * width).alias("left"), "n")


def _ranged(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value)
    if keys:
        return with_group_stats(rows, keys, _lo=F.min(value), _hi=F.max(value))
    ends = rows.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("e"))
    return rows.withColumn("_e", ends.scalar()).select(
        value, F.col("_e.lo").alias("_lo"), F.col("_e.hi").alias("_hi")
    )


def cumulative_histogram(df: DataFrame, value: str, bins: int = 25) -> DataFrame:
    """Cumulative share over bins whose range is widened by half a bin step on both sides.

    The running sum goes over at most ``bins`` rows. Values at the right end of the widened
    range cannot occur, so every value has a bin; empty bins are listed too.
    """
    ranged = _ranged(df, value, ())
    pad = (F.col("_hi") - F.col("_lo")) / F.lit(2.0 * (bins - 1))
    low = F.col("_lo") - pad
    width = (F.col("_hi") + pad - low) / F.lit(bins)
    bin_ = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    counts = ranged.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    full = spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left")
    filled = full.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.lit(0).alias("_all"))
    group = Window.partitionBy("_all")
    return filled.select(
        "bin",
        "n",
        (F.sum("n").over(group.orderBy("bin")) / F.sum("n").over(group)).alias("share"),
    )


def lag_correlation(
    df: DataFrame, lags: Sequence[int], keys: Sequence[str] = ("site",), time: str = "date",
    value: str = "power", span: int = 4096,
) -> DataFrame:
    """Correlation of a series with its own past, by row position, one row per lag.

    The rows are never copied per lag. A task holds a chunk of ``span`` rows with the longest lag
    in front of it, takes the moments of all lags from it by matrix products, and sends a row per
    chunk and lag. Missing values (NULL or NaN) leave their pairs out. NULL where one side is
    constant; a lag without any pair has no row.
    """
    lags = sorted(set(lags))
    if lags and lags[0] < 1:
        raise ValueError("a lag is at least one row")
    keys, back = list(keys), max(lags, default=0)
    numbered = number_rows(df.select(*keys, time, F.col(value).cast("double").alias("_v")), keys, time, "_pos")
    spread = spread_chunks(numbered, keys, F.col("_pos"), max(span, back), back)
    fields = ["n", "mi", "mj", "sii", "sjj", "sij", "loi", "hii", "loj", "hij"]

    def moments(chunk: pd.DataFrame) -> pd.DataFrame:
        chunk = chunk.sort_values("_axis")
        own = int(chunk["_own"].sum())
        halo = len(chunk) - own
        series = np.concatenate([np.full(back - halo, np.nan), chunk["_v"].to_numpy(dtype=float)])
        seen = ~np.isnan(series)
        if not own or not seen.any():
            return pd.DataFrame({c: [] for c in [*keys, "lag", *fields]})
        shift = series[seen][0]
        shifted_ = np.where(seen, series - shift, 0.0)

        def past(x: np.ndarray) -> np.ndarray:
            return np.lib.stride_tricks.sliding_window_view(x, back + 1)[:, ::-1][:, lags]

        x, m, y, w = shifted_[back:], seen[back:].astype(float), past(shifted_), past(seen)
        mask = w.astype(float)
        n = m @ mask
        safe = np.maximum(n, 1.0)
        si, sj = x @ mask, m @ y
        both = w & seen[back:, None]
        side = np.broadcast_to(x[:, None], y.shape)
        out = {
            "n": n, "mi": shift + si / safe, "mj": shift + sj / safe,
            "sii": (x * x) @ mask - si * si / safe, "sjj": m @ (y * y) - sj * sj / safe, "sij": x @ y - si * sj / safe,
            "loi": np.where(both, side, np.inf).min(0) + shift, "hii": np.where(both, side, -np.inf).max(0) + shift,
            "loj": np.where(both, y, np.inf).min(0) + shift, "hij": np.where(both, y, -np.inf).max(0) + shift,
        }
        return pd.DataFrame({**{k: chunk[k].iloc[0] for k in keys}, "lag": lags, **out})

    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    schema = f"{named}, lag int, " + ", ".join(f"{c} double" for c in fields)
    grouped = spread.select(*keys, CHUNK, "_axis", "_own", "_v").groupBy(*keys, CHUNK)
    extremes = {"loi": F.min("loi"), "hii": F.max("hii"), "loj": F.min("loj"), "hij": F.max("hij")}
    pooled = _pooled(grouped.applyInPandas(moments, schema), [*keys, "lag"], **extremes)
    varied = (F.col("loi") < F.col("hii")) & (F.col("loj") < F.col("hij"))
    return pooled.select(*keys, "lag", F.when(varied, _corr()).alias("corr"))


def _corr() -> Column:
    return F.col("sij") / F.nullif(F.sqrt(F.col("sii") * F.col("sjj")), F.lit(0.0))


def _pooled(parts: DataFrame, keys: Sequence[str], **more: Column) -> DataFrame:
    """Pair moments of disjoint sets of rows, merged about the common mean of their group."""
    group = Window.partitionBy(*keys)
    centre = {c: F.sum(F.col("n") * F.col(c)).over(group) / F.sum("n").over(group) for c in ("mi", "mj")}
    placed = parts.filter(F.col("n") > 0).select("*", centre["mi"].alias("_ci"), centre["mj"].alias("_cj"))
    di, dj = F.col("mi") - F.col("_ci"), F.col("mj") - F.col("_cj")
    return placed.groupBy(*keys).agg(
        F.sum(F.col("sii") + F.col("n") * di * di).alias("sii"),
        F.sum(F.col("sjj") + F.col("n") * dj * dj).alias("sjj"),
        F.sum(F.col("sij") + F.col("n") * di * dj).alias("sij"),
        *[c.alias(name) for name, c in more.items()],
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of columns, over the rows that have both values.

    Every task folds its Arrow batches into one small set of pair moments (matrix products
    over the batch), and the few rows of moments are merged about the common mean.
    """
    columns = list(columns)
    upper = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    left, right = (np.array(side) for side in zip(*upper))

    def moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            values = batch.to_numpy(dtype=float)
            seen = ~np.isnan(values)
            shift = np.nan_to_num(np.where(seen, values, 0.0).sum(0) / np.maximum(seen.sum(0), 1))
            x = np.where(seen, values - shift, 0.0)
            m = seen.astype(float)
            n = m.T @ m
            # sums over the rows that have both: of column i, of column j, of the products
            si, sj = x.T @ m, m.T @ x
            safe = np.maximum(n, 1.0)
            part = [
                n,
                shift[:, None] + si / safe,
                shift[None, :] + sj / safe,
                (x * x).T @ m - si * si / safe,
                m.T @ (x * x) - sj * sj / safe,
                x.T @ x - si * sj / safe,
            ]
            total = part if total is None else _merged(total, part)
        if total is not None:
            picked = [t[left, right] for t in total]
            yield pd.DataFrame(
                dict(zip(["n", "mi", "mj", "sii", "sjj", "sij"], picked), i=left, j=right)
            )

    parts = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).mapInPandas(
        moments,
        "n double, mi double, mj double, sii double, sjj double, sij double, i int, j int",
    )
    merged = _pooled(parts, ["i", "j"])
    names = F.lit(columns)
    table = merged.select(
        F.get(names, F.col("i")).alias("x"), F.get(names, F.col("j")).alias("y"), _corr().alias("corr")
    )
    sides = F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))
    both = F.when(F.col("x") == F.col("y"), F.slice(sides, 1, 1)).otherwise(sides)
    return table.select(F.explode_outer(both).alias("_s"), "corr").select("_s.x", "_s.y", "corr")


def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Moments of two disjoint sets of rows together."""
    n = a[0] + b[0]
    safe = np.maximum(n, 1.0)
    di, dj = b[1] - a[1], b[2] - a[2]
    between = a[0] * b[0] / safe
    return [
        n,
        a[1] + di * b[0] / safe,
        a[2] + dj * b[0] / safe,
        a[3] + b[3] + di * di * between,
        a[4] + b[4] + dj * dj * between,
        a[5] + b[5] + di * dj * between,
    ]


def wind_rose(
    df: DataFrame, speed_bins: int = 6, sectors: int = 16, keys: Sequence[str] = ("site",)
) -> DataFrame:
    """Share of rows in % per direction sector and speed bin; the first sector is centred on
    north, speed bins are of equal width between the site's smallest and largest speed."""
    width = 360.0 / sectors
    sector = F.pmod(F.floor((F.col("wd") + F.lit(width / 2)) / F.lit(width)), F.lit(sectors))
    ranged = with_group_stats(
        df.select(*keys, "ws", "wd"), keys, _lo=F.min("ws"), _hi=F.max("ws"),
        _all=F.count(F.lit(1)),
    )
    step = (F.col("_hi") - F.col("_lo")) / F.lit(speed_bins)
    bin_ = F.when(step == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("ws") - F.col("_lo")) / step), F.lit(speed_bins - 1))
    )
    return (
        ranged.groupBy(
            *keys, sector.cast("int").alias("sector"), bin_.cast("int").alias("speed_bin"), "_all"
        )
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*keys, "sector", "speed_bin", "n", (F.lit(100.0) * F.col("n") / F.col("_all")).alias("share"))
    )


def zero_scatter(df: DataFrame, cell: float = 1.0, keys: Sequence[str] = ("site",)) -> DataFrame:
    """(u, v) points with and without output, counted in square cells; with a ``cluster``
    column the abnormal zero-output points (cluster 0) get a label of their own."""
    label = F.when(F.col("power") != 0, "nonzero")
    if "cluster" in df.columns:
        label = label.when(F.col("cluster") == 0, "abnormal")
    label = label.otherwise("zero")
    return df.groupBy(
        *keys,
        label.alias("label"),
        F.floor(F.col("u") / F.lit(cell)).alias("u_cell"),
        F.floor(F.col("v") / F.lit(cell)).alias("v_cell"),
    ).agg(F.count(F.lit(1)).alias("n"))


def power_curve(df: DataFrame, width: float = 1.0, keys: Sequence[str] = ("site",)) -> DataFrame:
    """Wind speed against power: count, mean and quartiles of power per speed bin."""
    binned = df.filter(F.col("ws").isNotNull() & F.col("power").isNotNull()).select(
        *keys, F.floor(F.col("ws") / F.lit(width)).cast("int").alias("ws_bin"), "power"
    )
    group = [*keys, "ws_bin"]
    means = binned.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.avg("power").alias("mean")
    )
    quartiles = exact_quantiles(binned, group, "power", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return means.join(quartiles, group)


def kde_grid(df: DataFrame, x: str, y: str, bins: int = 100) -> DataFrame:
    """Exact Gaussian kernel density of (x, y) on a ``bins`` x ``bins`` grid over the data range.

    Bandwidth by Scott's rule on the full covariance. Equal points are counted first; a task
    folds its Arrow batches into one grid of sums, a matrix product per grid line, so no row is
    made per point and cell and the shuffle carries ``bins**2`` rows per task.
    """
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(x).alias("_x"), F.col(y).alias("_y")
    )
    factor = F.pow(F.col("n"), F.lit(-1.0 / 6.0))
    moments = points.agg(
        F.count(F.lit(1)).alias("n"),
        F.var_samp("_x").alias("vx"),
        F.var_samp("_y").alias("vy"),
        F.covar_samp("_x", "_y").alias("vxy"),
        F.min("_x").alias("x0"),
        F.max("_x").alias("x1"),
        F.min("_y").alias("y0"),
        F.max("_y").alias("y1"),
    ).select("*", (factor * factor).alias("h2"))
    det = F.col("vx") * F.col("vy") - F.col("vxy") * F.col("vxy")
    shape = moments.select(
        F.struct(
            "x0",
            "y0",
            ((F.col("x1") - F.col("x0")) / F.lit(bins - 1.0)).alias("dx"),
            ((F.col("y1") - F.col("y0")) / F.lit(bins - 1.0)).alias("dy"),
            (F.col("vy") / det / F.col("h2")).alias("a"),
            (-F.col("vxy") / det / F.col("h2")).alias("b"),
            (F.col("vx") / det / F.col("h2")).alias("c"),
            (F.lit(1.0) / (F.lit(2.0) * F.pi() * F.sqrt(det) * F.col("h2") * F.col("n"))).alias("k"),
        ).alias("s")
    )
    weighted = points.groupBy("_x", "_y").agg(F.count(F.lit(1)).alias("_w"))
    spread = max(
        df.sparkSession.sparkContext.defaultParallelism,
        int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")),
    )
    # Few bytes but bins**2 kernels per row: keep adaptive coalescing from merging the tasks.
    weighted = weighted.repartition(spread)
    step = np.arange(bins)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, k = np.zeros((bins, bins)), None
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.iloc[at : at + 512]
                # The same shape stands on every row.
                x0, y0, dx, dy, a, b, c, k = part[list(shape_fields)].iloc[0]
                px, py, w = (part[name].to_numpy(dtype=float) for name in ("_x", "_y", "_w"))
                gx = x0 + step * dx
                for j in range(bins):
                    ey = y0 + j * dy - py
                    weight = w * np.exp(-0.5 * (c - b * b / a) * ey * ey)
                    ex = gx - (px - b / a * ey)[:, None]
                    total[:, j] += weight @ np.exp(-0.5 * a * ex * ex)
        if k is not None:
            yield pd.DataFrame({"i": np.repeat(step, bins), "j": np.tile(step, bins), "part": k * total.ravel()})

    shape_fields = ("x0", "y0", "dx", "dy", "a", "b", "c", "k")
    placed = weighted.withColumn("_s", shape.scalar()).select("_x", "_y", "_w", "_s.*")
    return placed.mapInPandas(fold, "i int, j int, part double").groupBy("i", "j").agg(F.sum("part").alias("density"))


def compare_slice(
    df: DataFrame, predicted: str, n: int = 480, high: float = 0.92
) -> DataFrame:
    """The first ``n`` rows per site, the bounded prediction beside the measured power."""
    from galeframe.functions import clamp

    head = first_rows(df, ["site"], [F.col("date")], n, "place")
    return head.select(
        "site", "date", "place", clamp(predicted, 0.0, high).alias("wp"), "power"
    )


def normalised_series(df: DataFrame, days: int = 31) -> DataFrame:
    """The first days of each site, wind speed as a share of its maximum in that slice."""
    from galeframe.operators.filters import first_days

    cut = first_days(df, days)
    return (
        with_group_stats(cut, ["site"], _peak=F.max("ws"))
        .withColumn("ws", F.col("ws") / F.nullif(F.col("_peak"), F.lit(0.0)))
        .select("site", "date", "ws", "power")
    )


def metric_series(log: DataFrame, tags: Sequence[str]) -> DataFrame:
    """Training log (run, step, tag, value) to one column per tag; an unlisted tag is an error."""
    return log.filter(listed("tag", tags)).groupBy("run", "step").agg(
        *[F.max(F.when(F.col("tag") == t, F.col("value"))).alias(t) for t in tags]
    )

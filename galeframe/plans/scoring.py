"""Splits, metrics and the reshaping of forecasts."""

from pyspark.sql import functions as F

from galeframe.functions import add_hours, binary_label, hour_number
from galeframe.operators import joins, metrics, scoring, splits
from galeframe.operators.filters import trainable
from galeframe.operators.ordered import shifted
from galeframe.operators.sequences import cut_windows
from galeframe.plans import views
from galeframe.plans.registry import query
from galeframe.plans.sequences import base_sql, near, windows_sql


def share_sql(*keys, seed=0):
    text = " || '|' || ".join([*keys, f"'{seed}'"])
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296e0"


_STAMP = "strftime(date, '%Y-%m-%d %H:%M:%S')"


@query(
    "hash_split",
    f"""SELECT site, date, power, CASE WHEN {share_sql('site', _STAMP)} < 9e-1
               THEN 'train' ELSE 'test' END AS split FROM obs""",
)
def _(spark, sf):
    obs = views.obs(spark, sf).select("site", "date", "power")
    return splits.hash_split(obs, ["site", "date"], 0.9)


@query(
    "time_split",
    """WITH s AS (SELECT site, min(date) AS lo, max(date) AS hi FROM obs_sparse GROUP BY site)
       SELECT site, date, power,
              CASE WHEN datediff('hour', lo, date) / CAST(datediff('hour', lo, hi) + 1 AS DOUBLE)
                   < 9e-1 THEN 'train' ELSE 'test' END AS split
       FROM obs_sparse JOIN s USING (site)""",
)
def _(spark, sf):
    return splits.time_split(views.obs_sparse(spark, sf), "date", 0.9)


_WINDOW = 84


@query(
    "purged_split",
    f"""WITH w AS (SELECT site, date AS start, CAST(floor(datediff('hour', TIMESTAMP '2024-01-01', date) / 168e0) AS BIGINT) AS week
              FROM obs WHERE date <= (SELECT max(date) FROM obs) - INTERVAL {_WINDOW - 1} HOUR),
            s AS (SELECT *, CASE WHEN {share_sql('site', 'week')} < 9e-1 THEN 'train' ELSE 'test' END AS split FROM w),
            t AS (SELECT DISTINCT site, week, min(start) OVER x AS lo, max(start) OVER x AS hi FROM s WHERE split = 'test'
              WINDOW x AS (PARTITION BY site, week))
       SELECT site, start, CASE WHEN split = 'train' AND EXISTS (SELECT 1 FROM t WHERE t.site = s.site
              AND t.lo < s.start + INTERVAL {_WINDOW} HOUR AND t.hi > s.start - INTERVAL {_WINDOW} HOUR)
              THEN 'purged' ELSE split END AS split FROM s""",
)
def _(spark, sf):
    """Windows of 36 + 48 hours from every hour on; tests are whole weeks of a site."""
    obs = views.obs(spark, sf).select("site", F.col("date").alias("start"))
    last = views.table(spark, sf, "events").agg(F.date_trunc("hour", F.max("ts")).cast("timestamp_ntz")).scalar()
    whole = obs.filter(F.col("start") <= add_hours(last, F.lit(1 - _WINDOW)))
    weeks = whole.withColumn("week", F.floor(hour_number("start") / 168))
    marked = splits.hash_split(weeks, ["site", "week"], 0.9).drop("week")
    return splits.purged_split(marked, "start", _WINDOW)


_TRAINABLE = """t AS (SELECT site, date, start, power, ws FROM features
                      WHERE power >= 5e-2 AND flag)"""


@query(
    "site_and_total",
    f"""WITH {_TRAINABLE}
        SELECT site, date, start, power, ws, CAST(site AS VARCHAR) AS dataset
        FROM t WHERE ws IS NOT NULL
        UNION ALL SELECT site, date, start, power, ws, 'total' FROM t""",
)
def _(spark, sf):
    rows = trainable(views.features(spark, sf), 0.05, need_wind=False)
    return splits.site_and_total(rows.select("site", "date", "start", "power", "ws"))


@query(
    "binary_dataset",
    f"""WITH before AS (SELECT site, date, lag(power) OVER (PARTITION BY site ORDER BY date)
              AS previous FROM obs)
        SELECT f.site, f.date, f.start, CAST(f.power >= 1e-1 AS INTEGER) AS label, b.previous,
               f.ws, CASE WHEN {share_sql('f.site', "strftime(f.date, '%Y-%m-%d %H:%M:%S')",
                                          'f.dist', seed=1)}
               < 9e-1 THEN 'train' ELSE 'test' END AS split
        FROM features f JOIN before b ON b.site = f.site AND b.date = f.date""",
)
def _(spark, sf):
    power = views.obs(spark, sf).select("site", "date", "power")
    before = shifted(power, ["site"], "date", "power", [1]).select(
        "site", "date", F.col("lag_1").alias("previous")
    )
    rows = views.features(spark, sf).join(before, ["site", "date"])
    return splits.hash_split(rows, ["site", "date", "dist"], 0.9, seed=1).select(
        "site", "date", "start", binary_label("power", 0.1).alias("label"), "previous", "ws",
        "split",
    )


_D = "(ws_power - power)"


@query(
    "rmse_pooled",
    f"""SELECT count(*) AS n, round(sqrt(avg({_D} * {_D}) + 1e-8), 9) AS rmse FROM features
        WHERE NOT flag""",
)
def _(spark, sf):
    rows = views.features(spark, sf).filter(~F.col("flag"))
    pooled = metrics.score(rows, "power", "ws_power", epsilon=1e-8)
    return pooled.select("n", F.round("rmse", 9).alias("rmse"))


@query(
    "rmse_window_mean",
    f"""WITH {base_sql()}, {windows_sql(84, 1)},
        per_window AS (SELECT w.site, w.window_start, sqrt(avg({_D.replace('ws_power', 'c.ws_power').replace('- power', '- c.power')} * {_D.replace('ws_power', 'c.ws_power').replace('- power', '- c.power')})) AS rmse
          FROM win w JOIN base c ON c.site = w.site AND c.i BETWEEN w.i + 36 AND w.i + 83
          GROUP BY 1, 2)
        SELECT site, count(*) AS windows, round(avg(rmse), 9) AS rmse FROM per_window
        GROUP BY site""",
)
def _(spark, sf):
    cut = cut_windows(near(spark, sf), ["power", "ws_power"], 84)
    scored = metrics.packed_window_rmse(cut, 36, 48, "power", "ws_power", ["site"])
    return scored.select("site", "windows", F.round("rmse", 9).alias("rmse"))


@query(
    "mape",
    f"""SELECT site, round(avg(abs({_D}) / power) FILTER (power <> 0) * 100, 6) AS mape
        FROM features GROUP BY site""",
)
def _(spark, sf):
    scored = metrics.score(views.features(spark, sf), "power", "ws_power", ["site"])
    return scored.select("site", F.round("mape", 6).alias("mape"))


@query(
    "r4_mse",
    f"SELECT catagory, count(*) AS n, round(avg({_D} * {_D}), 9) AS mse FROM features GROUP BY 1",
)
def _(spark, sf):
    scored = metrics.score(views.features(spark, sf), "power", "ws_power", ["catagory"])
    return scored.select("catagory", "n", F.round("mse", 9).alias("mse"))


@query(
    "pinball_loss",
    """WITH rows AS (SELECT power, unnest(q) AS q, unnest(range(1, 100)) / 100e0 AS level
              FROM quantiles)
       SELECT level, round(avg(greatest(level * (power - q), (level - 1) * (power - q))), 9) AS loss
       FROM rows GROUP BY level""",
)
def _(spark, sf):
    levels = [k / 100 for k in range(1, 100)]
    loss = metrics.pinball_loss(views.quantiles(spark, sf), "power", "q", levels)
    return loss.withColumn("loss", F.round("loss", 9))


@query(
    "batch_predict",
    "WITH m AS (SELECT site, date, avg(ws_power) AS power FROM features GROUP BY 1, 2) "
    "SELECT m1.date, "
    + ", ".join(f"round(m{k}.power, 9) AS wp{k}" for k in range(1, 6))
    + " FROM (SELECT * FROM m WHERE site = 1) m1 "
    + " ".join(
        f"JOIN (SELECT * FROM m WHERE site = {k}) m{k} USING (date)" for k in range(2, 6)
    ),
    by="kind",
)
def _(spark, sf):
    """A 48-vector per run, unrolled to hours, averaged over runs, one column per site."""
    steps = F.array_sort(F.collect_list(F.struct("dist", "ws_power")))
    vectors = (
        views.features(spark, sf, "kind")
        .groupBy("site", "start")
        .agg(F.transform(steps, lambda s: s["ws_power"]).alias("forecast"))
    )
    hours = scoring.mean_per_hour(scoring.unroll_blocks(vectors, "start", "forecast"))
    rounded = hours.withColumn("power", F.round("power", 9))
    return joins.to_wide(rounded, "date", "site", "power", range(1, 6), "wp", complete=True)


@query(
    "interval_bands",
    """WITH rows AS (SELECT site, date, power, q, CAST(unnest(range(5, 51)) AS INTEGER) AS level
              FROM quantiles)
       SELECT site, date, power, level, q[level] AS low, q[100 - level] AS high FROM rows""",
)
def _(spark, sf):
    return scoring.interval_pairs(
        views.quantiles(spark, sf).select("site", "date", "power", "q")
    )


@query(
    "interval_coverage",
    """WITH rows AS (SELECT power, list_sort(q) AS q, CAST(unnest(range(5, 51)) AS INTEGER) AS level
              FROM quantiles)
       SELECT level, round(avg(CAST(power >= q[level] AND power <= q[100 - level] AS INTEGER)), 9)
                AS coverage,
              round(avg(q[100 - level] - q[level]), 9) AS width
       FROM rows GROUP BY level""",
)
def _(spark, sf):
    sorted_ = views.quantiles(spark, sf).withColumn("q", F.array_sort("q"))
    covered = scoring.interval_coverage(sorted_)
    return covered.select(
        "level", F.round("coverage", 9).alias("coverage"), F.round("width", 9).alias("width")
    )

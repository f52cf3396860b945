"""The tables behind the plots."""

from pyspark.sql import functions as F

from galeframe.functions import calendar, powers_of
from galeframe.operators import explore, joins
from galeframe.plans import views
from galeframe.plans.aggregates import box_sql, rounded_box
from galeframe.plans.registry import query


def _histogram_sql(source, value, bins, key=None):
    group, join = (f"{key}, ", f"USING ({key})") if key else ("", "ON true")
    by = f"GROUP BY {key}" if key else ""
    return f"""WITH e AS (SELECT {group} min({value}) AS lo, max({value}) AS hi FROM {source} {by}),
        b AS (SELECT {group} lo, hi, CASE WHEN hi = lo THEN 0 ELSE least(CAST(floor(({value} - lo)
              / ((hi - lo) / {bins})) AS BIGINT), {bins - 1}) END AS bin FROM {source} JOIN e {join})
        SELECT {group} CAST(bin AS INTEGER) AS bin, round(lo + bin * ((hi - lo) / {bins}), 9) AS "left",
               count(*) AS n FROM b GROUP BY {group} bin, lo, hi"""


def _rounded_left(df):
    return df.withColumn("left", F.round("left", 9))


@query("histogram", _histogram_sql("obs_sparse", "power", 20, "site"))
def _(spark, sf):
    return _rounded_left(explore.histogram(views.obs_sparse(spark, sf), "power", 20, ["site"]))


@query("histogram_wind", _histogram_sql("runs", "ws", 60))
def _(spark, sf):
    return _rounded_left(explore.histogram(views.runs(spark, sf), "ws", 60))


@query("histogram_orders", _histogram_sql("orders", "o_totalprice", 60, "o_orderstatus"))
def _(spark, sf):
    orders = views.table(spark, sf, "orders")
    return _rounded_left(explore.histogram(orders, "o_totalprice", 60, ["o_orderstatus"]))


@query(
    "cumulative_histogram",
    """WITH e AS (SELECT min(ws) - (max(ws) - min(ws)) / 48e0 AS low,
                         max(ws) + (max(ws) - min(ws)) / 48e0 AS high FROM runs),
            b AS (SELECT least(CAST(floor((ws - low) / ((high - low) / 25)) AS INTEGER), 24) AS bin
                  FROM runs, e),
            n AS (SELECT k.bin, count(b.bin) AS n
                  FROM (SELECT CAST(unnest(range(0, 25)) AS INTEGER) AS bin) k
                  LEFT JOIN b USING (bin) GROUP BY k.bin)
       SELECT bin, n, round(sum(n) OVER (ORDER BY bin) / CAST(sum(n) OVER () AS DOUBLE), 9) AS share
       FROM n""",
)
def _(spark, sf):
    table = explore.cumulative_histogram(views.runs(spark, sf), "ws", 25)
    return table.withColumn("share", F.round("share", 9))


_LAGS = range(1, 240)


@query(
    "lag_correlation",
    "WITH l AS (SELECT site, power, "
    + ", ".join(f"lag(power, {k}) OVER w AS lag_{k}" for k in _LAGS)
    + " FROM obs WINDOW w AS (PARTITION BY site ORDER BY date)), c AS (SELECT site, "
    + ", ".join(f"corr(power, lag_{k}) AS c_{k}" for k in _LAGS)
    + " FROM l GROUP BY site) SELECT site, unnest(range(1, 240)) AS lag, round(unnest(["
    + ", ".join(f"c_{k}" for k in _LAGS)
    + "]), 6) AS corr FROM c",
    by="kind",
)
def _(spark, sf):
    table = explore.lag_correlation(views.obs(spark, sf, "kind"), _LAGS)
    return table.select("site", F.col("lag").cast("bigint"), F.round("corr", 6).alias("corr"))


def _matrix_sql(source, columns):
    pairs = [(a, b) for a in columns for b in columns]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS corr FROM {source}"
        for a, b in pairs
    )


_SITES = [f"wp{k}" for k in range(1, 6)]


@query("site_correlation", _matrix_sql("obs_wide", _SITES), by="kind")
def _(spark, sf):
    matrix = explore.correlation_matrix(views.obs_wide(spark, sf), _SITES)
    return matrix.withColumn("corr", F.round("corr", 6))


_FEATURES = ("month", "week", "hour", "u", "v", "ws", "wd", "ws_2", "ws_3", "power")
_WITH_CALENDAR = """WITH f AS (SELECT month(date) AS month, weekofyear(date) AS week,
    hour(date) AS hour, u, v, ws, wd, ws * ws AS ws_2, ws * ws * ws AS ws_3, power FROM features)"""


@query(
    "feature_correlation",
    _WITH_CALENDAR
    + " SELECT x, y, round(corr, 6) AS corr FROM ("
    + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, CASE WHEN min({a}) = max({a}) OR min({b}) = max({b}) "
        f"THEN NULL ELSE corr({a}, {b}) END AS corr FROM f"
        for a in _FEATURES
        for b in _FEATURES
    )
    + ")",
)
def _(spark, sf):
    derived = {**calendar("date"), **powers_of("ws")}
    features = views.features(spark, sf).withColumns(derived)
    matrix = explore.correlation_matrix(features, list(_FEATURES))
    return matrix.withColumn("corr", F.round("corr", 6))


@query(
    "feature_correlation_lineitem",
    _matrix_sql("lineitem", ("l_quantity", "l_extendedprice", "l_discount", "l_tax")),
)
def _(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    matrix = explore.correlation_matrix(views.table(spark, sf, "lineitem"), columns)
    return matrix.withColumn("corr", F.round("corr", 6))


@query(
    "wind_rose",
    """WITH e AS (SELECT site, min(ws) AS lo, max(ws) AS hi, count(*) AS total FROM runs GROUP BY site),
            b AS (SELECT site, total,
              CAST(floor((wd + 1125e-2) / 225e-1) AS BIGINT) % 16 AS sector,
              least(CAST(floor((ws - lo) / ((hi - lo) / 6)) AS BIGINT), 5) AS speed_bin
              FROM runs JOIN e USING (site))
       SELECT site, CAST(sector AS INTEGER) AS sector, CAST(speed_bin AS INTEGER) AS speed_bin,
              count(*) AS n, round(100e0 * count(*) / any_value(total), 9) AS share
       FROM b GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    rose = explore.wind_rose(views.runs(spark, sf))
    return rose.withColumn("share", F.round("share", 9))


@query(
    "zero_scatter",
    """SELECT site, CASE WHEN power <> 0 THEN 'nonzero' ELSE 'zero' END AS label,
              CAST(floor(u) AS BIGINT) AS u_cell, CAST(floor(v) AS BIGINT) AS v_cell, count(*) AS n
       FROM features GROUP BY ALL""",
)
def _(spark, sf):
    return explore.zero_scatter(views.features(spark, sf))


@query(
    "power_curve",
    """SELECT site, CAST(floor(ws) AS INTEGER) AS ws_bin, count(*) AS n,
              round(avg(power), 11) AS mean,
              round(quantile_cont(power, 0.25), 9) AS q25, round(quantile_cont(power, 0.5), 9) AS q50,
              round(quantile_cont(power, 0.75), 9) AS q75
       FROM features GROUP BY 1, 2""",
)
def _(spark, sf):
    curve = explore.power_curve(views.features(spark, sf))
    return curve.select(
        "site", "ws_bin", "n", F.round("mean", 11).alias("mean"),
        *[F.round(c, 9).alias(c) for c in ("q25", "q50", "q75")],
    )


@query(
    "kde_2d",
    """WITH p AS (SELECT ws AS x, power AS y FROM features),
            m AS (SELECT count(*) AS n, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vxy,
                  min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
                  pow(count(*), -1e0 / 3e0) AS h2 FROM p),
            s AS (SELECT *, vx * vy - vxy * vxy AS det FROM m),
            w AS (SELECT x, y, count(*) AS w FROM p GROUP BY 1, 2),
            g AS (SELECT i, j FROM (SELECT CAST(unnest(range(0, 100)) AS INTEGER) AS i),
                                   (SELECT CAST(unnest(range(0, 100)) AS INTEGER) AS j))
       SELECT i, j, round(sum(w * exp(-5e-1 * (vy * dx * dx - 2 * vxy * dx * dy + vx * dy * dy)
                          / det / h2)) / any_value(2 * pi() * sqrt(det) * h2 * n), 6) AS density
       FROM (SELECT i, j, w, det, h2, n, vx, vy, vxy, x0 + i * ((x1 - x0) / 99e0) - x AS dx,
                    y0 + j * ((y1 - y0) / 99e0) - y AS dy FROM w, s, g)
       GROUP BY i, j""",
    by="kind",
)
def _(spark, sf):
    grid = explore.kde_grid(views.features(spark, sf, "kind"), "ws", "power", 100)
    return grid.withColumn("density", F.round("density", 6))


@query(
    "compare_slice",
    """WITH p AS (SELECT site, date, max_by(ws_power, start) AS wp, max(power) AS power
              FROM features WHERE NOT flag GROUP BY 1, 2)
       SELECT site, date, CAST(row_number() OVER (PARTITION BY site ORDER BY date) AS INTEGER) AS place,
              CASE WHEN wp < 0 THEN 0 WHEN wp >= 92e-2 THEN 92e-2 ELSE wp END AS wp, power
       FROM p QUALIFY place <= 480""",
)
def _(spark, sf):
    latest = (
        views.features(spark, sf)
        .filter(~F.col("flag"))
        .groupBy("site", "date")
        .agg(F.max_by("ws_power", "start").alias("wp"), F.max("power").alias("power"))
    )
    return explore.compare_slice(latest, "wp", 480)


@query(
    "normalised_series",
    """WITH near AS (SELECT site, date, ws, power FROM features WHERE catagory = 1),
            cut AS (SELECT n.* FROM near n JOIN (SELECT site, min(date) AS t FROM near GROUP BY site) f
                    ON f.site = n.site WHERE n.date <= f.t + INTERVAL 31 DAY),
            peak AS (SELECT site, max(ws) AS m FROM cut GROUP BY site)
       SELECT site, date, ws / m AS ws, power FROM cut JOIN peak USING (site)""",
)
def _(spark, sf):
    near = views.features(spark, sf).filter(F.col("catagory") == 1)
    return explore.normalised_series(near.select("site", "date", "ws", "power"), 31)


@query("x13_site_boxes", box_sql("obs", "site", "power"), by="kind")
def _(spark, sf):
    wide = views.obs_wide(spark, sf)
    long = joins.to_long(wide, "date", {f"wp{k}": k for k in range(1, 6)})
    return rounded_box(explore.box_stats(long, ["site"], "power"))


_TAGS = ("click", "error", "purchase", "signup", "view")


@query(
    "metric_log_pivot",
    "SELECT run, step, "
    + ", ".join(f"max(value) FILTER (tag = '{t}') AS \"{t}\"" for t in _TAGS)
    + " FROM metric_log GROUP BY run, step",
)
def _(spark, sf):
    return explore.metric_series(views.metric_log(spark, sf), _TAGS)

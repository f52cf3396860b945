"""Ordered-series operators, sorts and limits."""

from pyspark.sql import functions as F

from galeframe.operators import clean
from galeframe.operators import features as feat
from galeframe.operators import joins
from galeframe.operators import ordered as op
from galeframe.plans import views
from galeframe.plans.registry import query


@query(
    "first_run_per_date",
    """SELECT site, date, dist, start, ws FROM features
       QUALIFY row_number() OVER (PARTITION BY site, date ORDER BY dist DESC) = 1""",
)
def _(spark, sf):
    return joins.longest_lead(views.features(spark, sf), ["site", "date"], ["start", "ws"])


@query(
    "w2_last_per_key",
    """SELECT site, new_date, max(start) AS start, max_by(ws, start) AS ws
       FROM runs GROUP BY 1, 2""",
)
def _(spark, sf):
    return joins.latest_run(views.runs(spark, sf), ["ws"])


@query(
    "time_gaps",
    """SELECT site, date,
              datediff('hour', lag(date) OVER w, date) AS pre_gap,
              datediff('hour', lead(date) OVER w, date) AS next_gap
       FROM (SELECT site, date FROM obs WHERE power = 0)
       WINDOW w AS (PARTITION BY site ORDER BY date)""",
)
def _(spark, sf):
    zero = views.obs(spark, sf).filter(F.col("power") == 0).select("site", "date")
    return op.row_gaps(zero, ["site"], "date")


_LAGS = (1, 2, 3, 24, 48, 239, 240)


@query(
    "lag_columns",
    "SELECT site, date, power, "
    + ", ".join(f"lag(power, {k}) OVER w AS lag_{k}" for k in _LAGS)
    + " FROM obs WINDOW w AS (PARTITION BY site ORDER BY date)",
)
def _(spark, sf):
    obs = views.obs(spark, sf).select("site", "date", "power")
    return op.shifted(obs, ["site"], "date", "power", _LAGS)


_LINEAR = """
    numbered AS (SELECT site, date, power, row_number() OVER (PARTITION BY site ORDER BY date) AS p
                 FROM {source}),
    near AS (SELECT *,
        last_value(CASE WHEN power IS NOT NULL THEN p END IGNORE NULLS) OVER b AS p0,
        last_value(power IGNORE NULLS) OVER b AS x0,
        first_value(CASE WHEN power IS NOT NULL THEN p END IGNORE NULLS) OVER a AS p1,
        first_value(power IGNORE NULLS) OVER a AS x1
      FROM numbered
      WINDOW b AS (PARTITION BY site ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             a AS (PARTITION BY site ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT site, date, CASE WHEN power IS NOT NULL OR p0 IS NULL THEN power
                WHEN p1 IS NULL THEN x0
                ELSE x0 + (x1 - x0) * ((p - p0) / CAST(p1 - p0 AS DOUBLE)) END AS power
    FROM near"""


def linear_sql(source: str, before: str = "") -> str:
    return f"WITH {before} {_LINEAR.format(source=source)}"


_GAPPED = """gapped AS (SELECT g.site, g.date, s.power
                        FROM grid g LEFT JOIN obs_sparse s USING (site, date)),"""


def gapped(spark, sf):
    """The dense grid with NULL where nothing was measured."""
    grid = views.obs(spark, sf).select("site", "date")
    return grid.join(views.obs_sparse(spark, sf), ["site", "date"], "left")


@query("interpolate_linear", linear_sql("gapped", _GAPPED))
def _(spark, sf):
    return clean.fill_linear(gapped(spark, sf), "power")


@query("interpolate_cubic")
def _(spark, sf):
    return clean.fill_cubic(gapped(spark, sf), "power")


@query(
    "max_scale",
    """WITH peak AS (SELECT site, max(ws) AS m FROM runs GROUP BY site)
       SELECT site, start, dist, ws / m AS ws FROM runs JOIN peak USING (site)""",
)
def _(spark, sf):
    scaled = op.with_group_stats(views.runs(spark, sf), ["site"], _m=F.max("ws"))
    return scaled.select("site", "start", "dist", (F.col("ws") / F.col("_m")).alias("ws"))


@query(
    "gap_islands",
    """WITH numbered AS (SELECT site, date, power,
              row_number() OVER (PARTITION BY site ORDER BY date) - 1 AS rn FROM obs_sparse),
            runs_of AS (SELECT *, date - rn * INTERVAL 1 HOUR AS island FROM numbered)
       SELECT site, date, power, island,
              row_number() OVER (PARTITION BY site, island ORDER BY date) - 1 AS pos FROM runs_of""",
)
def _(spark, sf):
    return op.islands(views.obs_sparse(spark, sf), ["site"], "date")


@query(
    "w9_every_nth",
    """SELECT site, date, power, pos FROM (SELECT *, row_number() OVER (PARTITION BY site
            ORDER BY date) - 1 AS pos FROM obs_sparse) WHERE pos % 5 = 0""",
)
def _(spark, sf):
    return op.every_nth(views.obs_sparse(spark, sf), ["site"], "date", 5)


_NEIGHBOURS = ", ".join(
    f"lag(ws, {k}) OVER w AS ws_p{k}, lead(ws, {k}) OVER w AS ws_n{k}" for k in range(1, 7)
)


@query(
    "neighbour_features",
    f"""SELECT site, start, dist, ws, {_NEIGHBOURS} FROM runs
        WINDOW w AS (PARTITION BY site, start ORDER BY dist)""",
)
def _(spark, sf):
    runs = views.runs(spark, sf).select("site", "start", "dist", "ws")
    return feat.run_neighbours(runs, "ws")


def _rolling_sql(columns, widths):
    parts = []
    for w in widths:
        for c in columns:
            over = f"OVER (PARTITION BY site, start ORDER BY dist ROWS {w - 1} PRECEDING)"
            parts += [
                f"round(avg({c}) {over}, 11) AS ws{w}_{c}_mean",
                f"max({c}) {over} AS ws{w}_{c}_max",
                f"min({c}) {over} AS ws{w}_{c}_min",
            ]
    return f"SELECT site, start, dist, {', '.join(parts)} FROM runs"


@query("rolling_stats", _rolling_sql(("ws", "wd"), (2, 12, 48)))
def _(spark, sf):
    runs = views.runs(spark, sf).select("site", "start", "dist", "ws", "wd")
    rolled = feat.run_rolling(runs, ["ws", "wd"], [2, 12, 48]).drop("ws", "wd")
    return rolled.select(
        *[F.round(c, 11).alias(c) if c.endswith("_mean") else F.col(c) for c in rolled.columns]
    )


@query(
    "cross_site_features",
    "SELECT r.site, r.start, r.dist, r.ws, "
    + ", ".join(f"r{k}.ws AS ws_wp_{k}" for k in range(1, 6))
    + " FROM runs r "
    + " ".join(
        f"JOIN runs r{k} ON r{k}.site = {k} AND r{k}.start = r.start AND r{k}.new_date = r.new_date"
        for k in range(1, 6)
    ),
    by="kind",
)
def _(spark, sf):
    runs = views.runs(spark, sf, "kind").select("site", "start", "dist", "new_date", "ws")
    return feat.across_sites(runs, "ws", range(1, 6)).drop("new_date")


@query("o1_mixed_sort", "SELECT date, site, dist, ws FROM features")
def _(spark, sf):
    """Range-partitioned sort; only a sink needs one, windows carry their own order."""
    return op.mixed_sort(views.features(spark, sf).select("date", "site", "dist", "ws"))


@query(
    "limit_rows",
    """SELECT site, date FROM truth
       QUALIFY row_number() OVER (PARTITION BY site ORDER BY date) <= 20""",
)
def _(spark, sf):
    hours = views.truth(spark, sf).select("site", "date")
    return op.first_rows(hours, ["site"], [F.col("date")], 20).drop("rn")


@query(
    "o3_last_rows_before",
    """SELECT site, date, power FROM obs WHERE date < (SELECT min(date) FROM truth)
       QUALIFY row_number() OVER (PARTITION BY site ORDER BY date DESC) <= 36""",
)
def _(spark, sf):
    from galeframe.operators.filters import before_first

    earlier = before_first(views.obs(spark, sf), views.truth(spark, sf))
    return op.first_rows(
        earlier.select("site", "date", "power"), ["site"], [F.desc("date")], 36
    ).drop("rn")


_Q = [f"q{k}" for k in range(1, 100)]


def spread_quantiles(df, keys, array):
    return df.select(*keys, *[F.element_at(array, k).alias(f"q{k}") for k in range(1, 100)])


def _spread_sql(expression, source):
    columns = ", ".join(f"s[{k}] AS q{k}" for k in range(1, 100))
    return f"SELECT site, date, {columns} FROM (SELECT site, date, {expression} AS s FROM {source})"


@query("sort_quantiles", _spread_sql("list_sort(q)", "quantiles"))
def _(spark, sf):
    from galeframe.functions import monotone_quantiles

    q = views.quantiles(spark, sf).withColumn("q", monotone_quantiles("q"))
    return spread_quantiles(q, ["site", "date"], "q")


@query(
    "clamp_quantiles",
    _spread_sql("[greatest(0e0, least(1e0, x)) FOR x IN q]", "quantiles"),
)
def _(spark, sf):
    from galeframe.functions import bounded_quantiles

    q = views.quantiles(spark, sf).withColumn("q", bounded_quantiles("q"))
    return spread_quantiles(q, ["site", "date"], "q")


@query(
    "quantile_postprocess",
    _spread_sql(
        "CASE WHEN flag THEN q ELSE list_sort([greatest(0e0, least(1e0, x)) FOR x IN q]) END",
        "quantiles",
    ),
)
def _(spark, sf):
    from galeframe.operators.scoring import postprocess_quantiles

    return spread_quantiles(
        postprocess_quantiles(views.quantiles(spark, sf)), ["site", "date"], "q"
    )

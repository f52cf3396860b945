"""Joins and unions."""

from pyspark.sql import functions as F

from galeframe.functions import add_hours, hour_number
from galeframe.operators import features as feat
from galeframe.operators import joins as op
from galeframe.operators.metrics import score
from galeframe.operators.ordered import merged
from galeframe.plans import views
from galeframe.plans.registry import query
from galeframe.session import durable

KINDS = range(1, 6)


@query(
    "join_power_forecast",
    """SELECT o.site, o.date, o.power, r.start, r.dist, r.ws
       FROM obs o JOIN runs r ON r.site = o.site AND r.new_date = o.date WHERE o.flag""",
)
def _(spark, sf):
    train = views.obs(spark, sf).filter("flag")
    return op.join_power(train, views.runs(spark, sf)).select(
        "site", "date", "power", "start", "dist", "ws"
    )


_BLOCK = """
    numbered AS (SELECT site, date, row_number() OVER (PARTITION BY site ORDER BY date) AS rn
                 FROM truth),
    island AS (SELECT *, date - rn * INTERVAL 1 HOUR AS island FROM numbered),
    block AS (SELECT site, date, date - ((row_number() OVER (PARTITION BY site, island
                    ORDER BY date) - 1) % 48 + 1) * INTERVAL 1 HOUR AS start FROM island)"""


@query(
    "join_benchmark_run",
    f"""WITH {_BLOCK}
        SELECT b.site, b.date, b.start, r.dist, r.ws, r.wd
        FROM block b JOIN runs r ON r.site = b.site AND r.new_date = b.date AND r.start = b.start""",
)
def _(spark, sf):
    block = feat.block_positions(views.truth(spark, sf).select("site", "date")).drop("time")
    return op.join_block_run(block, views.runs(spark, sf)).select(
        "site", "date", "start", "dist", "ws", "wd"
    )


def _history_sql(use_future: bool) -> str:
    joins, columns = [], []
    for k in range(6):
        joins.append(
            f"LEFT JOIN known n{k} ON n{k}.site = r.site AND n{k}.date = r.start - INTERVAL {k} HOUR"
        )
        if use_future:
            joins.append(
                f"LEFT JOIN known p{k} ON p{k}.site = r.site "
                f"AND p{k}.date = r.start + INTERVAL {49 + k} HOUR"
            )
            columns.append(
                f"CASE WHEN r.dist >= 24 THEN coalesce(p{k}.power, n{k}.power) "
                f"ELSE n{k}.power END AS wp_hn_{k + 1}"
            )
        else:
            columns.append(f"n{k}.power AS wp_hn_{k + 1}")
    return f"""WITH known AS (SELECT site, date, power FROM obs WHERE flag)
        SELECT r.site, r.start, r.dist, {', '.join(columns)} FROM runs r {' '.join(joins)}"""


@query("lag_join_history", _history_sql(True))
def _(spark, sf):
    known = views.obs(spark, sf).filter("flag")
    runs = views.runs(spark, sf).select("site", "start", "dist")
    return op.power_history(runs, known)


@query("lag_join_history_past_only", _history_sql(False))
def _(spark, sf):
    known = views.obs(spark, sf).filter("flag")
    runs = views.runs(spark, sf).select("site", "start", "dist")
    return op.power_history(runs, known, use_future=False)


@query(
    "category_pivot_join",
    """WITH c AS (SELECT site, date, catagory, ws FROM features)
       SELECT c4.site, c4.date, c1.ws AS wind_power_1h, c2.ws AS wind_power_2h,
              c3.ws AS wind_power_3h, c4.ws AS wind_power_4h
       FROM (SELECT * FROM c WHERE catagory = 4) c4
       LEFT JOIN (SELECT * FROM c WHERE catagory = 3) c3 USING (site, date)
       LEFT JOIN (SELECT * FROM c WHERE catagory = 2) c2 USING (site, date)
       LEFT JOIN (SELECT * FROM c WHERE catagory = 1) c1 USING (site, date)""",
)
def _(spark, sf):
    return op.category_columns(views.features(spark, sf), "ws")


_SITE_JOIN = "SELECT s1.date, " + ", ".join(f"s{k}.power AS wp{k}" for k in KINDS) + (
    " FROM (SELECT * FROM obs_sparse WHERE site = 1) s1 "
    + " ".join(
        f"JOIN (SELECT * FROM obs_sparse WHERE site = {k}) s{k} USING (date)" for k in range(2, 6)
    )
)


@query("join_site_results", _SITE_JOIN, by="kind")
def _(spark, sf):
    sparse = views.obs_sparse(spark, sf, "kind")
    return op.to_wide(sparse, "date", "site", "power", KINDS, "wp", complete=True)


@query(
    "latest_forecast_asof",
    """SELECT site, new_date, start, ws, wd, u, v FROM runs
       QUALIFY row_number() OVER (PARTITION BY site, new_date ORDER BY start DESC) = 1""",
)
def _(spark, sf):
    return op.latest_run(views.runs(spark, sf))


@query(
    "recent_forecast_rows",
    """WITH latest AS (SELECT site, new_date, ws FROM runs
              QUALIFY row_number() OVER (PARTITION BY site, new_date ORDER BY start DESC) = 1),
            block AS (SELECT site, date AS t FROM truth
              WHERE (datediff('hour', TIMESTAMP '2024-01-01', date) - 1) % 168 = 120)
       SELECT b.site, b.t, l.new_date, l.ws
       FROM block b JOIN latest l ON l.site = b.site AND l.new_date < b.t
       QUALIFY row_number() OVER (PARTITION BY b.site, b.t ORDER BY l.new_date DESC) <= 36""",
)
def _(spark, sf):
    latest = op.latest_run(views.runs(spark, sf), ["ws"]).select("site", "new_date", "ws")
    blocks = (
        views.truth(spark, sf)
        .filter((hour_number("date") - 1) % 168 == 120)
        .select("site", F.col("date").alias("t"))
    )
    return op.recent_rows(blocks, "t", latest, "new_date", 36).select(
        "site", "t", "new_date", "ws"
    )


@query(
    "j7_run_at_time",
    """SELECT o.site, o.date, r.start AS issued, r.dist, r.ws
       FROM (SELECT site, date FROM obs WHERE flag) o
       JOIN runs r ON r.site = o.site AND r.start = o.date + INTERVAL 35 HOUR""",
)
def _(spark, sf):
    windows = (
        views.obs(spark, sf)
        .filter("flag")
        .select("site", "date", add_hours("date", 35).alias("issued"))
    )
    return op.run_issued_at(windows, "issued", views.runs(spark, sf)).select(
        "site", "date", "issued", "dist", "ws"
    )


@query(
    "write_back",
    """SELECT o.site, o.date, coalesce(p.ws_power, o.power) AS power
       FROM obs_masked o LEFT JOIN (SELECT site, date, max_by(ws_power, start) AS ws_power
            FROM features WHERE NOT flag GROUP BY 1, 2) p USING (site, date)""",
)
def _(spark, sf):
    predicted = (
        views.features(spark, sf)
        .filter(~F.col("flag"))
        .groupBy("site", "date")
        .agg(F.max_by("ws_power", "start").alias("power"))
    )
    masked = views.obs_masked(spark, sf).select("site", "date", "power")
    return op.write_back(masked, predicted, ["site", "date"], "power")


@query(
    "j9_prediction_vs_truth",
    """WITH p AS (SELECT site, date, max_by(ws_power, start) AS predicted
              FROM features GROUP BY 1, 2)
       SELECT site, date, power, predicted FROM truth JOIN p USING (site, date)""",
)
def _(spark, sf):
    predicted = (
        views.features(spark, sf)
        .groupBy("site", "date")
        .agg(F.max_by("ws_power", "start").alias("predicted"))
    )
    return views.truth(spark, sf).join(predicted, ["site", "date"])


@query(
    "j10_site_alignment",
    "SELECT r1.start, r1.new_date, "
    + ", ".join(f"r{k}.ws AS ws{k}" for k in KINDS)
    + " FROM (SELECT * FROM runs WHERE site = 1) r1 "
    + " ".join(
        f"JOIN (SELECT * FROM runs WHERE site = {k}) r{k} USING (start, new_date)"
        for k in range(2, 6)
    ),
    by="kind",
)
def _(spark, sf):
    runs = views.runs(spark, sf, "kind")
    return op.to_wide(runs, ["start", "new_date"], "site", "ws", KINDS, "ws", complete=True)


@query(
    "union_sites",
    """SELECT site, date, power, NULL::DOUBLE AS ws FROM obs_sparse
       UNION ALL SELECT site, new_date, NULL, ws FROM runs""",
)
def _(spark, sf):
    runs = views.runs(spark, sf).select("site", F.col("new_date").alias("date"), "ws")
    return op.union_rows(views.obs_sparse(spark, sf), runs)


@query(
    "u2_train_benchmark_union",
    """SELECT site, date, power, flag FROM obs WHERE flag
       UNION ALL SELECT site, date, NULL, false FROM truth""",
)
def _(spark, sf):
    train = views.obs(spark, sf).filter("flag")
    to_predict = (
        views.truth(spark, sf)
        .select(hour_number("date").alias("id"), "site", "date")
        .withColumn("power", F.lit(None).cast("double"))
        .withColumn("flag", F.lit(False))
    )
    return op.union_rows(train, to_predict.drop("id"))


@query(
    "extend_horizon",
    """WITH last AS (SELECT site, max(start) AS t FROM runs GROUP BY site)
       SELECT site, start, dist, new_date, ws FROM runs
       UNION ALL
       SELECT site, t + k * INTERVAL 12 HOUR, CAST(d AS INTEGER),
              t + (k * 12 + d) * INTERVAL 1 HOUR, NULL
       FROM last, (SELECT unnest(range(1, 4)) AS k), (SELECT unnest(range(1, 49)) AS d)""",
)
def _(spark, sf):
    return op.extend_horizon(views.runs(spark, sf)).select(
        "site", "start", "dist", "new_date", "ws"
    )


@query(
    "persistence_baseline",
    """WITH known AS (SELECT site, date, power FROM obs WHERE flag)
       SELECT i.site, i.start, k.power AS predicted
       FROM (SELECT DISTINCT site, start FROM runs) i
       ASOF LEFT JOIN known k ON k.site = i.site AND k.date <= i.start""",
)
def _(spark, sf):
    issues = views.runs(spark, sf).select("site", "start").distinct()
    return op.last_known(
        issues, "start", views.obs_masked(spark, sf), "date", "power", name="predicted"
    )


@query(
    "rmse_by_site",
    """WITH known AS (SELECT site, date, power FROM obs WHERE flag),
            issue AS (SELECT i.site, i.start, k.power AS predicted
              FROM (SELECT DISTINCT site, start FROM runs) i
              ASOF LEFT JOIN known k ON k.site = i.site AND k.date <= i.start)
       SELECT f.site, f.catagory, count(*) AS n,
              round(sqrt(avg((f.power - i.predicted) * (f.power - i.predicted))), 9) AS rmse
       FROM features f JOIN issue i USING (site, start) GROUP BY 1, 2""",
)
def _(spark, sf):
    """The minimum slice: runs, valid times, power join, as-of persistence, error per site
    and lead category."""
    features = views.features(spark, sf, together=True).select("site", "start", "catagory", "power")
    issues = durable(features.select("site", "start").distinct(), narrow=True)  # read three times
    predicted = op.last_known(
        issues, "start", views.obs_masked(spark, sf, together=True), "date", "power", name="predicted"
    )
    return score(
        merged(features, predicted, ["site", "start"]), "power", "predicted", ["site", "catagory"]
    ).select("site", "catagory", "n", F.round("rmse", 9).alias("rmse"))

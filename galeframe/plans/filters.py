"""Filters and audits over the canonical tables."""

from pyspark.sql import functions as F

from galeframe.operators import filters as op
from galeframe.operators.joins import extend_horizon
from galeframe.plans import views
from galeframe.plans.registry import query


@query(
    "warmup_filter",
    """WITH first AS (SELECT site, min(start) + INTERVAL 37 HOUR AS t FROM runs GROUP BY site)
       SELECT site, start, dist, new_date FROM runs JOIN first USING (site)
       WHERE new_date >= t""",
)
def _(spark, sf):
    runs = views.runs(spark, sf).select("site", "start", "dist", "new_date")
    return op.after_warmup(runs).select("site", "start", "dist", "new_date")


@query("drop_nulls", "SELECT site, start, dist, new_date, ws, wd FROM runs")
def _(spark, sf):
    runs = views.runs(spark, sf).select("site", "start", "dist", "new_date", "ws", "wd")
    return op.complete_rows(extend_horizon(runs))


@query(
    "power_threshold_filter",
    """SELECT site, start, date, power, ws FROM features
       WHERE power >= 5e-2 AND flag AND ws IS NOT NULL""",
)
def _(spark, sf):
    return op.trainable(views.features(spark, sf), 0.05).select(
        "site", "start", "date", "power", "ws"
    )


@query("f4_zero_output", "SELECT site, date, power FROM obs WHERE power = 0")
def _(spark, sf):
    return op.zero_output(views.obs(spark, sf)).select("site", "date", "power")


@query(
    "f5_before_cutoff",
    "SELECT site, date, power FROM obs WHERE date < (SELECT min(date) FROM truth)",
)
def _(spark, sf):
    return op.before_first(views.obs(spark, sf), views.truth(spark, sf)).select(
        "site", "date", "power"
    )


@query(
    "time_range",
    """WITH block AS (SELECT site, min(date) AS t0 FROM truth GROUP BY site)
       SELECT site, date, power FROM obs JOIN block USING (site)
       WHERE date > t0 - INTERVAL 36 HOUR AND date <= t0""",
)
def _(spark, sf):
    block = views.truth(spark, sf).groupBy("site").agg(F.min("date").alias("t0"))
    joined = views.obs(spark, sf).join(block, "site")
    return op.hours_up_to(joined, "t0", 36).select("site", "date", "power")


@query(
    "first_days",
    """WITH first AS (SELECT site, min(date) AS t FROM obs_sparse GROUP BY site)
       SELECT site, date, power FROM obs_sparse JOIN first USING (site)
       WHERE date <= t + INTERVAL 31 DAY""",
)
def _(spark, sf):
    return op.first_days(views.obs_sparse(spark, sf), 31)


@query(
    "f8_days_before_test",
    """SELECT site, date, power FROM obs WHERE flag
       AND date >= (SELECT min(date) FROM truth) - INTERVAL 31 DAY""",
)
def _(spark, sf):
    train = views.obs(spark, sf).filter("flag").select("site", "date", "power")
    return op.days_before_test(train, views.truth(spark, sf), 31)


@query("f9_first_category", "SELECT site, start, date, dist, ws FROM features WHERE catagory = 1")
def _(spark, sf):
    return (
        views.features(spark, sf)
        .filter(F.col("catagory") == 1)
        .select("site", "start", "date", "dist", "ws")
    )


@query("f10_to_predict", "SELECT site, date FROM obs WHERE NOT flag")
def _(spark, sf):
    return views.obs(spark, sf).filter(~F.col("flag")).select("site", "date")


@query(
    "null_audit",
    """SELECT 'power' AS "column", count(*) - count(power) AS nulls FROM obs_masked
       UNION ALL SELECT 'date', count(*) - count(date) FROM obs_masked""",
)
def _(spark, sf):
    return op.null_audit(views.obs_masked(spark, sf), ["power", "date"])

"""Aggregations."""

from pyspark.sql import functions as F

from galeframe.operators import explore, joins
from galeframe.operators import ordered as op
from galeframe.operators.clean import upper_cutoff
from galeframe.operators.scoring import mean_per_hour
from galeframe.plans import views
from galeframe.plans.registry import query


@query(
    "mean_by_date",
    """SELECT site, date, round(avg(ws_power), 9) AS power FROM features GROUP BY 1, 2""",
)
def _(spark, sf):
    predicted = views.features(spark, sf).select("site", "date", F.col("ws_power").alias("power"))
    return mean_per_hour(predicted).withColumn("power", F.round("power", 9))


_MEASURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "a2_min_max_scan",
    " UNION ALL ".join(
        f"SELECT '{c}' AS feature, min({c}) AS lo, max({c}) AS hi FROM lineitem" for c in _MEASURES
    ),
)
def _(spark, sf):
    return explore.ranges(views.table(spark, sf, "lineitem"), _MEASURES)


@query(
    "a3_sigma_cutoff",
    """SELECT c_custkey, c_acctbal,
         round((SELECT avg(c_acctbal) + 1.5e0 * stddev_samp(c_acctbal) FROM customer), 6) AS cutoff
       FROM customer""",
)
def _(spark, sf):
    customer = views.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return upper_cutoff(customer, "c_acctbal", 1.5).withColumn("cutoff", F.round("cutoff", 6))


@query(
    "zero_ratio",
    """SELECT site, round(count(*) FILTER (power = 0) / CAST(count(*) AS DOUBLE), 9) AS ratio
       FROM obs GROUP BY site""",
)
def _(spark, sf):
    return explore.zero_share(views.obs(spark, sf), ["site"]).withColumn(
        "ratio", F.round("ratio", 9)
    )


def describe_sql(source, key, value, digits=6):
    return f"""SELECT {key}, count({value}) AS n, round(avg({value}), {digits}) AS mean,
        round(stddev_samp({value}), {digits}) AS std, min({value}) AS min,
        round(quantile_cont({value}, 0.25), 9) AS q25,
        round(quantile_cont({value}, 0.5), 9) AS q50,
        round(quantile_cont({value}, 0.75), 9) AS q75, max({value}) AS max
        FROM {source} GROUP BY {key}"""


def rounded_describe(df, digits=6):
    digits = {"mean": digits, "std": digits, "q25": 9, "q50": 9, "q75": 9}
    return df.select(
        *[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns]
    )


@query("group_describe", describe_sql("lineitem", "l_returnflag", "l_extendedprice"))
def _(spark, sf):
    return rounded_describe(
        explore.describe(views.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    )


@query("group_describe_sites", describe_sql("obs_sparse", "site", "power", 10))
def _(spark, sf):
    return rounded_describe(explore.describe(views.obs_sparse(spark, sf), ["site"], "power"), 10)


@query(
    "group_head",
    """SELECT user_id, event_id, ts, value FROM events
       QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 10""",
)
def _(spark, sf):
    events = views.table(spark, sf, "events").select("user_id", "event_id", "ts", "value")
    return op.first_rows(events, ["user_id"], [F.col("ts"), F.col("event_id")], 10).drop("rn")


def box_sql(source, key, value):
    return f"""WITH q AS (SELECT {key}, quantile_cont({value}, 0.25) AS q1,
              quantile_cont({value}, 0.5) AS med, quantile_cont({value}, 0.75) AS q3
              FROM {source} GROUP BY {key})
        SELECT s.{key}, round(any_value(q1), 9) AS q1, round(any_value(med), 9) AS median,
               round(any_value(q3), 9) AS q3,
               min({value}) FILTER ({value} >= q1 - 15e-1 * (q3 - q1)) AS whisker_low,
               max({value}) FILTER ({value} <= q3 + 15e-1 * (q3 - q1)) AS whisker_high,
               count(*) FILTER ({value} < q1 - 15e-1 * (q3 - q1)
                                OR {value} > q3 + 15e-1 * (q3 - q1)) AS outliers
        FROM {source} s JOIN q ON q.{key} = s.{key} GROUP BY s.{key}"""


def rounded_box(df):
    return df.withColumns({c: F.round(c, 9) for c in ("q1", "median", "q3")})


@query("box_stats", box_sql("obs_sparse", "site", "power"))
def _(spark, sf):
    return rounded_box(explore.box_stats(views.obs_sparse(spark, sf), ["site"], "power"))


@query("box_stats_linestatus", box_sql("lineitem", "l_linestatus", "l_extendedprice"))
def _(spark, sf):
    return rounded_box(
        explore.box_stats(views.table(spark, sf, "lineitem"), ["l_linestatus"], "l_extendedprice")
    )


@query("a10_distinct_dates", "SELECT DISTINCT date FROM obs_sparse")
def _(spark, sf):
    return views.obs_sparse(spark, sf).select("date").distinct()


@query(
    "pivot_sites",
    "SELECT date, " + ", ".join(f"wp{k}" for k in range(1, 6)) + " FROM obs_wide",
    by="kind",
)
def _(spark, sf):
    return views.obs_wide(spark, sf)


@query("unpivot_sites", "SELECT date, site, power FROM obs", by="kind")
def _(spark, sf):
    return joins.to_long(
        views.obs_wide(spark, sf), "date", {f"wp{k}": k for k in range(1, 6)}
    )

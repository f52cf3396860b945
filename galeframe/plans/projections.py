"""Scalar projections over the canonical tables."""

from pyspark.sql import functions as F

from galeframe import functions as G
from galeframe.operators.features import block_positions
from galeframe.operators.models import unscale
from galeframe.plans import views
from galeframe.plans.registry import query


@query("p1_rename", "SELECT site, start AS wind_date, dist AS hors, new_date FROM runs")
def _(spark, sf):
    return views.runs(spark, sf).select(
        "site", F.col("start").alias("wind_date"), F.col("dist").alias("hors"), "new_date"
    )


@query("p2_select", "SELECT site, date, ws, wd, power FROM features")
def _(spark, sf):
    return views.features(spark, sf).select("site", "date", "ws", "wd", "power")


@query(
    "mask_targets",
    """SELECT date, CAST(NULL AS DOUBLE) AS wp1, CAST(NULL AS DOUBLE) AS wp2,
              CAST(NULL AS DOUBLE) AS wp3, CAST(NULL AS DOUBLE) AS wp4, CAST(NULL AS DOUBLE) AS wp5
       FROM obs_wide""",
    by="kind",
)
def _(spark, sf):
    wide = views.obs_wide(spark, sf)
    return wide.select("date", *[F.lit(None).cast("double").alias(f"wp{k}") for k in range(1, 6)])


@query("p4_constant_flag", "SELECT site, date, power, true AS flag FROM obs_sparse")
def _(spark, sf):
    return views.obs_sparse(spark, sf).withColumn("flag", F.lit(True))


@query("forecast_valid_time", "SELECT site, start, dist, new_date FROM runs")
def _(spark, sf):
    return views.runs(spark, sf).select(
        "site", "start", "dist", G.valid_time().alias("new_date")
    )


_CALENDAR = """SELECT o_orderkey, year(o_orderdate) AS year, month(o_orderdate) AS month,
    weekofyear(o_orderdate) AS week, hour(o_orderdate) AS hour, isodow(o_orderdate) - 1 AS weekday
    FROM orders"""


@query("calendar_features", f"SELECT o_orderkey, {', '.join(f'CAST({c} AS INTEGER) AS {c}' for c in ('year', 'month', 'week', 'hour', 'weekday'))} FROM ({_CALENDAR})")
def _(spark, sf):
    parts = G.calendar("o_orderdate", weekday=True)
    return views.table(spark, sf, "orders").select(
        "o_orderkey", *[c.alias(n) for n, c in parts.items()]
    )


@query("p7_turn", "SELECT site, start, dist, CAST(hour(start) AS INTEGER) AS turn FROM runs")
def _(spark, sf):
    return views.runs(spark, sf).select("site", "start", "dist", F.hour("start").alias("turn"))


@query(
    "wind_dir_bucket",
    """SELECT site, start, dist, floor(wd / 30) * 30 / 360e0 AS wd_cut_left,
              floor(wd / 30) * 30 AS wd_degrees FROM runs""",
)
def _(spark, sf):
    return views.runs(spark, sf).select(
        "site",
        "start",
        "dist",
        G.direction_bucket("wd").alias("wd_cut_left"),
        G.direction_bucket("wd", as_share=False).alias("wd_degrees"),
    )


@query("poly_features", "SELECT site, start, dist, ws * ws AS ws_2, ws * ws * ws AS ws_3 FROM runs")
def _(spark, sf):
    return views.runs(spark, sf).select(
        "site", "start", "dist", *[c.alias(n) for n, c in G.powers_of("ws").items()]
    )


@query(
    "polar_to_uv",
    """SELECT site, start, dist, round(ws * sin(radians(wd)), 6) AS u,
              round(ws * cos(radians(wd)), 6) AS v FROM runs""",
)
def _(spark, sf):
    uv = G.wind_components()
    return views.runs(spark, sf).select(
        "site", "start", "dist", *[F.round(c, 6).alias(n) for n, c in uv.items()]
    )


@query(
    "lead_category",
    "SELECT site, start, dist, CAST(ceil(dist / 12e0) AS INTEGER) AS catagory FROM runs",
)
def _(spark, sf):
    return views.runs(spark, sf).select("site", "start", "dist", G.lead_category().alias("catagory"))


@query(
    "block_position",
    """WITH numbered AS (
         SELECT site, date, row_number() OVER (PARTITION BY site ORDER BY date) AS rn FROM truth),
       runs_of AS (SELECT *, date - rn * INTERVAL 1 HOUR AS island FROM numbered),
       placed AS (SELECT site, date, CAST((row_number() OVER (PARTITION BY site, island
                         ORDER BY date) - 1) % 48 + 1 AS INTEGER) AS time FROM runs_of)
       SELECT site, date, time, date - time * INTERVAL 1 HOUR AS start FROM placed""",
)
def _(spark, sf):
    return block_positions(views.truth(spark, sf).select("site", "date"))


@query(
    "clamp_power",
    """SELECT c_custkey, CASE WHEN x < 0 THEN 0 WHEN x >= 92e-2 THEN 92e-2 ELSE x END AS power
       FROM (SELECT c_custkey, c_acctbal / 5000e0 AS x FROM customer)""",
)
def _(spark, sf):
    return views.table(spark, sf, "customer").select(
        "c_custkey", G.clamp(F.col("c_acctbal") / 5000.0).alias("power")
    )


@query(
    "binary_label",
    """SELECT site, date, CAST(CASE WHEN power IS NULL THEN NULL WHEN power < 1e-1 THEN 0 ELSE 1
              END AS INTEGER) AS label FROM obs_masked""",
)
def _(spark, sf):
    return views.obs_masked(spark, sf).select("site", "date", G.binary_label().alias("label"))


@query(
    "class_label",
    """SELECT site, date, CAST(round_even(50e0 * power, 0) AS INTEGER) AS label,
              CAST(round_even(49e0 * power, 0) AS INTEGER) AS label_within FROM obs_masked""",
)
def _(spark, sf):
    return views.obs_masked(spark, sf).select(
        "site",
        "date",
        G.class_label("power", 50).alias("label"),
        G.class_label("power", 50, within=True).alias("label_within"),
    )


@query(
    "one_hot_label",
    """WITH labelled AS (SELECT site, date,
              CAST(round_even(9e0 * power, 0) AS INTEGER) AS label FROM obs_sparse)
       SELECT site, date, k AS class, CAST(label = k AS INTEGER) AS hot
       FROM labelled, (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS k)""",
)
def _(spark, sf):
    label = G.class_label("power", 10, within=True)
    return (
        views.obs_sparse(spark, sf)
        .select("site", "date", label.alias("label"))
        .select("site", "date", F.posexplode(G.one_hot("label", 10)).alias("class", "hot"))
    )


@query(
    "class_decode",
    """SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS class,
              (list_position(embedding, list_max(embedding)) - 1) / 64e0 AS power
       FROM embeddings""",
)
def _(spark, sf):
    return views.table(spark, sf, "embeddings").select(
        "vec_id",
        G.decode_class("embedding").alias("class"),
        G.class_to_power(G.decode_class("embedding"), 64).alias("power"),
    )


@query("p18_probability_rounding", "SELECT site, date, round_even(power, 0) AS p FROM obs_sparse")
def _(spark, sf):
    return views.obs_sparse(spark, sf).select(
        "site", "date", G.round_probability("power").alias("p")
    )


@query(
    "inverse_scale",
    """WITH peak AS (SELECT site, max(power) AS y_max FROM obs_sparse GROUP BY site)
       SELECT site, start, dist, ws_power * y_max AS power
       FROM features JOIN peak USING (site)""",
)
def _(spark, sf):
    predicted = views.features(spark, sf).select("site", "start", "dist", "ws_power")
    return unscale(predicted, "ws_power", views.obs_sparse(spark, sf), "power").select(
        "site", "start", "dist", F.col("ws_power").alias("power")
    )


@query("p20_circle_to_degrees", "SELECT site, start, dist, wd / 360e0 * 360e0 AS wd FROM runs")
def _(spark, sf):
    return views.runs(spark, sf).select(
        "site", "start", "dist", G.circle_to_degrees(F.col("wd") / 360.0).alias("wd")
    )


@query(
    "coerce_numeric",
    """SELECT event_id, TRY_CAST(nullif(trim(t), '') AS DOUBLE) AS value
       FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN ' '
                    WHEN event_type = 'view' THEN event_type
                    ELSE ' ' || regexp_extract(props, '[0-9]+') || ' ' END AS t FROM events)""",
)
def _(spark, sf):
    text = (
        F.when(F.col("event_type") == "error", F.lit(" "))
        .when(F.col("event_type") == "view", F.col("event_type"))
        .otherwise(
            F.concat(F.lit(" "), F.regexp_extract("props", "[0-9]+", 0), F.lit(" "))
        )
    )
    return views.table(spark, sf, "events").select("event_id", G.to_number(text).alias("value"))


@query(
    "p22_reverse_vector",
    """SELECT vec_id, CAST(pos - 1 AS INTEGER) AS pos, CAST(x AS DOUBLE) AS x
       FROM (SELECT vec_id, unnest(list_reverse(embedding)) AS x,
                    generate_subscripts(embedding, 1) AS pos FROM embeddings)""",
)
def _(spark, sf):
    reversed_ = views.table(spark, sf, "embeddings").select(
        "vec_id", F.posexplode(G.reversed_vector("embedding")).alias("pos", "x")
    )
    return reversed_.withColumn("x", F.col("x").cast("double"))

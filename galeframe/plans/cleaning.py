"""Scaling, cleaning and outlier clusters."""

from pyspark.sql import functions as F

from galeframe.functions import calendar, direction_bucket, powers_of
from galeframe.operators import clean
from galeframe.plans import views
from galeframe.plans.registry import query
from galeframe.plans.series import gapped, linear_sql

_COLUMNS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_KEYS = ("l_orderkey", "l_linenumber")


def _lineitem(spark, sf):
    return views.table(spark, sf, "lineitem").select(*_KEYS, *_COLUMNS)


def _rounded(df, columns, digits=9):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query(
    "minmax_apply",
    """WITH s AS (SELECT min(power) AS lo, max(power) AS hi FROM obs WHERE flag)
       SELECT site, date, (power - lo) / (hi - lo) AS power FROM obs, s""",
)
def _(spark, sf):
    obs = views.obs(spark, sf)
    return clean.min_max_scale(obs, ["power"], fit=obs.filter("flag")).select(
        "site", "date", "power"
    )


_CAL = ("year", "month", "week", "hour")
_WIND = ("u", "v", "ws", "wd", "dist", "turn", "ws_2", "ws_3")


def _subset_sql():
    stats, scaled = [], []
    for c in (*_CAL, *_WIND):
        known = "FILTER (ws IS NOT NULL)" if c in _CAL else ""
        stats.append(f"min({c}) {known} AS lo_{c}, max({c}) {known} AS hi_{c}")
        scaled.append(
            f"({c} - lo_{c}) / (CASE WHEN hi_{c} = lo_{c} THEN 1e0 "
            f"ELSE CAST(hi_{c} - lo_{c} AS DOUBLE) END) AS {c}"
        )
    return f"""WITH x AS (SELECT site, date, start, year(date) AS year, month(date) AS month,
              weekofyear(date) AS week, hour(date) AS hour, u, v, ws, wd, dist,
              hour(start) AS turn, ws * ws AS ws_2, ws * ws * ws AS ws_3 FROM features),
            s AS (SELECT {', '.join(stats)} FROM x)
        SELECT site, date, start, {', '.join(scaled)} FROM x, s"""


@query("minmax_fit_subset", _subset_sql())
def _(spark, sf):
    derived = {**calendar("date"), "turn": F.hour("start"), **powers_of("ws")}
    features = (
        views.features(spark, sf)
        .withColumns(derived)
        .select("site", "date", "start", *_CAL, *_WIND)
    )
    return clean.scale_features(features, _CAL, _WIND)


@query(
    "standard_scale",
    f"""WITH s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}' for c in _COLUMNS)}
              FROM lineitem)
        SELECT l_orderkey, l_linenumber, {', '.join(f'round(({c} - m_{c}) / d_{c}, 9) AS {c}' for c in _COLUMNS)}
        FROM lineitem, s""",
)
def _(spark, sf):
    return _rounded(clean.standard_scale(_lineitem(spark, sf), _COLUMNS), _COLUMNS)


@query(
    "mean_range_scale",
    f"""WITH s AS (SELECT {', '.join(f'avg({c}) AS m_{c}, max({c}) - min({c}) AS r_{c}' for c in _COLUMNS)}
              FROM lineitem)
        SELECT l_orderkey, l_linenumber, {', '.join(f'round(({c} - m_{c}) / r_{c}, 9) AS {c}' for c in _COLUMNS)}
        FROM lineitem, s""",
)
def _(spark, sf):
    return _rounded(clean.mean_range_scale(_lineitem(spark, sf), _COLUMNS), _COLUMNS)


_SIGMA = """gapped AS (SELECT g.site, g.date, s.power
                       FROM grid g LEFT JOIN obs_sparse s USING (site, date)),
    cut AS (SELECT avg(power) + 3e0 * stddev_samp(power) AS cutoff FROM gapped),
    kept AS (SELECT site, date, CASE WHEN power > cutoff THEN NULL ELSE power END AS power
             FROM gapped, cut),"""


@query("clean_sigma", linear_sql("kept", _SIGMA))
def _(spark, sf):
    text = gapped(spark, sf).withColumn("power", F.col("power").cast("string"))
    return clean.clean_sigma(text, "power")

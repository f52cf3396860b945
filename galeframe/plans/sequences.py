"""Windows over the series."""

from pyspark.sql import functions as F

from galeframe.operators import joins
from galeframe.operators import sequences as op
from galeframe.plans import views
from galeframe.plans.registry import query

KINDS = range(1, 6)


def near(spark, sf, measured=True):
    """First-category rows: one per site and hour."""
    features = views.features(spark, sf).filter(F.col("catagory") == 1)
    return features.filter("flag") if measured else features


def base_sql(where="flag AND catagory = 1", keys="site"):
    return f"""base AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY date) - 1 AS i
               FROM features WHERE {where})"""


def windows_sql(length, stride, keys=("site",), need_next=True, source="base", name="win"):
    reach = length if need_next else length - 1
    same = " AND ".join(f"b.{k} = a.{k}" for k in keys)
    own = ", ".join(f"a.{k}" for k in keys)
    return f"""{name} AS (SELECT {own}, a.date AS window_start, a.i FROM {source} a
               JOIN {source} b ON {same} AND b.i = a.i + {reach}
                    AND b.date = a.date + INTERVAL {reach} HOUR
               WHERE a.i % {stride} = 0)"""


def step(expr):
    return f"CAST({expr} AS INTEGER) AS step"


@query(
    "window_index",
    f"""WITH base AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY date) - 1 AS i
             FROM obs WHERE flag), {windows_sql(84, 1)}
        SELECT site, window_start FROM win""",
)
def _(spark, sf):
    return op.window_starts(views.obs(spark, sf).filter("flag"))


@query(
    "window_index_gaps",
    f"""WITH base AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY date) - 1 AS i
             FROM obs_sparse), {windows_sql(3, 2)}
        SELECT site, window_start FROM win""",
    by="kind",
)
def _(spark, sf):
    return op.window_starts(views.obs_sparse(spark, sf, "kind"), 1, 2, stride=2)


def _lists_sql(**columns):
    return ", ".join(f"list({c} ORDER BY c.i) AS {name}" for name, c in columns.items())


def _lists(array, names):
    """The fields of an array of structs as arrays, so that a window stays one row."""
    return [F.col(array)[n].alias(n) for n in names]


@query(
    "window_tensor",
    f"""WITH {base_sql()}, {windows_sql(84, 1)}
        SELECT w.site, w.window_start, {_lists_sql(dist='c.dist', ws='c.ws', power='c.power')}
        FROM win w JOIN base c ON c.site = w.site AND c.i BETWEEN w.i AND w.i + 83 GROUP BY 1, 2""",
)
def _(spark, sf):
    cut = op.cut_windows(near(spark, sf), ["dist", "ws", "power"], 84)
    return cut.select("site", "window_start", *_lists("steps", ["dist", "ws", "power"]))


@query(
    "channel_swap",
    f"""WITH {base_sql()}, {windows_sql(84, 1)}
        SELECT w.site, w.window_start,
               {_lists_sql(dist='c.dist', ws='c.ws', power_in='CASE WHEN c.i - w.i < 36 THEN c.power ELSE c.ws_power END')},
               list(c.power ORDER BY c.i) FILTER (c.i - w.i >= 36) AS y
        FROM win w JOIN base c ON c.site = w.site AND c.i BETWEEN w.i AND w.i + 83 GROUP BY 1, 2""",
)
def _(spark, sf):
    cut = op.cut_windows(near(spark, sf), ["dist", "ws", "ws_power", "power"], 84)
    swapped = op.channel_swap(cut, ["dist", "ws"], 36, 48)
    return swapped.select("site", "window_start", *_lists("x", ["dist", "ws", "power_in"]), "y")


def _beside(windows, first):
    """x steps with the y of the same step, counted from ``first``."""
    rows = op.unrolled(windows, "x")
    y = F.when(F.col("step") >= first, F.get("y", F.col("step") - first))
    return rows.withColumn("y", y)


_GROUPED = f"""
    rows AS (SELECT site, catagory, date, max(dist) AS dist, max_by(ws, dist) AS ws,
             max_by(power, dist) AS power, max_by(ws_power, dist) AS ws_power,
             max_by(flag, dist) AS flag FROM features GROUP BY 1, 2, 3),
    base AS (SELECT *, row_number() OVER (PARTITION BY site, catagory ORDER BY date) - 1 AS i
             FROM rows WHERE flag),
    {windows_sql(84, 48, ('site', 'catagory'))},
    everything AS (SELECT *, row_number() OVER (PARTITION BY site, catagory ORDER BY date) - 1
             AS i FROM rows),
    anchors AS (SELECT site, catagory, date, i FROM (SELECT *, row_number() OVER (
             PARTITION BY site, catagory ORDER BY date) - 1 AS j FROM everything WHERE NOT flag)
             WHERE j % 48 = 0)"""


@query(
    "sequence_dataset",
    f"""WITH {_GROUPED}
        SELECT w.site, w.catagory, w.window_start, 'train' AS split, {step('c.i - w.i')},
               c.dist, c.ws, CASE WHEN c.i - w.i < 36 THEN c.power ELSE c.ws_power END AS power_in,
               CASE WHEN c.i - w.i >= 36 THEN c.power END AS y
        FROM win w JOIN base c ON c.site = w.site AND c.catagory = w.catagory
             AND c.i BETWEEN w.i AND w.i + 83
        UNION ALL
        SELECT a.site, a.catagory, a.date, 'test', CAST(c.i - a.i + 36 AS INTEGER), c.dist, c.ws,
               c.ws_power, CASE WHEN c.i >= a.i THEN c.power END
        FROM anchors a JOIN everything c ON c.site = a.site AND c.catagory = a.catagory
             AND c.i BETWEEN a.i - 36 AND a.i + 47
        WHERE a.i >= 36 AND a.i + 47 <= (SELECT max(e.i) FROM everything e
             WHERE e.site = a.site AND e.catagory = a.catagory)""",
)
def _(spark, sf):
    return _beside(
        op.sequence_dataset(views.features(spark, sf, together=True), ["dist", "ws"], stride=48), 36
    )


_LONGEST = f"""
    rows AS (SELECT site, date, max(dist) AS dist, max_by(ws, dist) AS ws,
             max_by(catagory, dist) AS catagory, max_by(power, dist) AS power,
             max_by(ws_power, dist) AS ws_power, max_by(flag, dist) AS flag
             FROM features GROUP BY 1, 2),
    base AS (SELECT *, row_number() OVER (PARTITION BY site, catagory ORDER BY date) - 1 AS i
             FROM rows WHERE flag),
    {windows_sql(84, 12, ('site', 'catagory'))}"""


@query(
    "category_windows",
    f"""WITH {_LONGEST}
        SELECT w.site, w.catagory, w.window_start,
               CASE WHEN ('0x' || substr(md5(w.site || '|' || w.catagory || '|' ||
                    strftime(w.window_start, '%Y-%m-%d %H:%M:%S') || '|0'), 1, 8))::BIGINT
                    / 4294967296e0 < 9e-1 THEN 'train' ELSE 'test' END AS split,
               {step('c.i - w.i')}, c.dist, c.ws,
               CASE WHEN c.i - w.i < 36 THEN c.power ELSE c.ws_power END AS power_in,
               CASE WHEN c.i - w.i >= 36 THEN c.power END AS y
        FROM win w JOIN base c ON c.site = w.site AND c.catagory = w.catagory
             AND c.i BETWEEN w.i AND w.i + 83""",
)
def _(spark, sf):
    from galeframe.operators.splits import hash_split

    train, _ = op.category_windows(views.features(spark, sf), ["dist", "ws"], stride=12)
    return _beside(hash_split(train, ["site", "catagory", "window_start"]), 36)


@query(
    "category_prediction_windows",
    """WITH rows AS (SELECT site, date, max(dist) AS dist, max_by(ws, dist) AS ws,
             max_by(flag, dist) AS flag FROM features GROUP BY 1, 2),
       everything AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY date) - 1 AS i
             FROM rows),
       anchors AS (SELECT site, date, i FROM (SELECT *, row_number() OVER (PARTITION BY site
             ORDER BY date) - 1 AS j FROM everything WHERE NOT flag) WHERE j % 48 = 0)
       SELECT a.site, a.date AS window_start, CAST(c.i - a.i + 36 AS INTEGER) AS step, c.dist, c.ws
       FROM anchors a JOIN everything c ON c.site = a.site AND c.i BETWEEN a.i - 36 AND a.i - 1
       WHERE a.i >= 36""",
)
def _(spark, sf):
    _, predict = op.category_windows(views.features(spark, sf), ["dist", "ws"], stride=12)
    return op.unrolled(predict)


_WIND4 = [f"wind_power_{k}h" for k in range(1, 5)]


@query(
    "category_pair_windows",
    f"""WITH pivoted AS (
          SELECT site, date, {', '.join(f'max(ws) FILTER (catagory = {k}) AS wind_power_{k}h' for k in range(1, 5))},
                 any_value(power) AS power
          FROM features WHERE flag GROUP BY site, date HAVING bool_or(catagory = 4)),
        base AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY date) - 1 AS i
                 FROM pivoted), {windows_sql(96, 12)}
        SELECT w.site, w.window_start, {step('c.i - w.i - 48')}, {', '.join('c.' + c for c in _WIND4)},
               p.power AS power_in, c.power AS y
        FROM win w JOIN base c ON c.site = w.site AND c.i BETWEEN w.i + 48 AND w.i + 95
        JOIN base p ON p.site = w.site AND p.i = c.i - 48""",
)
def _(spark, sf):
    measured = views.features(spark, sf).filter("flag")
    power = views.obs(spark, sf).select("site", "date", "power")
    pivoted = joins.category_columns(measured, "ws").join(power, ["site", "date"])
    return _beside(op.category_pair_windows(pivoted, _WIND4).drop("steps"), 0)


_HISTORY = f"""
    {base_sql('catagory = 1')}, {windows_sql(84, 12)},
    run_win AS (SELECT w.*, w.window_start + INTERVAL 35 HOUR AS issued FROM win w
                WHERE EXISTS (SELECT 1 FROM features f WHERE f.site = w.site
                              AND f.start = w.window_start + INTERVAL 35 HOUR))"""


@query(
    "history_plus_run",
    f"""WITH {_HISTORY}
        SELECT w.site, w.window_start, {step('c.i - w.i')}, c.dist, c.u, c.v, c.ws
        FROM run_win w JOIN base c ON c.site = w.site AND c.i BETWEEN w.i AND w.i + 35
        UNION ALL
        SELECT w.site, w.window_start, CAST(35 + f.dist AS INTEGER), f.dist, f.u, f.v, f.ws
        FROM run_win w JOIN features f ON f.site = w.site AND f.start = w.issued""",
)
def _(spark, sf):
    cut = op.history_plus_run(views.features(spark, sf, together=True), ["dist", "u", "v", "ws"], "ws")
    return op.unrolled(cut.drop("y"))


@query(
    "history_plus_run_targets",
    f"""WITH {_HISTORY}
        SELECT w.site, w.window_start, {step('c.i - w.i - 48')}, c.ws AS y
        FROM run_win w JOIN base c ON c.site = w.site AND c.i BETWEEN w.i + 48 AND w.i + 83""",
)
def _(spark, sf):
    cut = op.history_plus_run(views.features(spark, sf, together=True), ["dist", "ws"], "ws")
    return cut.select("site", "window_start", F.posexplode_outer("y").alias("step", "y"))


def halfway(history="_history", run="_run", n=36):
    """A plain model for ``predict_and_update``: half the history mean, half the run."""
    mean = F.aggregate(history, F.lit(0.0), lambda a, x: a + x) / F.lit(float(n))
    return F.transform(
        F.slice(run, 13, n), lambda x: F.lit(0.5) * mean + F.lit(0.5) * x
    )


@query(
    "update_features",
    """WITH open AS (SELECT DISTINCT site, date - INTERVAL 36 HOUR AS t0 FROM (
              SELECT site, date, row_number() OVER (PARTITION BY site ORDER BY start, dist) - 1 AS n
              FROM features WHERE NOT flag) WHERE n % 192 = 0),
            past AS (SELECT o.site, o.t0, avg(f.ws) AS m FROM open o JOIN features f
              ON f.site = o.site AND f.catagory = 1 AND f.date >= o.t0
                 AND f.date < o.t0 + INTERVAL 36 HOUR GROUP BY 1, 2 HAVING count(*) = 36),
            predicted AS (SELECT p.site, p.t0, f.date, 5e-1 * p.m + 5e-1 * f.ws AS ws
              FROM past p JOIN features f ON f.site = p.site AND f.start = p.t0 + INTERVAL 35 HOUR
                   AND f.dist BETWEEN 13 AND 48),
            final AS (SELECT site, date, max_by(ws, t0) AS ws FROM predicted GROUP BY 1, 2),
            updated AS (SELECT f.site, f.date, f.start, f.wd,
              CASE WHEN f.catagory = 1 THEN coalesce(p.ws, f.ws) ELSE f.ws END AS ws
              FROM features f LEFT JOIN final p ON p.site = f.site AND p.date = f.date)
       SELECT site, date, start, round(ws, 10) AS ws, floor(wd / 30) * 30 AS wd_cut_left,
              round(ws * ws, 6) AS ws_2, round(ws * sin(radians(wd)), 6) AS u,
              round(ws * cos(radians(wd)), 6) AS v
       FROM updated""",
)
def _(spark, sf):
    updated = op.predict_and_update(views.features(spark, sf), halfway(), "ws")
    return updated.select(
        "site", "date", "start", F.round("ws", 10).alias("ws"), "wd_cut_left",
        *[F.round(c, 6).alias(c) for c in ("ws_2", "u", "v")],
    )


_SLIDE = 6


@query(
    "lagged_slide",
    f"""WITH {base_sql()}, {windows_sql(_SLIDE + 1, 1, need_next=False)}
        SELECT w.site, w.window_start,
               {', '.join(f'max(c.ws) FILTER (c.i = w.i + {k + 1}) AS ws_{k}, max(c.power) FILTER (c.i = w.i + {k}) AS prev_{k}' for k in range(_SLIDE))},
               max(c.power) FILTER (c.i = w.i + {_SLIDE}) AS y
        FROM win w JOIN base c ON c.site = w.site AND c.i BETWEEN w.i AND w.i + {_SLIDE}
        GROUP BY w.site, w.window_start""",
)
def _(spark, sf):
    cut = op.cut_windows(near(spark, sf), ["ws", "power"], _SLIDE + 1, need_next=False)
    slid = op.lagged_slide(cut, ["ws"], ["power"], _SLIDE)
    fields = []
    for k in range(_SLIDE):
        fields += [
            F.get("x", F.lit(k))["ws"].alias(f"ws_{k}"),
            F.get("x", F.lit(k))["prev_power"].alias(f"prev_{k}"),
        ]
    return slid.select("site", "window_start", *fields, "y")


def _pair_sql(history, horizon, reverse=False):
    if reverse:
        wind = 0 if history > horizon else horizon - history
        power, first = horizon, 0
    else:
        wind, power, first = (horizon if history > horizon else history), 0, history
    return f"""
        SELECT '{history}-{horizon}' AS shape, w.site, w.window_start, {step(f'c.i - w.i - {wind}')},
               c.dist, c.ws, p.power AS power_in, CASE WHEN c.i - w.i - {wind} < {horizon}
               THEN y.power END AS y
        FROM win w JOIN base c ON c.site = w.site
             AND c.i BETWEEN w.i + {wind} AND w.i + {wind + history - 1}
        JOIN base p ON p.site = w.site AND p.i = c.i + {power - wind}
        LEFT JOIN base y ON y.site = w.site AND y.i = c.i + {first - wind}"""


def _pairs(spark, sf, pair):
    cut = op.cut_windows(near(spark, sf), ["dist", "ws", "power"], 84, 24)
    out = None
    for history, horizon in ((36, 48), (48, 36)):
        rows = _beside(pair(cut, ["dist", "ws"], history, horizon).drop("steps"), 0)
        rows = rows.withColumn("shape", F.lit(f"{history}-{horizon}"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "offset_pair",
    f"WITH {base_sql()}, {windows_sql(84, 24)} {_pair_sql(36, 48)} UNION ALL {_pair_sql(48, 36)}",
)
def _(spark, sf):
    return _pairs(spark, sf, op.offset_pair)


@query(
    "reverse_pair",
    f"""WITH {base_sql()}, {windows_sql(84, 24)} {_pair_sql(36, 48, True)}
        UNION ALL {_pair_sql(48, 36, True)}""",
)
def _(spark, sf):
    return _pairs(spark, sf, op.reverse_pair)


_WEATHER = ("u", "v", "ws", "wd")
_WP = [f"wp{k}" for k in KINDS]
_RECENT = f"""
    hours AS (SELECT date AS window_start, CAST(unnest(range(1, 97)) AS INTEGER) AS step
              FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM obs_wide)
              WHERE i % 48 = 0),
    latest AS (SELECT * FROM runs
               QUALIFY row_number() OVER (PARTITION BY site, new_date ORDER BY start DESC) = 1),
    known AS (SELECT h.*, o.* FROM hours h
              JOIN obs_wide o ON o.date = h.window_start + h.step * INTERVAL 1 HOUR),
    recent AS (
      SELECT l.site, k.*, {', '.join('l.' + c for c in _WEATHER)} FROM known k
      JOIN latest l ON l.new_date = k.date WHERE k.step <= 48
      UNION ALL
      SELECT r.site, k.*, {', '.join('r.' + c for c in _WEATHER)} FROM known k
      JOIN runs r ON r.new_date = k.date AND r.start = k.window_start + INTERVAL 48 HOUR
      WHERE k.step > 48)"""


def _recent(spark, sf):
    runs = views.runs(spark, sf, "kind")
    return op.recent_and_issued(
        views.obs_wide(spark, sf), joins.latest_run(runs, _WEATHER), runs, _WEATHER, KINDS,
        stride=48,
    )


@query(
    "recent_and_issued",
    f"""WITH {_RECENT}
        SELECT site, window_start, step, date, CAST(year(date) AS INTEGER) AS year,
               CAST(month(date) AS INTEGER) AS month, CAST(hour(date) AS INTEGER) AS hour,
               {', '.join(_WEATHER)}, {', '.join(_WP)} FROM recent""",
    by="kind",
)
def _(spark, sf):
    return _recent(spark, sf)


@query(
    "issued_single",
    f"""WITH {_RECENT}
        SELECT a.site, a.window_start, a.step, CAST(year(a.date) AS INTEGER) AS year,
               CAST(month(a.date) AS INTEGER) AS month, CAST(hour(a.date) AS INTEGER) AS hour,
               {', '.join('a.' + c for c in _WP)}, {', '.join('b.' + c for c in _WEATHER)},
               {', '.join(f'b.{c} AS y_{c}' for c in _WP)}
        FROM recent a JOIN recent b ON b.site = a.site AND b.window_start = a.window_start
             AND b.step = a.step + 48 WHERE a.step <= 48""",
    by="kind",
)
def _(spark, sf):
    return op.issued_single(_recent(spark, sf), _WEATHER, _WP)


@query(
    "window_consistency",
    f"""WITH base AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY date) - 1 AS i
             FROM obs WHERE flag), {windows_sql(84, 12, need_next=False)}
        SELECT site, count(*) * 84 AS n, 0e0 AS rmse FROM win GROUP BY site""",
)
def _(spark, sf):
    return op.window_consistency(views.obs(spark, sf).filter("flag"), "power", 84)


_OBJECTIVE = f"""
    {base_sql()}, {windows_sql(84, 12)},
    combined AS (
      SELECT w.site, w.window_start, c.i - w.i AS k, c.dist, c.ws, c.power
      FROM win w JOIN base c ON c.site = w.site AND c.i BETWEEN w.i AND w.i + 35
      UNION ALL
      SELECT w.site, w.window_start, 35 + f.dist, f.dist, f.ws, f.power
      FROM win w JOIN features f ON f.site = w.site AND f.start = w.window_start - INTERVAL 1 HOUR),
    whole AS (SELECT site, window_start, max(k) AS top FROM combined GROUP BY 1, 2
              HAVING max(k) > 35)"""


@query(
    "objective_windows",
    f"""WITH {_OBJECTIVE}
        SELECT c.site, c.window_start, {step('c.k - 36')}, c.dist, c.ws, p.power AS power_in,
               c.power AS y
        FROM combined c JOIN whole USING (site, window_start)
        JOIN combined p ON p.site = c.site AND p.window_start = c.window_start AND p.k = c.k - 36
        WHERE c.k BETWEEN 36 AND 71""",
)
def _(spark, sf):
    cut = op.objective_windows(views.features(spark, sf), ["dist", "ws"], stride=12)
    return _beside(cut, 0)


def _one_step_sql(label):
    return f"""WITH {_OBJECTIVE}
        SELECT t.site, t.window_start, CAST(t.k - 36 AS INTEGER) AS slide, {label} AS y,
               sum(f.ws) AS ws_sum, sum(f.prev) AS prev_sum
        FROM (SELECT c.* FROM combined c JOIN whole USING (site, window_start) WHERE c.k >= 36) t
        JOIN (SELECT a.site, a.window_start, a.k, a.ws, b.power AS prev FROM combined a
              JOIN combined b ON b.site = a.site AND b.window_start = a.window_start
                   AND b.k = a.k - 1) f
          ON f.site = t.site AND f.window_start = t.window_start AND f.k BETWEEN t.k - 35 AND t.k
        GROUP BY t.site, t.window_start, t.k, t.power"""


def _one_step(spark, sf, objective, stride):
    slid = op.objective_windows(
        views.features(spark, sf, together=True), ["dist", "ws"], objective, stride=stride, classes=10
    )

    def total(field):
        return F.aggregate("x", F.lit(0.0), lambda a, r: a + r[field])

    return slid.select(
        "site", "window_start", "slide", "y",
        F.round(total("ws"), 6).alias("ws_sum"), F.round(total("prev_power"), 6).alias("prev_sum"),
    )


def _rounded_sql(text, stride):
    return text.replace("sum(f.ws)", "round(sum(f.ws), 6)").replace(
        "sum(f.prev)", "round(sum(f.prev), 6)"
    ).replace("% 12 = 0", f"% {stride} = 0")


@query(
    "objective_windows_binary",
    _rounded_sql(_one_step_sql("CAST(t.power >= 1e-1 AS INTEGER)"), 48),
)
def _(spark, sf):
    return _one_step(spark, sf, "binary", stride=48)


@query(
    "objective_windows_category",
    _rounded_sql(_one_step_sql("CAST(round_even(9e0 * t.power, 0) AS INTEGER)"), 1),
)
def _(spark, sf):
    rows = _one_step(spark, sf, "category", stride=1)
    return rows.withColumn("y", (F.array_position("y", 1) - 1).cast("int"))


@query(
    "flatten_window",
    f"""WITH {base_sql()}, {windows_sql(84, 48)}
        SELECT w.site, w.window_start, CAST(2 * (c.i - w.i) + f AS INTEGER) AS pos,
               CASE f WHEN 0 THEN c.ws ELSE c.power END AS x
        FROM win w JOIN base c ON c.site = w.site AND c.i BETWEEN w.i AND w.i + 83,
             (SELECT unnest([0, 1]) AS f)""",
)
def _(spark, sf):
    from galeframe.functions import flat_window

    cut = op.cut_windows(near(spark, sf), ["ws", "power"], 84, 48)
    matrix = F.transform("steps", lambda r: F.array(r["ws"], r["power"]))
    return cut.select("site", "window_start", F.posexplode_outer(flat_window(matrix)).alias("pos", "x"))

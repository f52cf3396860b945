"""Outlier models, trained models and recursive forecasts."""

from pyspark.sql import functions as F

from galeframe.functions import binary_label, class_label, class_to_power, decode_class, hour_number
from galeframe.operators import joins, metrics, models, networks, outliers, recursion, splits, trees
from galeframe.operators.sequences import channel_swap, cut_windows
from galeframe.plans import views
from galeframe.plans.registry import query
from galeframe.session import durable

FEATURES = ["site", "dist", "hour", "u", "v", "ws", "wd"]


def near(spark, sf, by="user"):
    return views.features(spark, sf, by).filter(F.col("catagory") == 1)


def zero_rows(spark, sf, by="user"):
    return near(spark, sf, by).filter(F.col("power") == 0).select("site", "date", "u", "v")


@query("kmeans_outliers")
def _(spark, sf):
    return outliers.kmeans_outliers(zero_rows(spark, sf), clusters=100, min_sample=40)


@query("a4_cluster_counts")
def _(spark, sf):
    marked = outliers.kmeans_outliers(zero_rows(spark, sf, "kind"), clusters=50, min_sample=20)
    return marked.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("denoise_power")
def _(spark, sf):
    rows = near(spark, sf, "kind").select("site", "date", "u", "v", "power")
    return outliers.denoise_power(rows, clusters=100, min_sample=40)


@query("kmeans_elbow")
def _(spark, sf):
    return outliers.kmeans_elbow(zero_rows(spark, sf))


@query("x7_abnormal_scatter")
def _(spark, sf):
    from galeframe.operators.explore import zero_scatter

    rows = near(spark, sf, "kind").select("site", "date", "u", "v", "power")
    marked = outliers.kmeans_outliers(
        rows.filter(F.col("power") == 0), clusters=100, min_sample=40
    ).select("site", "date", "cluster")
    return zero_scatter(rows.join(marked, ["site", "date"], "left"))


@query("dbscan")
def _(spark, sf):
    return outliers.density_clusters(zero_rows(spark, sf), eps=0.02, min_samples=5)


@query(
    "dbscan_core_points",
    """WITH z AS (SELECT site, date, u, v FROM features WHERE catagory = 1 AND power = 0),
            p AS (SELECT u, v, count(*) AS w FROM z GROUP BY 1, 2),
            n AS (SELECT a.u, a.v, sum(b.w) AS near FROM p a JOIN p b
                  ON (a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v) <= 2e-2 * 2e-2
                  GROUP BY 1, 2)
       SELECT site, date, near >= 5 AS core FROM z JOIN n USING (u, v)""",
)
def _(spark, sf):
    marked = outliers.density_clusters(zero_rows(spark, sf), eps=0.02, min_samples=5)
    return marked.select("site", "date", "core")


@query("isolation_forest")
def _(spark, sf):
    return outliers.isolation_forest(zero_rows(spark, sf), ["site", "date"])


def training_rows(spark, sf):
    rows = views.features(spark, sf).withColumn("hour", F.hour("date"))
    return splits.hash_split(rows, ["site", "date"], 0.9)


def _split(rows):
    return rows.filter("flag AND split = 'train'"), rows.filter("flag AND split = 'test'")


# Numbers of leaves that the seven farms of the definition have, for output and gate; sites take turns.
REGRESSION_LEAVES = (20, 50, 20, 50, 50, 50, 50)
GATE_LEAVES = (100, 100, 1000, 100, 200, 100, 100)


def own_leaves(counts):
    return F.element_at(F.lit(list(counts)), F.pmod(F.col("site") - 1, F.lit(len(counts))) + 1)


OWN_FEATURES = FEATURES[1:]
REGRESSION = trees.Boosting(trees=20)
GATE = trees.Boosting(trees=10, logistic=True)


def _regressed(train, test):
    model = trees.fit_trees(train, OWN_FEATURES, "power", own_leaves(REGRESSION_LEAVES), REGRESSION)
    return trees.score_trees(test, model, OWN_FEATURES, REGRESSION)


@query("gbt_regress")
def _(spark, sf):
    scored = metrics.score(_regressed(*_split(training_rows(spark, sf))), "power", "predicted", ["site"])
    return scored.select("site", "n", "rmse")


@query("gbt_gate")
def _(spark, sf):
    train, test = _split(training_rows(spark, sf))
    labelled = train.withColumn("above", binary_label("power", 0.1).cast("double"))
    gate = trees.fit_trees(labelled, OWN_FEATURES, "above", own_leaves(GATE_LEAVES), GATE)
    scored = trees.score_trees(_regressed(train, test), gate, OWN_FEATURES, GATE, name="gate_probability")
    passed = (F.col("gate_probability") >= 0.5).cast("int")
    return scored.select(
        "site", "date", "start", "power", (F.col("predicted") * passed).alias("predicted"), passed.alias("gate"), "gate_probability"
    )


@query("param_sweep")
def _(spark, sf):
    train, _ = _split(training_rows(spark, sf))
    return models.sweep_leaves(train, FEATURES, [4, 8, 10, 16], trees=3)


@query("feature_importance")
def _(spark, sf):
    train, _ = _split(training_rows(spark, sf))
    return models.importance(train, FEATURES, ["site", "start", "dist"], trees=3)


@query("rank_importance")
def _(spark, sf):
    train, _ = _split(training_rows(spark, sf))
    ranked = models.importance(train, ["dist", "ws", "wd"], ["site", "start", "dist"], folds=1 + 1, trees=2)
    return ranked.filter(F.col("place") <= 3)


@query(
    "per_site_apply",
    """WITH m AS (SELECT site, regr_slope(power, ws) AS b, regr_intercept(power, ws) AS a
              FROM features WHERE flag GROUP BY site)
       SELECT f.site, f.date, f.start, round(m.a + m.b * f.ws, 6) AS predicted
       FROM features f JOIN m USING (site) WHERE NOT f.flag""",
)
def _(spark, sf):
    rows = views.features(spark, sf)
    fitted = models.fit_linear_by_site(rows.filter("flag"), ["ws"])
    scored = models.score_linear(rows.filter(~F.col("flag")), fitted, ["ws"])
    return scored.select("site", "date", "start", F.round("predicted", 6).alias("predicted"))


#: Classes of output of the classifying base, folds of the first level, bases of the second.
CLASSES, FOLDS = 10, 5
BASES = ("linear", "classed", "persistence")


def solve_sql(source: str, n: int, name: str) -> str:
    """Common tables that eliminate the augmented system ``m0_0 .. m{n-1}_{n}`` of ``source`` to x0 .. x{n-1}."""
    tables, last = [], source
    for k in range(n - 1):
        cells = [
            f"m{i}_{j}" if i <= k else f"m{i}_{j} - m{i}_{k} * m{k}_{j} / m{k}_{k} AS m{i}_{j}"
            for i in range(n) for j in range(min(i, k) if i <= k else k + 1, n + 1)
        ]
        tables.append(f"{name}{k} AS (SELECT {', '.join(cells)} FROM {last})")
        last = f"{name}{k}"
    for i in reversed(range(n)):
        rest = "".join(f" - m{i}_{j} * x{j}" for j in range(i + 1, n))
        tables.append(f"{name}x{i} AS (SELECT *, (m{i}_{n}{rest}) / m{i}_{i} AS x{i} FROM {last})")
        last = f"{name}x{i}"
    return ", ".join(tables) + f", {name} AS (SELECT * FROM {last})"


def _stack_sql():
    share = "('0x' || substr(md5(site || '|' || strftime(date, '%Y-%m-%d %H:%M:%S') || '|' || strftime(start, '%Y-%m-%d %H:%M:%S') || '|0'), 1, 8))::BIGINT / 4294967296e0"
    labels = ["power", *[f"c{k}" for k in range(CLASSES + 1)]]
    own = ", ".join(f"sum({c}) AS s_{c}, sum(ws * {c}) AS p_{c}" for c in labels)
    sums = ["n", "sx", "sxx", *[f"{q}_{c}" for c in labels for q in "sp"]]
    rest = ", ".join(f"sum({c}) OVER (PARTITION BY site) - {c} AS {c}" for c in sums)
    every = ", ".join(f"sum({c}) AS {c}" for c in sums)
    slope = "(n * p_{0} - sx * s_{0}) / (n * sxx - sx * sx)"
    fits = ", ".join(f"{slope.format(c)} AS b_{c}, (s_{c} - {slope.format(c)} * sx) / n AS a_{c}" for c in labels)
    scores = ", ".join(f"a_c{k} + b_c{k} * ws" for k in range(CLASSES + 1))
    inputs = ["1e0", *BASES]
    cells = ", ".join(
        f"sum({a} * {b}){' + 1e-6' if a == b else ''} AS m{i}_{j}" for i, a in enumerate(inputs) for j, b in enumerate([*inputs, "power"])
    )
    return f"""WITH known AS (SELECT site, date, power FROM obs WHERE flag),
  issue AS (SELECT i.site, i.start, k.power AS persistence FROM (SELECT DISTINCT site, start FROM runs) i
    ASOF LEFT JOIN known k ON k.site = i.site AND k.date <= i.start),
  told AS (SELECT site, date, start, power, ws, flag,
      CASE WHEN flag THEN CAST(floor({FOLDS} * {share}) AS INTEGER) ELSE -1 END AS fold,
      {', '.join(f"(round_even({CLASSES} * power, 0) = {k})::INT::DOUBLE AS c{k}" for k in range(CLASSES + 1))} FROM features),
  own AS (SELECT site, fold, count(*)::DOUBLE AS n, sum(ws) AS sx, sum(ws * ws) AS sxx, {own}
    FROM told WHERE flag AND ws IS NOT NULL AND power IS NOT NULL GROUP BY site, fold),
  held AS (SELECT site, fold, {rest} FROM own UNION ALL SELECT site, -1, {every} FROM own GROUP BY site),
  fits AS (SELECT site, fold, {fits} FROM held),
  based AS (SELECT t.site, t.date, t.start, t.power, t.flag, i.persistence, a_power + b_power * ws AS linear,
      (list_position([{scores}], list_max([{scores}])) - 1) / {float(CLASSES)} AS classed
    FROM told t LEFT JOIN fits USING (site, fold) JOIN issue i ON i.site = t.site AND i.start = t.start),
  sums AS (SELECT {cells} FROM based WHERE flag AND linear IS NOT NULL AND classed IS NOT NULL AND persistence IS NOT NULL AND power IS NOT NULL),
  {solve_sql('sums', len(inputs), 'mix')}
  SELECT site, date, start, power, round(x0 + x1 * linear + x2 * classed + x3 * persistence, 6) AS predicted
  FROM based, mix WHERE NOT flag"""


@query("stack_ensemble", _stack_sql())
def _(spark, sf):
    rows = views.features(spark, sf, together=True)
    share = splits.split_share(F.col("site"), F.col("date"), F.col("start"))
    fold = F.when(F.col("flag"), F.floor(share * FOLDS).cast("int")).otherwise(F.lit(-1))
    rows = rows.select("site", "date", "start", "power", "ws", "flag", fold.alias("fold"))
    names = [f"c{k}" for k in range(CLASSES + 1)]
    label = class_label("power", CLASSES)
    train = rows.filter("flag").select("*", F.col("power").alias("linear"), *[(label == k).cast("double").alias(c) for k, c in enumerate(names)])
    labels = ["linear", *names]
    based = models.score_out_of_fold(rows, models.fit_out_of_fold(train, ["ws"], labels, "fold"), ["ws"], labels, "fold")
    classed = F.when(F.col("linear").isNotNull(), class_to_power(decode_class(F.array(*names)), CLASSES))
    issues = durable(rows.select("site", "start").distinct(), narrow=True)  # read three times
    persisted = joins.last_known(issues, "start", views.obs_masked(spark, sf, together=True), "date", "power", name="persistence")
    based = based.withColumn("classed", classed).drop(*names).join(persisted, ["site", "start"])
    predicted = models.stack(based.filter("flag"), based.filter(~F.col("flag")), BASES)
    return predicted.select("site", "date", "start", "power", F.round("predicted", 6).alias("predicted"))


@query("window_regress")
def _(spark, sf):
    cut = cut_windows(
        near(spark, sf).filter("flag"), ["dist", "ws", "ws_power", "power"], 84, 24
    )
    windows = channel_swap(cut, ["dist", "ws"], 36, 48).drop("steps")
    rows = splits.hash_split(models.lead_rows(windows), ["site", "window_start"], 0.9)
    base = ["lead", "last_power", "mean_power", "ws", "ws_power"]
    predicted = models.stack(
        rows.filter("split = 'train'"), rows.filter("split = 'test'"), base
    )
    scored = metrics.window_rmse(predicted, "power", "predicted", ["window_start"], ["site"])
    return scored


@query("window_network")
def _(spark, sf):
    """Windows of 36 + 48 hours from every hour on; tests are whole weeks, purged of shared hours."""
    cut = cut_windows(near(spark, sf).filter("flag"), ["dist", "ws", "ws_power", "power"], 84)
    swapped = channel_swap(cut, ["dist", "ws"], 36, 48)
    x = F.concat(F.transform("x", lambda r: r["power_in"]), F.transform("x", lambda r: r["ws"]))
    rows = swapped.select("site", "window_start", x.alias("x"), "y", F.floor(hour_number("window_start") / 168).alias("week"))
    # Cut once: the purge reads the windows twice, the fit and the scores once more each.
    rows = durable(splits.hash_split(rows, ["site", "week"], 0.9))
    marked = splits.purged_split(rows, "window_start", 84)
    train = marked.filter("split = 'train'")
    network = networks.fit_network(train, "x", "y", ["site", "window_start"], 168, 48, networks.Settings(hidden=(64,)))
    scored = networks.score_network(marked.filter("split = 'test'"), network, "x")
    steps = F.arrays_zip(F.col("y"), F.col("predicted"))
    return metrics.packed_window_rmse(scored.withColumn("steps", steps), 0, 48, "y", "predicted", ["site"])


_DEPTH = 36
_WEIGHTS = [0.5 ** (k + 1) for k in range(_DEPTH)]


def _blocks(spark, sf, by="user"):
    weather = joins.latest_run(views.runs(spark, sf, by), ["ws"]).select(
        "site", F.col("new_date").alias("date"), "ws"
    )
    return recursion.blocks_with_context(views.obs(spark, sf, by), weather, ["ws"], _DEPTH)


WALK_SQL = """WITH RECURSIVE weather AS (SELECT site, new_date AS date, max_by(ws, start) AS ws
              FROM runs GROUP BY 1, 2),
       hours AS (SELECT t.site, t.date, w.ws, date_trunc('hour', t.date)
                 - ((datediff('hour', TIMESTAMP '2024-01-01', t.date) - 1) % 168 - 119)
                   * INTERVAL 1 HOUR AS start
                 FROM truth t JOIN weather w USING (site, date)),
       context AS (SELECT h.site, h.start, list(o.power ORDER BY o.date DESC) AS past
                   FROM (SELECT DISTINCT site, start FROM hours) h
                   JOIN obs o ON o.site = h.site AND o.flag AND o.date <= h.start
                        AND o.date > h.start - INTERVAL 36 HOUR
                   GROUP BY 1, 2 HAVING count(*) = 36),
       walk AS (
         SELECT site, start, 0 AS step, past FROM context
         UNION ALL
         SELECT w.site, w.start, w.step + 1,
                list_prepend(list_sum(list_transform(w.past[1:36], lambda p, i: p * pow(5e-1, i)))
                             + 2e-3 * h.ws, w.past)
         FROM walk w JOIN hours h ON h.site = w.site AND h.start = w.start
              AND h.date = w.start + (w.step + 1) * INTERVAL 1 HOUR)"""


@query(
    "recursive_forecast",
    f"""{WALK_SQL}
       SELECT site, start, start + step * INTERVAL 1 HOUR AS date, round(past[1], 6) AS power
       FROM walk WHERE step > 0""",
)
def _(spark, sf):
    walked = recursion.recursive_linear(_blocks(spark, sf), _WEIGHTS, {"ws": 0.002})
    return walked.withColumn("power", F.round("power", 6))


_STEP = WALK_SQL[WALK_SQL.index("list_sum(") : WALK_SQL.index(", w.past)")]


@query(
    "recursive_forecast_model",
    WALK_SQL.replace(_STEP, f"least(greatest({_STEP}, 0e0), 92e-2)")
    + """
       SELECT site, start, start + step * INTERVAL 1 HOUR AS date, round(past[1], 6) AS power
       FROM walk WHERE step > 0""",
)
def _(spark, sf):
    import numpy as np

    weights = np.array(_WEIGHTS[::-1])

    def predict(past, hour):
        return min(max(float(past @ weights) + 0.002 * hour["ws"], 0.0), 0.92)

    walked = recursion.recursive_model(_blocks(spark, sf), predict, ["ws"])
    return walked.withColumn("power", F.round("power", 6))


@query("recursive_cross_site")
def _(spark, sf):
    def predict(past, hour):
        own, all_sites = past[-1], past[-6:].mean()
        return 0.6 * own + 0.3 * all_sites + 0.002 * hour[:, 0]

    return recursion.recursive_cross_site(_blocks(spark, sf, "kind"), predict, ["ws"])

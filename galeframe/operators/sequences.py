"""History/horizon windows over hourly series.

A window is one row: the series keys, ``window_start`` and ``steps``, an array of structs in
time order. Windows are cut out of bounded chunks: the rows of a chunk, plus the rows a
window may reach into the next one, are packed into one sorted array, and every window is a
slice of it. The data is shuffled once, not once per window position, and a hot site is as
many independent chunks as its history is long.

Computed arrays are unrolled with the ``outer`` generators: the plain ones make the
optimizer infer a size filter that evaluates the whole array expression a second time,
inlined into its own inner functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from galeframe.functions import (
    add_hours,
    binary_label,
    calendar,
    class_label,
    direction_bucket,
    hour_number,
    one_hot,
    powers_of,
    wind_components,
)
from galeframe.operators.joins import longest_lead, write_back
from galeframe.operators.ordered import CHUNK, every_nth, hour_chunk, merged, number_rows, spread, spread_chunks


def cut_windows(
    df: DataFrame,
    columns: Sequence[str],
    length: int,
    stride: int = 1,
    keys: Sequence[str] = ("site",),
    time: str = "date",
    need_next: bool = True,
    span: int = 512,
) -> DataFrame:
    """Gap-free windows of ``length`` rows that start at every ``stride``-th row.

    With ``need_next`` the row after the window must exist too, ``length`` hours after the
    first. Stride 1 needs no row positions; other strides count rows of the series from 0.
    """
    keys = list(keys)
    span = max(span, length + 1)
    if stride == 1:
        base, axis = df, hour_number(time)
    else:
        base = number_rows(df, keys, time, "_pos")
        axis = F.col("_pos")
    packed = _packed_chunks(base, keys, axis, span, time, columns, after=length)
    reach = length if need_next else length - 1

    def starts(i: Column) -> Column:
        row = F.get("_rows", i)
        own = F.floor(row["_axis"] / F.lit(span)) == F.col(CHUNK)
        whole = F.get("_rows", i + reach)["_t"] == add_hours(row["_t"], reach)
        hit = own & whole
        return hit & (row["_axis"] % stride == 0) if stride > 1 else hit

    found = F.transform(
        F.filter(_places(), starts),
        lambda i: F.struct(i.alias("_first"), F.get("_rows", i)["_t"].alias("window_start")),
    )
    return _sliced(packed, keys, found, columns, length)


def _packed_chunks(
    df: DataFrame, keys: list[str], axis: Column, span: int, time: str, columns: Sequence[str],
    before: int = 0, after: int = 0, lowest: int | None = None, **extra: Column,
) -> DataFrame:
    """One row per chunk: ``_rows``, its rows and the halo rows in the order of the axis."""
    spread = spread_chunks(df, keys, axis, span, before, after, lowest)
    row = F.struct(
        F.col("_axis"), F.col(time).alias("_t"), *[c.alias(n) for n, c in extra.items()],
        *_fields(columns),
    )
    return spread.groupBy(*keys, CHUNK).agg(F.array_sort(F.collect_list(row)).alias("_rows"))


def _places() -> Column:
    return F.sequence(F.lit(0), F.size("_rows") - 1)


def _steps(rows: Column, columns: Sequence[str]) -> Column:
    return F.transform(
        rows, lambda r: F.struct(*[r[f"c{k}"].alias(c) for k, c in enumerate(columns)])
    )


def _sliced(
    packed: DataFrame, keys: list[str], places: Column, columns: Sequence[str], length: int
) -> DataFrame:
    """One row per window: ``places`` are structs of ``_first``, the place of its first row in
    the chunk, and of what else the window has. ``steps`` is cut last: inside a function of
    places every slice would turn the whole chunk into objects first."""
    cut = F.slice("_data", F.col("_w._first") + 1, F.lit(length))
    return (
        packed.select(*keys, _steps(F.col("_rows"), columns).alias("_data"), places.alias("_places"))
        .select(*keys, "_data", F.explode_outer("_places").alias("_w"))
        .filter(F.col("_w").isNotNull())
        .select(*keys, "_w.*", cut.alias("steps"))
        .drop("_first")
    )


def _fields(columns: Sequence[str]) -> list[Column]:
    return [F.col(c).alias(f"c{k}") for k, c in enumerate(columns)]


def windows_at(
    df: DataFrame,
    anchors: DataFrame,
    columns: Sequence[str],
    before: int,
    after: int,
    keys: Sequence[str] = ("site",),
    time: str = "date",
) -> DataFrame:
    """Windows by row position around given times: ``before`` rows in front of the anchor
    row, the row itself and the following ones up to ``after`` rows in all. No gap test;
    windows that run over the ends of the series are left out."""
    keys = list(keys)
    numbered = number_rows(df.select(*keys, time, *[c for c in columns if c != time]), keys, time, "_pos")
    placed = merged(anchors.select(*keys, time), numbered.select(*keys, time, "_pos"), [*keys, time])
    offsets = F.explode(F.sequence(F.lit(-before), F.lit(after - 1)))
    wanted = placed.select(
        *keys, F.col(time).alias("window_start"), "_pos", offsets.alias("_k")
    ).select(*keys, "window_start", "_k", (F.col("_pos") + F.col("_k")).alias("_pos"))
    joined = merged(wanted, numbered, [*keys, "_pos"])
    return (
        _packed(joined, [*keys, "window_start"], "_k", columns)
        .filter(F.size("steps") == before + after)
    )


def _packed(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Groups of a fixed number of rows to one row with ``steps``."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_k"), *_fields(columns))))
    return df.groupBy(*keys).agg(rows.alias("_rows")).select(
        *keys,
        F.transform(
            "_rows", lambda r: F.struct(*[r[f"c{k}"].alias(c) for k, c in enumerate(columns)])
        ).alias("steps"),
    )


def window_starts(df: DataFrame, history: int = 36, horizon: int = 48, stride: int = 1,
                  keys: Sequence[str] = ("site",), time: str = "date") -> DataFrame:
    """Start times of the gap-free windows; carries no window contents."""
    cut = cut_windows(df, [time], history + horizon, stride, keys, time)
    return cut.select(*keys, "window_start")


def unrolled(windows: DataFrame, column: str = "steps", place: str = "step") -> DataFrame:
    """One row per window and step, the struct fields as columns."""
    kept = [c for c in windows.columns if c != column]
    return windows.select(*kept, F.posexplode_outer(column).alias(place, "_s")).select(
        *kept, place, "_s.*"
    )


def _at(steps, index: Column, field: str) -> Column:
    return F.get(steps, index)[field]


def _targets(steps: str, first: int, n: int, target: str) -> Column:
    return F.slice(F.col(steps)[target], F.lit(first + 1), F.lit(n))


def channel_swap(
    windows: DataFrame, features: Sequence[str], history: int, horizon: int,
    measured: str = "power", predicted: str = "ws_power",
) -> DataFrame:
    """Adds ``x`` (features plus one power channel) and ``y``.

    The power channel holds measured power on the history steps and the stage-one estimate
    on the horizon steps; ``y`` is the measured power of the horizon.
    """
    steps = F.col("steps")
    past = F.slice(steps[measured], F.lit(1), F.lit(history))
    ahead = F.slice(steps[predicted], F.lit(history + 1), F.size(steps))
    x = F.arrays_zip(*[steps[c].alias(c) for c in features], F.concat(past, ahead).alias("power_in"))
    return windows.withColumn("x", x).withColumn("y", _targets("steps", history, horizon, measured))


def _paired(wind_from: int, power_from: int, n: int, wind: Sequence[str], power: str) -> Column:
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda k: F.struct(
            *[_at("steps", k + wind_from, c).alias(c) for c in wind],
            _at("steps", k + power_from, power).alias("power_in"),
        ),
    )


def offset_pair(
    windows: DataFrame, wind: Sequence[str], history: int, horizon: int, power: str = "power",
    target: str = "power",
) -> DataFrame:
    """Weather of the later rows beside the power of the first ``history`` rows; ``y`` is the
    target of the horizon."""
    wind_from = horizon if history > horizon else history
    return windows.withColumn(
        "x", _paired(wind_from, 0, history, wind, power)
    ).withColumn("y", _targets("steps", history, horizon, target))


def reverse_pair(
    windows: DataFrame, wind: Sequence[str], history: int, horizon: int, power: str = "power",
    target: str = "power",
) -> DataFrame:
    """Looks backwards: weather of the earlier rows beside the power after them; ``y`` is the
    target of the first ``horizon`` rows."""
    wind_from = 0 if history > horizon else horizon - history
    return windows.withColumn(
        "x", _paired(wind_from, horizon, history, wind, power)
    ).withColumn("y", _targets("steps", 0, horizon, target))


def lagged_slide(
    windows: DataFrame, features: Sequence[str], lagged: Sequence[str], history: int,
    target: str = "power",
) -> DataFrame:
    """One-step samples inside each window: features of rows i+1..i+S beside the lagged
    columns of rows i..i+S-1; ``y`` is the target of row i+S."""
    kept = [c for c in windows.columns if c != "steps"]
    firsts = F.filter(
        F.sequence(F.lit(0), F.size("steps") - 1), lambda i: i + history < F.size("steps")
    )
    slid = windows.select("*", F.explode_outer(firsts).alias("slide")).filter(
        F.col("slide").isNotNull()
    )
    # Slices that are zipped are generated code; a function a step is not.
    ahead = [F.slice(F.col("steps")[c], F.col("slide") + 2, F.lit(history)).alias(c) for c in features]
    past = [F.slice(F.col("steps")[c], F.col("slide") + 1, F.lit(history)).alias(f"prev_{c}") for c in lagged]
    return slid.select(
        *kept, "slide", F.arrays_zip(*ahead, *past).alias("x"), _at("steps", F.col("slide") + history, target).alias("y")
    )


def sequence_dataset(
    features: DataFrame,
    columns: Sequence[str],
    history: int = 36,
    horizon: int = 48,
    stride: int = 1,
    keys: Sequence[str] = ("site", "catagory"),
) -> DataFrame:
    """Training windows and 48-row evaluation windows per site and lead category.

    Training windows are gap-free runs of measured hours with the channel swap. Evaluation
    windows start at every ``horizon``-th hour to predict and take the rows as they are.
    """
    keys = list(keys)
    inputs = list(columns)
    fields = [*inputs, "ws_power", "power"]
    values = [v for v in dict.fromkeys([*fields, "flag"]) if v not in (*keys, "date")]
    # Spread once by chunk of hours, for the choice of rows as well as for their numbers.
    spread_rows = features.select(*keys, "date", "dist", *[v for v in values if v != "dist"]).withColumn(CHUNK, hour_chunk("date"))
    rows = longest_lead(spread_rows.transform(spread, *keys, CHUNK), [*keys, "date", CHUNK], values)
    numbered = number_rows(
        rows, keys, "date", "_pos", also={"_train": F.col("flag"), "_test": ~F.col("flag")}
    )
    length = history + horizon
    span = max(1024, length + 1)
    # Both kinds of windows are slices of the same packed chunks. Positions begin at 0.
    packed = _packed_chunks(
        numbered, keys, F.col("_pos"), span, "date", fields, before=history, after=length, lowest=0,
        flag=F.col("flag"), train=F.col("_train"), test=F.col("_test"),
    )

    def own(row: Column) -> Column:
        return F.floor(row["_axis"] / F.lit(span)) == F.col(CHUNK)

    def opens_train(i: Column) -> Column:
        row, next_ = F.get("_rows", i), F.get("_rows", i + length)
        measured = row["flag"] & next_["flag"] & (next_["train"] == row["train"] + length)
        whole = next_["_t"] == add_hours(row["_t"], length)
        return own(row) & measured & whole & (row["train"] % stride == 0)

    def opens_test(i: Column) -> Column:
        row = F.get("_rows", i)
        inside = (i >= history) & (i + horizon <= F.size("_rows"))
        return own(row) & ~row["flag"] & (row["test"] % horizon == 0) & inside

    def window(first: Column, start: Column, split: str) -> Column:
        return F.struct(
            first.alias("_first"), start.alias("window_start"), F.lit(split).alias("split")
        )

    train = F.transform(
        F.filter(_places(), opens_train),
        lambda i: window(i, F.get("_rows", i)["_t"], "train"),
    )
    test = F.transform(
        F.filter(_places(), opens_test),
        lambda i: window(i - history, F.get("_rows", i)["_t"], "test"),
    )
    windows = _sliced(packed, keys, F.concat(train, test), fields, length)
    swapped = F.transform(
        "steps",
        lambda r, k: F.struct(
            *[r[c].alias(c) for c in inputs],
            F.when((k < history) & (F.col("split") == "train"), r["power"])
            .otherwise(r["ws_power"])
            .alias("power_in"),
        ),
    )
    return windows.select(
        *keys, "window_start", "split", swapped.alias("x"),
        _targets("steps", history, horizon, "power").alias("y"),
    )


def category_windows(
    features: DataFrame,
    columns: Sequence[str],
    history: int = 36,
    horizon: int = 48,
    stride: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Windows inside each lead category of the longest-lead series, and history-only windows
    in front of every ``horizon``-th hour to predict."""
    values = list(dict.fromkeys([*columns, "power", "ws_power", "flag", "catagory"]))
    rows = longest_lead(features, ["site", "date"], [v for v in values if v not in ("site", "date")])
    train = channel_swap(
        cut_windows(rows.filter("flag"), [*columns, "ws_power", "power"], history + horizon,
                    stride, ["site", "catagory"]),
        columns, history, horizon,
    ).drop("steps")
    anchors = every_nth(rows.filter(~F.col("flag")).select("site", "date"), ["site"], "date", horizon)
    predict = windows_at(rows, anchors, columns, history, 0)
    return train, predict


def history_plus_run(
    features: DataFrame,
    columns: Sequence[str],
    target: str,
    history: int = 36,
    lead_in: int = 48,
    stride: int = 12,
) -> DataFrame:
    """First-category history followed by all steps of the run issued at its last hour.

    ``y`` is the target of rows ``lead_in .. lead_in + history``; the gap test spans both.
    """
    near = features.filter(F.col("catagory") == 1)
    fields = list(dict.fromkeys([*columns, target]))
    cut = _windows_with_runs(near, features, columns, fields, history + lead_in, stride, history - 1)
    return _history_and_run(cut.withColumn("y", _targets("steps", lead_in, history, target)), columns, history)


def _windows_with_runs(
    near: DataFrame, features: DataFrame, columns: Sequence[str], fields: Sequence[str], length: int,
    stride: int, issued_after: int, span: int = 512,
) -> DataFrame:
    """Gap-free windows of ``near`` as of ``cut_windows`` that have a run issued ``issued_after`` hours
    after their start; ``_run`` has its ``columns`` by lead.

    A window without gaps lies in its chunk of hours and ``length`` hours behind it, so chunks of
    rows meet the runs of the windows that start there: rows and steps are shuffled once for all
    windows, and no window is shuffled.
    """
    span = max(span, length + 1)
    rows = near.select("site", "date", *[c for c in fields if c != "date"])
    extra = {}
    if stride > 1:
        rows, extra = number_rows(rows, ["site"], "date", "_pos"), {"pos": F.col("_pos")}
    packed = _packed_chunks(rows, ["site"], hour_number("date"), span, "date", fields, after=length, **extra)

    def starts(i: Column) -> Column:
        row = F.get("_rows", i)
        hit = F.floor(row["_axis"] / F.lit(span)) == F.col(CHUNK)
        hit = hit & (F.get("_rows", i + length)["_t"] == add_hours(row["_t"], length))
        return hit & (row["pos"] % stride == 0) if stride > 1 else hit

    found = F.transform(
        F.filter(_places(), starts),
        lambda i: F.struct(F.get("_rows", i)["_t"].alias("window_start"), i.alias("_first")),
    )
    chunks = packed.select("site", CHUNK, _steps(F.col("_rows"), fields).alias("_data"), found.alias("_found"))
    chunks = chunks.filter(F.size("_found") > 0)
    at = add_hours("start", -issued_after)
    steps = features.select("site", at.alias("_at"), "dist", *[c for c in columns if c != "dist"])
    home = F.floor(hour_number("_at") / F.lit(span))
    runs = _packed(
        spread(steps.withColumn(CHUNK, home), "site", CHUNK), ["site", CHUNK, "_at"], "dist", columns
    ).withColumnRenamed("steps", "_run")
    own = F.filter("_found", lambda w: w["window_start"] == F.col("_at"))
    return (
        merged(chunks, runs, ["site", CHUNK])
        .filter(F.array_contains(F.col("_found")["window_start"], F.col("_at")))
        .select("site", "_data", "_run", F.explode_outer(own).alias("_w"))
        .select("site", "_w.window_start", F.slice("_data", F.col("_w._first") + 1, F.lit(length)).alias("steps"), "_run")
    )


def _history_and_run(cut: DataFrame, columns: Sequence[str], history: int) -> DataFrame:
    """Replaces the rows of a window behind its history by its run."""
    own = F.slice("steps", F.lit(1), F.lit(history))
    return cut.withColumn("steps", F.concat(_steps_of(own, columns), F.col("_run"))).drop("_run")


def _steps_of(rows: Column, columns: Sequence[str]) -> Column:
    """The rows with these fields only."""
    return F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in columns]))


def predict_and_update(
    features: DataFrame,
    model,
    target: str = "ws",
    history: int = 36,
    lead_in: int = 48,
    every: int = 192,
) -> DataFrame:
    """Predicts ``target`` for first-category hours around the gaps, writes it back and
    derives the dependent columns again.

    Every ``every``-th row to predict opens a window: ``history`` first-category rows before
    it and the run issued at the last of them. ``model`` maps the columns ``_history`` and
    ``_run`` (arrays of the target) to an array of ``history`` values, which belong to the
    hours from ``lead_in`` after the window start on.
    """
    order = [F.col("start"), F.col("dist")]
    open_ = number_rows(
        features.filter(~F.col("flag")).select("site", "start", "dist", "date"),
        ["site"], "start", "_n", order=order[1:],
    ).filter(F.col("_n") % every == 0)
    near = features.filter(F.col("catagory") == 1).select("site", "date", target)
    asked = (
        open_.select("site", add_hours("date", -history).alias("window_start"))
        .distinct()
        .withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(history - 1))))
        .withColumn("date", add_hours("window_start", F.col("_k")))
    )
    past = _packed(merged(asked, near, ["site", "date"]), ["site", "window_start"], "_k", [target])
    runs = _packed(
        features.select("site", "start", "dist", target), ["site", "start"], "dist", [target]
    ).select("site", F.col("start").alias("_issued"), F.col("steps").alias("_steps"))
    whole = past.filter(F.size("steps") == history).withColumn("_issued", add_hours("window_start", history - 1))
    ready = (
        merged(whole, runs, ["site", "_issued"])
        .select(
            "site",
            "window_start",
            F.transform("steps", lambda r: r[target]).alias("_history"),
            F.transform("_steps", lambda r: r[target]).alias("_run"),
        )
    )
    # Windows may overlap; the latest one decides, as in sequential updating.
    predicted = (
        ready.select("site", "window_start", F.posexplode_outer(model).alias("_k", "_p"))
        .withColumn("date", add_hours("window_start", F.col("_k") + lead_in))
        .groupBy("site", "date")
        .agg(F.max_by("_p", "window_start").alias(target))
        .withColumn("catagory", F.lit(1))
    )
    updated = write_back(features, predicted, ["site", "date", "catagory"], target)
    derived = {"wd_cut_left": direction_bucket("wd", as_share=False), **powers_of("ws")}
    return updated.withColumns({**derived, **wind_components()})


def category_pair_windows(
    pivoted: DataFrame, wind: Sequence[str], steps: int = 48, stride: int = 12
) -> DataFrame:
    """Windows of twice ``steps`` rows over the lead-category columns, paired by offset."""
    cut = cut_windows(pivoted, [*wind, "power"], 2 * steps, stride)
    return offset_pair(cut, wind, steps, steps)


def recent_and_issued(
    power_wide: DataFrame,
    latest: DataFrame,
    runs: DataFrame,
    weather: Sequence[str],
    sites: Sequence[int],
    steps: int = 48,
    stride: int = 480,
) -> DataFrame:
    """Long windows of weather and the power of every site around an issue time.

    Every ``stride``-th hour of the wide power table opens a window of twice ``steps`` hours
    per site: the first half with the weather of the latest run for each hour, the second
    with the run issued at its start.
    """
    power = [f"wp{k}" for k in sites]
    starts = every_nth(power_wide.select(F.lit(0).alias("_all"), "date"), ["_all"], "date", stride)
    hours = starts.select(
        F.col("date").alias("window_start"),
        F.explode(F.sequence(F.lit(1), F.lit(2 * steps))).alias("step"),
    ).withColumn("date", add_hours("window_start", F.col("step")))
    known = hours.join(power_wide.select("date", *power), "date")
    first = known.filter(F.col("step") <= steps).join(
        latest.select("site", F.col("new_date").alias("date"), *weather), "date"
    )
    second = (
        known.filter(F.col("step") > steps)
        .withColumn("start", add_hours("window_start", steps))
        .join(
            runs.select("site", "start", F.col("new_date").alias("date"), *weather),
            ["start", "date"],
        )
        .drop("start")
    )
    parts = [c.alias(n) for n, c in calendar("date").items() if n != "week"]
    return first.unionByName(second).select(
        "site", "window_start", "step", "date", *parts, *weather, *power
    )


def issued_single(long_windows: DataFrame, weather: Sequence[str], power: Sequence[str],
                  steps: int = 48) -> DataFrame:
    """One sample per window: calendar and power of the first half beside the weather of the
    second; ``y`` is the power of the second half, one column per site."""
    keys = ["site", "window_start"]
    past = long_windows.filter(F.col("step") <= steps).select(
        *keys, "step", "year", "month", "hour", *power
    )
    ahead = long_windows.filter(F.col("step") > steps).select(
        *keys, (F.col("step") - steps).alias("step"), *weather,
        *[F.col(p).alias(f"y_{p}") for p in power],
    )
    return past.join(ahead, [*keys, "step"])


def window_consistency(df: DataFrame, value: str, length: int, stride: int = 12) -> DataFrame:
    """Cuts each window by position and again by time; the RMSE between both must be 0."""
    by_position = unrolled(cut_windows(df, [value], length, stride, need_next=False))
    asked = by_position.select(
        "site", "window_start", "step", F.col(value).alias("_a"),
        add_hours("window_start", F.col("step")).alias("date"),
    )
    both = asked.join(df.select("site", "date", F.col(value).alias("_b")), ["site", "date"])
    d = F.col("_a") - F.col("_b")
    return both.groupBy("site").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse")
    )


def objective_windows(
    features: DataFrame,
    wind: Sequence[str],
    objective: str = "regression",
    history: int = 36,
    horizon: int = 48,
    stride: int = 1,
    classes: int = 50,
    threshold: float = 0.1,
) -> DataFrame:
    """Windows whose label depends on the objective.

    History rows are followed by the run issued one hour before the window. Regression pairs
    them by offset and keeps ``horizon`` targets; ``category`` (one-hot label) and
    ``binary`` slide one-step samples over the rows.
    """
    labels = {
        "regression": F.col("power"),
        "category": class_label("power", classes, within=True),
        "binary": binary_label("power", threshold),
    }
    rows = features.withColumn("label", labels[objective])
    columns = [*wind, "power", "label"]
    near = rows.filter((F.col("catagory") == 1) & F.col("flag"))
    cut = _windows_with_runs(near, rows, columns, columns, history + horizon, stride, -1)
    joined = _history_and_run(cut, columns, history)
    if objective == "regression":
        return offset_pair(joined, wind, history, horizon, target="label").drop("steps")
    slid = lagged_slide(joined, wind, ["power"], history, target="label")
    return slid.withColumn("y", one_hot("y", classes)) if objective == "category" else slid

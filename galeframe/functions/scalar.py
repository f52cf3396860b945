"""Scalar expressions: every function takes columns and returns a column.

All of them are compositions of built-in functions, so they stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ORIGIN = "2024-01-01 00:00:00"


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ---- time -----------------------------------------------------------------------------


def valid_time(start="start", dist="dist") -> Column:
    """The hour a forecast step speaks about: issue time plus lead."""
    return F.timestamp_add("HOUR", _col(dist), _col(start))


def add_hours(time, hours) -> Column:
    return F.timestamp_add("HOUR", F.lit(hours) if isinstance(hours, int) else hours, _col(time))


def hours_between(earlier, later) -> Column:
    return F.timestamp_diff("HOUR", _col(earlier), _col(later))


def hour_number(time) -> Column:
    """Whole hours since a fixed origin, as bigint; negative before it."""
    return F.floor(
        F.timestamp_diff("SECOND", F.lit(ORIGIN).cast("timestamp_ntz"), _col(time)) / F.lit(3600)
    )


def calendar(time="date", weekday: bool = False) -> dict[str, Column]:
    """year, month, ISO week and hour (and Monday = 0 weekday on request)."""
    t = _col(time)
    parts = {
        "year": F.year(t),
        "month": F.month(t),
        "week": F.weekofyear(t),
        "hour": F.hour(t),
    }
    if weekday:
        parts["weekday"] = F.weekday(t)
    return parts


def lead_category(dist="dist", width: int = 12) -> Column:
    """1 for leads 1..width, 2 for the next ``width`` leads, and so on."""
    return F.ceil(_col(dist) / F.lit(width)).cast("int")


# ---- wind -----------------------------------------------------------------------------


def direction_bucket(wd="wd", width: int = 30, as_share: bool = True) -> Column:
    """Left edge of the direction sector, as a share of the circle or in degrees."""
    left = F.floor(_col(wd) / F.lit(width)) * F.lit(width)
    return (left / F.lit(360.0)) if as_share else left.cast("double")


def powers_of(x="ws") -> dict[str, Column]:
    """Square and cube as products, which give the same bits on every engine."""
    c = _col(x)
    return {f"{x}_2": c * c, f"{x}_3": c * c * c}


def wind_components(ws="ws", wd="wd") -> dict[str, Column]:
    """Polar wind to vector: u = ws sin(wd), v = ws cos(wd), wd in degrees."""
    angle = F.radians(_col(wd))
    return {"u": _col(ws) * F.sin(angle), "v": _col(ws) * F.cos(angle)}


def circle_to_degrees(share="wd") -> Column:
    return _col(share) * F.lit(360.0)


# ---- targets --------------------------------------------------------------------------


def clamp(x, low: float = 0.0, high: float = 0.92) -> Column:
    """Physical bounds on a value; NULL stays NULL (least/greatest alone would skip it)."""
    c = _col(x)
    return F.when(c < low, F.lit(low)).when(c >= high, F.lit(high)).otherwise(c)


def binary_label(power="power", threshold: float = 0.1) -> Column:
    """0 below the threshold, 1 from it on; NULL stays NULL."""
    c = _col(power)
    return F.when(c.isNull(), None).when(c < threshold, 0).otherwise(1).cast("int")


def class_label(power="power", classes: int = 50, within: bool = False) -> Column:
    """Half-even rounding of ``classes * power``; ``within=True`` stays inside 0..classes-1."""
    scale = classes - 1 if within else classes
    return F.bround(_col(power) * F.lit(float(scale)), 0).cast("int")


def one_hot(label, classes: int) -> Column:
    """Array of ``classes`` ints with a single 1; an out-of-range label gives all zeros."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == _col(label)).cast("int")
    )


def decode_class(scores) -> Column:
    """Index of the first maximal score, counted from 0."""
    s = _col(scores)
    return (F.array_position(s, F.array_max(s)) - 1).cast("int")


def class_to_power(label, classes: int) -> Column:
    return _col(label) / F.lit(float(classes))


def round_probability(p) -> Column:
    return F.bround(_col(p), 0)


def to_number(text) -> Column:
    """Text to double; blank or unparsable text becomes NULL."""
    return F.nullif(F.trim(_col(text)), F.lit("")).try_cast("double")


# ---- arrays ---------------------------------------------------------------------------


def reversed_vector(values) -> Column:
    return F.reverse(_col(values))


def flat_window(steps) -> Column:
    """(time, feature) matrix to one vector."""
    return F.flatten(_col(steps))


def bounded_quantiles(q, low: float = 0.0, high: float = 1.0) -> Column:
    return F.transform(_col(q), lambda x: clamp(x, low, high))


def monotone_quantiles(q) -> Column:
    return F.array_sort(_col(q))

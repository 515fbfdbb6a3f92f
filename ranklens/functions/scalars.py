"""Scalar, array, map and date expressions. Every function maps Columns to a Column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400

# Bucket edges and tier cuts used by the features and the tier report.
WATCH_TIME_EDGES = [0, 600, 1800, 3600, 7200, 10800, 36000, 72000, 144000]
RECENCY_EDGES = [0, 259200, 604800, 1209600, 2592000, 5184000, 15552000]
RELEASE_DAY_EDGES = [7, 30, 180, 365, 730, 1095, 1460]
TIER_CUTS = [("High", 1.0), ("Medium", 0.1), ("Low", 0.01)]


def add_days(d: Column, n: int) -> Column:
    return F.date_add(d.cast("date"), n)


def date_list(end: Column, n: int, backwards: bool = True) -> Column:
    """n dates ending at (backwards) or starting at ``end``."""
    end = end.cast("date")
    if backwards:
        return F.sequence(end, F.date_add(end, -(n - 1)), F.expr("interval -1 day"))
    return F.sequence(end, F.date_add(end, n - 1), F.expr("interval 1 day"))


def day_offset(ts: Column, t0: Column) -> Column:
    """Whole 86 400 s steps from t0 to ts (floor, so negative before t0)."""
    return F.floor((ts - t0) / F.lit(DAY)).cast("bigint")


def recency(ts: Column, now: int | Column, half_life: float = 14 * DAY) -> Column:
    """Half-life decay 0.5 ** (age / half_life)."""
    now = F.lit(now) if isinstance(now, (int, float)) else now
    return F.pow(F.lit(0.5), (now - ts) / F.lit(float(half_life)))


def log_recency(ts: Column, start: Column) -> Column:
    """Logarithmic decay of release age: 1 / (1 + ln(1 + age in days)), age floored at 0."""
    age = F.greatest((ts - start) / F.lit(float(DAY)), F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.log1p(age))


def release_flag(ts: Column, start: Column, days: int) -> Column:
    return F.when(ts - start < days * DAY, 1.0).otherwise(0.0)


def bucket(x: Column, edges: list[float]) -> Column:
    """Number of edges at or below x; 0 is 'below the first edge'.

    A sum of comparisons stays inside generated code, unlike a lambda over an array.
    """
    return reduce(lambda a, b: a + b, [F.when(x >= e, 1).otherwise(0) for e in edges])


def year_bucket(year: Column, current_year: Column) -> Column:
    """Release-age bucket in years, 0 for the current or a later year, 10 at most."""
    return F.least(F.greatest(current_year - year, F.lit(0)), F.lit(10))


def sparse_pairs(pairs: list[tuple[int, Column]]) -> tuple[Column, Column]:
    """Index array and value array of a sparse row; index 0 is reserved."""
    indices = F.array(*[F.lit(i) for i, _ in pairs])
    values = F.array(*[v.cast("double") for _, v in pairs])
    return indices, values


def geo_key(*cols: Column, default: str = "mh") -> Column:
    """First non-null of the candidates, lower-cased."""
    return F.lower(F.coalesce(*cols, F.lit(default)))


def map_text(m: Column, key: Column | int) -> Column:
    """UTF-8 text of a binary map value, null when the key is absent."""
    return F.decode(F.try_element_at(m, F.lit(key) if isinstance(key, int) else key), "UTF-8")


def map_number(m: Column, key: str, default: float = 0.0) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit(key)), F.lit(default))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(h: Column, eps: float = 1e-8) -> Column:
    """h / (|h| + eps)."""
    h = h.cast("array<double>")
    norm = F.sqrt(dot(h, h)) + F.lit(eps)
    return F.transform(h, lambda x: x / norm)


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def heads(h: Column, click_w: Column, watch_w: Column, click_rate: float) -> dict[str, Column]:
    """Linear heads on a vector: recalibrated click logit, watch logit, product probability."""
    h = h.cast("array<double>")
    click = dot(h, click_w) + F.log(F.lit(float(click_rate)))
    watch = dot(h, watch_w)
    return {"click_logit": click, "watch_logit": watch, "p_watch": sigmoid(click) * sigmoid(watch)}


def tier(share: Column, cuts=TIER_CUTS, rest: str = "Negligible") -> Column:
    name, cut = cuts[0]
    expr = F.when(share >= cut, name)
    for name, cut in cuts[1:]:
        expr = expr.when(share >= cut, name)
    return expr.when(share.isNotNull(), rest)


def to_hours(seconds: Column) -> Column:
    return (seconds / F.lit(3600)).cast("float")


def horizon_output(hours: Column, day: Column) -> Column:
    """Prediction of the asked day (0-based) from an array of horizons."""
    return F.element_at(hours, (day + 1).cast("int"))


def horizon_seconds(hours: Column, floor_seconds: float = 600.0) -> Column:
    """Last horizon in seconds with a floor."""
    return F.greatest(F.element_at(hours, -1) * 3600, F.lit(floor_seconds))


def step_value(seconds: Column, thresholds: Column, values: Column, wrap: bool = True) -> Column:
    """Value of the last threshold (minutes) at or below the time; 1.0 without a step table.

    Below the first threshold the last value is returned when ``wrap`` is set, else the first.
    """
    pos = F.size(F.filter(thresholds, lambda t: t <= seconds / F.lit(60.0)))
    below = F.element_at(values, -1) if wrap else F.element_at(values, 1)
    return F.coalesce(F.when(pos == 0, below).otherwise(F.try_element_at(values, pos)), F.lit(1.0))


def variant_suffix(name: str | None) -> str | None:
    """Suffix with exactly one leading dash; an empty or missing name stays as it is."""
    return name if not name or name[0] == "-" else f"-{name}"

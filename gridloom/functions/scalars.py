"""Scalar functions: calendar, membership, wind and scaling expressions. All stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def weekday_of_day(day: Column) -> Column:
    """Monday is 0; day 0 was a Thursday."""
    return F.pmod(day + 3, F.lit(7))


def date_of_day(day: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int"))


def turn(x: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of a cyclic value."""
    a = x * (2 * 3.141592653589793 / period)
    return F.sin(a), F.cos(a)


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column) -> Column:
    return F.degrees(F.atan2(u, v)) + 180


def gauss(x: Column, mean: Column | float, sigma: Column | float) -> Column:
    d = x - mean
    return F.exp(-(d * d) / (2 * sigma * sigma))


def trapezoid(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """0 outside (a, d), 1 from b to c, linear between; a vertical side where two corners meet."""
    up = (x - a) / (b - a) if b > a else F.lit(1.0)
    down = (d - x) / (d - c) if d > c else F.lit(1.0)
    return F.when((x < a) | (x > d), 0.0).when((x >= b) & (x <= c), 1.0).when(x < b, up).otherwise(down).cast("double")


def activation(memberships: list[Column], p: float) -> Column:
    out = memberships[0]
    for m in memberships[1:]:
        out = out * m
    return F.pow(out, F.lit(1.0 / p))


def nearest_grid_line(x: Column, resolution: float, digits: int = 1) -> Column:
    """The closest line of the grid through round(x) - 20; of two equally close ones the lower."""
    base = F.round(x, digits) - 20
    return base + F.ceil((x - base) / resolution - 0.5) * resolution


def special_day(day: Column, holidays: list[tuple[int, int]]) -> Column:
    """100 on holidays (month, day of month), 50 on Sundays, else 0."""
    date = date_of_day(day)
    is_holiday = F.lit(False)
    for month, dom in holidays:
        is_holiday = is_holiday | ((F.month(date) == month) & (F.dayofmonth(date) == dom))
    return F.when(is_holiday, 100).when(weekday_of_day(day) == 6, 50).otherwise(0)


def temperature_interactions(month: Column, special: Column, temp: Column) -> tuple[Column, Column]:
    return F.pow(month * temp / 12, F.lit(3)), F.pow(special * temp / 100, F.lit(3))


def pinball(y: Column, estimate: Column, q: float) -> Column:
    e = y - estimate
    return F.greatest(q * e, (q - 1) * e)


def rbf(x: Column, centre: list[float], width: float) -> Column:
    """exp(-||(x - c) * r||^2) of an array column."""
    c = F.array(*[F.lit(float(v)) for v in centre])
    return F.exp(-F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v) * (width * width))


def rbf_map(x: Column, centre: list[float], widths: list[float]) -> Column:
    """exp(-((x_d - c_d) * r_d)^2) of each dimension: an array as long as x."""
    parts = F.array(*[F.struct(F.lit(float(c)).alias("c"), F.lit(float(r)).alias("r")) for c, r in zip(centre, widths, strict=True)])
    return F.zip_with(x, parts, lambda a, p: F.exp(-F.pow((a - p["c"]) * p["r"], F.lit(2))))


def pseudo_huber(y: Column, estimate: Column, delta: float = 1.0) -> Column:
    """Quadratic near zero, linear far away."""
    e = (y - estimate) / delta
    return delta * delta * (F.sqrt(1 + e * e) - 1)


def quantile_loss(y: Column, estimate: Column, q: float, delta: float = 1.0) -> Column:
    """The pinball loss of the signed error, smoothed around zero: the pseudo-Huber size, weighed by q above and 1 - q below."""
    return F.when(y >= estimate, q).otherwise(1 - q) * pseudo_huber(y, estimate, delta)


def clamped(x: Column, kind: str = "") -> Column:
    """Not below zero; radial-basis forecasts, which are shares, not above one either."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) if "RBF" in kind.upper() else F.greatest(F.lit(0.0), x)


def noisy(x: Column, *key: Column, share: float = 0.05, seed: int = 0) -> Column:
    """x with relative normal noise, drawn from the key alone."""
    from ..operators.resample import uniform

    u, v = uniform(*key, seed=seed), uniform(*key, seed=seed + 1)
    normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * 3.141592653589793 * v)
    return x + share * normal * x


def encoded(x: Column, kind: str, **more) -> Column:
    """identity, string, log (base), unit (low, high to 0 and 1) or category (its number in a list; null for others)."""
    if kind == "identity":
        return x
    if kind == "string":
        return x.cast("string")
    if kind == "log":
        return F.log(x) / F.log(F.lit(float(more.get("base", 10))))
    if kind == "unit":
        return (x - more["low"]) / (more["high"] - more["low"])
    if kind == "category":
        at = F.array_position(F.array(*[F.lit(v) for v in more["values"]]), x)
        return F.when(at > 0, at - 1)
    raise ValueError(f"no such encoding: {kind}")


def decoded(x: Column, kind: str, **more) -> Column:
    """The inverse of `encoded`; string gives a string back."""
    if kind in ("identity", "string"):
        return x
    if kind == "log":
        return F.pow(F.lit(float(more.get("base", 10))), x)
    if kind == "unit":
        return x * (more["high"] - more["low"]) + more["low"]
    if kind == "category":
        return F.get(F.array(*[F.lit(v) for v in more["values"]]), x.cast("int"))
    raise ValueError(f"no such encoding: {kind}")


def closest_name(name: Column, names: list[str]) -> Column:
    """The name of the fewest edits away, whatever the case (ties: the first in order)."""
    each = [F.struct(F.levenshtein(F.lower(name), F.lit(n.lower())).alias("d"), F.lit(n).alias("n")) for n in sorted(names)]
    return F.array_min(F.array(*each))["n"]


def as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def from_json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)


def rounded(x: Column, digits: int) -> Column:
    """A double to so many digits, half away from zero; a zero keeps the sign of x, as in engines that round by scaling (Spark's own `round` drops it)."""
    r = F.round(x, digits)
    return F.when(r == 0, x * 0.0).otherwise(r)

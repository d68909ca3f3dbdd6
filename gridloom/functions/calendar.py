"""Calendars, clock and sun as expressions: Easter, regional holidays, half-even hours, local time, solar zenith."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Holidays (month, day) and days from Easter Sunday of two regions; `orthodox`: which Easter.
REGIONS = {
    "island": {"fixed": [(1, 1), (4, 11), (4, 25), (5, 1), (6, 10), (6, 29), (7, 18), (8, 15), (10, 5), (11, 1), (12, 1), (12, 8), (12, 25)], "easter": [-2, 0], "orthodox": False},
    "mainland": {"fixed": [(1, 1), (1, 6), (3, 25), (5, 1), (8, 15), (10, 28), (12, 24), (12, 25), (12, 26), (12, 31)], "easter": [-48, -2, -1, 0, 1, 49, 50], "orthodox": True},
}
#: Further days from Easter of the island, but for these years.
ISLAND_MORE, ISLAND_NOT_IN = (36, 50, 64), (2013, 2014, 2015)


def _div(a: Column, b: int) -> Column:
    return F.floor(a / b).cast("int")


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar, by the anonymous computation."""
    a, b, c = F.pmod(year, F.lit(19)), _div(year, 100), F.pmod(year, F.lit(100))
    d, e = _div(b, 4), F.pmod(b, F.lit(4))
    g = _div(8 * b + 13, 25)
    h = F.pmod(19 * a + b - d - g + 15, F.lit(30))
    i, k = _div(c, 4), F.pmod(c, F.lit(4))
    r = F.pmod(32 + 2 * e + 2 * i - h - k, F.lit(7))
    m = _div(a + 11 * h + 19 * r, 433)
    month = _div(h + r - 7 * m + 90, 25)
    return F.make_date(year, month, F.pmod(h + r - 7 * m + 33 * month + 19, F.lit(32)))


def orthodox_easter(year: Column) -> Column:
    """Easter Sunday by the Julian computation, as a Gregorian date (1900 to 2099)."""
    d = F.pmod(19 * F.pmod(year, F.lit(19)) + 15, F.lit(30))
    e = F.pmod(2 * F.pmod(year, F.lit(4)) + 4 * F.pmod(year, F.lit(7)) - d + 34, F.lit(7))
    month = _div(d + e + 114, 31)
    return F.date_add(F.make_date(year, month, F.pmod(d + e + 114, F.lit(31)) + 1), 13)


def is_holiday(date: Column, region: str) -> Column:
    """Whether a date is one of the region's fixed or Easter-bound holidays."""
    r = REGIONS[region]
    year = F.year(date)
    sunday = orthodox_easter(year) if r["orthodox"] else easter(year)
    away = F.datediff(date, sunday)
    out = away.isin(*r["easter"])
    if region == "island":
        out = out | (away.isin(*ISLAND_MORE) & ~year.isin(*ISLAND_NOT_IN))
    for month, day in r["fixed"]:
        out = out | ((F.month(date) == month) & (F.dayofmonth(date) == day))
    return out


def special_index(date: Column, region: str) -> Column:
    """100 on holidays, 50 on Sundays, else 0."""
    return F.when(is_holiday(date, region), 100).when(F.weekday(date) == 6, 50).otherwise(0)


def half_even_hour(seconds: Column) -> Column:
    """The hour number nearest to seconds since 1970-01-01; half hours go to the even hour."""
    return F.bround(seconds / F.lit(3600.0)).cast("long")


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "ddMMyy")


def hour_key(ts: Column) -> Column:
    return F.date_format(ts, "ddMMyyHHmm")


def of_day_key(key: Column) -> Column:
    return F.try_to_timestamp(key, F.lit("ddMMyy")).cast("date")


def of_hour_key(key: Column) -> Column:
    return F.try_to_timestamp(key, F.lit("ddMMyyHHmm"))


def local_to_utc(ts: Column, zone: str) -> Column:
    """A local wall-clock time as UTC; null for the hours that the change to summer time leaves out."""
    utc = F.to_utc_timestamp(ts, zone)
    return F.when(F.from_utc_timestamp(utc, zone) == ts, utc)


def solar_zenith(hour: Column, lat: Column, lon: Column) -> Column:
    """Degrees from the zenith to the sun's centre at an hour number (UTC; fractions allowed), without refraction; good to about 0.01 degrees."""
    d = hour / 24.0 - 10957.5  # days since 2000-01-01 12:00
    g = F.radians(357.529 + 0.98560028 * d)
    q = 280.459 + 0.98564736 * d
    along = F.radians(q + 1.915 * F.sin(g) + 0.020 * F.sin(2 * g))
    tilt = F.radians(23.439 - 0.00000036 * d)
    right = F.atan2(F.cos(tilt) * F.sin(along), F.cos(along))
    up = F.asin(F.sin(tilt) * F.sin(along))
    sidereal = F.pmod(18.697374558 + 24.06570982441908 * d, F.lit(24.0))
    angle = F.radians(sidereal * 15 + lon) - right
    p = F.radians(lat)
    return F.degrees(F.acos(F.sin(p) * F.sin(up) + F.cos(p) * F.cos(up) * F.cos(angle)))

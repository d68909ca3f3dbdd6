"""Series operators: exact-time lags, neighbours, positional shifts, fills, windows and hold-outs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import halos

#: Lags of the forecasts, in hours (load) or days (gas).
LOAD_DAY_AHEAD = [*range(48, 75), *range(95, 98), 96, 120, 144, *range(166, 175), 192]
LOAD_SHORT_TERM = [*range(1, 12), *range(22, 26), *range(47, 52), *range(166, 175), 192]
LOAD_YEAR_BACK = [*range(8735, 8741), 8760, 8904]
LV_LOAD = [*range(48, 57), *range(72, 76), 216]
SCADA_LOAD = [*range(24, 52), *range(71, 75), 96, 120, 144, *range(166, 175), 192]
GAS_WEATHER = [*range(1, 9), 14, 21]
GAS_CURRENT_DAY = [*range(1, 10), 14, 15, 21, 22]
GAS_DAY_AHEAD = [*range(2, 10), 14, 15, 21, 22]
GAS_YEAR_BACK = [364, 365, 371]

#: Times in a stretch of `lag_vector`.
STRETCH = 4096


def lag_vector(series: DataFrame, time: str, lags: list[int], value: str = "y", keys: tuple[str, ...] = (), complete: bool = True, prefix: str = "lag") -> DataFrame:
    """The value at time - lag for each of `lags` (a column each, by its place in the list); with `complete`, only rows that have all.

    One shuffle serves all lags: each value goes to its stretch of time and, if a lag reaches there, to the next one, so
    at most twice however many lags there are and however long a key's series is; within a stretch every lag is a frame
    of the same sorted window. Times are whole numbers, one row for each of a key's times.
    """
    distinct = sorted(set(lags))
    reach = max([0, *distinct])
    stretch = max(STRETCH, 2 * reach)
    own = F.floor(F.col(time) / stretch)
    dealt = series.select(*keys, time, value).withColumn("__at", F.explode(F.sequence(own, F.floor((F.col(time) + reach) / stretch))))
    w = Window.partitionBy(*keys, "__at").orderBy(time)
    wide = dealt.select(*keys, time, value, "__at", *[F.max(value).over(w.rangeBetween(-l, -l)).alias(f"__{l}") for l in distinct])
    out = wide.filter(F.col("__at") == own).select(*keys, time, value, *[F.col(f"__{l}").alias(f"{prefix}_{i}") for i, l in enumerate(lags)])
    return out.dropna(subset=[f"{prefix}_{i}" for i in range(len(lags))]) if complete else out


def neighbours(series: DataFrame, time: str, value: str = "y", keys: tuple[str, ...] = (), step: int = 1) -> DataFrame:
    """The values one step before and after, by time, not by row: null in gaps. A value goes to its stretch of time, and to the next or last one if that is a step away."""
    stretch = max(STRETCH, 2 * step)
    at = lambda t: F.floor(t / stretch)
    placed = series.select(*keys, time, value).withColumn("__at", F.explode(F.sequence(at(F.col(time) - step), at(F.col(time) + step))))
    w = Window.partitionBy(*keys, "__at").orderBy(time)
    before, after = w.rangeBetween(-step, -step), w.rangeBetween(step, step)
    wide = placed.withColumns({"prev": F.max(value).over(before), "next": F.max(value).over(after)})
    return wide.filter(F.col("__at") == at(F.col(time))).drop("__at")


def row_shifts(series: DataFrame, time: str, shifts: list[int], value: str = "y", keys: tuple[str, ...] = (), also: tuple[str, ...] = ()) -> DataFrame:
    """Positional shifts: row n takes the value of row n - shift; `also`: further columns to keep."""
    placed, size = halos.dealt(halos.numbered(series.select(*keys, time, value, *also), time, keys), max([0, *map(abs, shifts)]))
    w = halos.over(keys)
    names = {f"shift_{'m' if s < 0 else ''}{abs(s)}": (F.lag(value, s) if s >= 0 else F.lead(value, -s)).over(w) for s in shifts}
    return placed.withColumns(names).filter(halos.home(size)).select(*keys, time, value, *also, *names)


def backfill(df: DataFrame, time: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """The next value that isn't null."""
    return halos.next_known(df, time, value, keys)


def smooth(df: DataFrame, time: str, value: str, half: int, keys: tuple[str, ...] = (), kind: str = "hanning") -> DataFrame:
    """Weighted mean (hanning or flat) of the rows up to `half` away; beyond an end the series is reflected at its last row."""
    import math

    weight = {k: 0.5 + 0.5 * math.cos(math.pi * k / (half + 1)) if kind == "hanning" else 1.0 for k in range(-half, half + 1)}
    placed, size = halos.dealt(halos.numbered(df, time, keys, total=True), half)
    r, n = F.col(halos.R), F.col(halos.N)
    near = F.collect_list(F.struct(F.col(value).alias("v"))).over(halos.over(keys).rowsBetween(-half, half))  # 2 * half + 1 values, nulls in place
    first = F.greatest(r - half, F.lit(1))
    total = F.lit(0.0)
    for k, x in weight.items():
        at = r + k
        at = F.when(at < 1, 2 - at).when(at > n, 2 * n - at).otherwise(at)
        total = total + F.get("__near", (at - first).cast("int"))["v"] * x
    wide = placed.withColumn("__near", near).filter(halos.home(size))
    return wide.withColumn("smooth", total / sum(weight.values())).select(*df.columns, "smooth")


def day_extrema(hourly: DataFrame, hour: str = "hour", value: str = "y") -> DataFrame:
    """Each hour's mean over the sites, with the day's highest and lowest such mean."""
    means = hourly.groupBy(hour).agg(F.avg(value).alias("mean"))
    w = Window.partitionBy(F.floor(F.col(hour) / 24))
    return means.select(hour, "mean", F.max("mean").over(w).alias("day_max"), F.min("mean").over(w).alias("day_min"))


def chronological_split(df: DataFrame, time: str, rate: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """split: test for all rows after the earliest of the keys' split times; each key splits at its row round(n * (1 - rate)) + 1, counted from 0."""
    placed = halos.numbered(df.select(*keys, time), time, keys, total=True)
    r, n = F.col(halos.R) - 1, F.col(halos.N)
    cut = placed.filter(r == F.least(F.bround(n * (1 - rate)) + 1, n - 1)).agg(F.min(time).alias("__cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("split", F.when(F.col(time) > F.col("__cut"), "test").otherwise("train")).drop("__cut")  # one row


def shrinking_split(df: DataFrame, time: str, keys: tuple[str, ...], rate: float = 0.25, step: float = 0.025, least: float = 0.1, most: float = 0.4) -> DataFrame:
    """`chronological_split` at the largest rate, from `rate` down by `step`, whose test part is `most` of the rows or less (at `least` whatever it is): one count a rate, seven at most."""
    while True:
        out = chronological_split(df, time, rate, keys)
        share = out.agg(F.avg((F.col("split") == "test").cast("double"))).collect()[0][0] or 0.0
        if share <= most or rate - step < least - 1e-9:
            return out
        rate -= step


def contiguous_holdout(df: DataFrame, time: str, share: float, start: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """test: a block of int(n * share) + 1 rows from the row int(n * start)."""
    placed = halos.numbered(df, time, keys, total=True)
    r, n = F.col(halos.R) - 1, F.col(halos.N)
    first = F.floor(n * start)
    return placed.withColumn("test", (r >= first) & (r <= first + F.floor(n * share))).select(*df.columns, "test")


def days_of(hours: DataFrame, run: str = "run_day", first: int = 24, last: int = 47) -> DataFrame:
    """A row for each valid hour of a weather run: first to last hours after the run's day begins."""
    return hours.withColumn("hour", F.explode(F.sequence(F.col(run) * 24 + first, F.col(run) * 24 + last)))

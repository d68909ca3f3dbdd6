"""Weather operators beyond the stencil: repair, resizing, run selection, time steps, days, areas and daylight. Cells are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import nearest_grid_line, wind_direction, wind_speed


def area_box(lat: Column, lon: Column, resolution: float) -> tuple[Column, Column, Column, Column]:
    """Least and most latitude and longitude: the nearest grid lines and so many cells around them: 4 of a fine grid (0.05, lines through one decimal), else 2 (through whole degrees)."""
    fine = abs(resolution - 0.05) < 1e-9
    levels, digits = (4, 1) if fine else (2, 0)
    y, x = nearest_grid_line(lat, resolution, digits), nearest_grid_line(lon, resolution, digits)
    reach = levels * resolution
    return y - reach, y + reach, x - reach, x + reach


def repaired(cells: DataFrame, area: tuple[float, float], resolution: float) -> DataFrame:
    """Cells as the rest expects them: a missing lat or lon is made from the area's corner and the place, wind speed and direction from their parts, and a temperature of another name is renamed."""
    out = cells.withColumnRenamed("Temp", "Temperature") if "Temp" in cells.columns else cells
    have = set(out.columns)
    lat = F.lit(area[0]) + F.col("i") * resolution
    lon = F.lit(area[1]) + F.col("j") * resolution
    out = out.withColumns({"lat": F.coalesce("lat", lat) if "lat" in have else lat, "lon": F.coalesce("lon", lon) if "lon" in have else lon})
    if {"Uwind", "Vwind"} <= have:
        ws, wd = wind_speed(F.col("Uwind"), F.col("Vwind")), wind_direction(F.col("Uwind"), F.col("Vwind"))
        out = out.withColumns({"WS": F.coalesce("WS", ws) if "WS" in have else ws, "WD": F.coalesce("WD", wd) if "WD" in have else wd})
    return out


def resized(cells: DataFrame, keys: list[str], value: str, rows: int, cols: int) -> DataFrame:
    """Bilinear values on a rows x cols grid over the same unit square; each new cell is the weighted sum of four old ones, by an equi-join on the old place."""
    size = cells.groupBy(*keys).agg((F.max("i") + 1).alias("__h"), (F.max("j") + 1).alias("__w"))
    new = size.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    y = F.col("i") * (F.col("__h") - 1) / max(1, rows - 1)
    x = F.col("j") * (F.col("__w") - 1) / max(1, cols - 1)
    new = new.withColumns({"__y": y, "__x": x})
    y0, x0 = F.least(F.floor("__y"), F.greatest(F.col("__h") - 2, F.lit(0))), F.least(F.floor("__x"), F.greatest(F.col("__w") - 2, F.lit(0)))
    new = new.withColumns({"__y0": y0.cast("int"), "__x0": x0.cast("int")})
    fy, fx = F.col("__y") - F.col("__y0"), F.col("__x") - F.col("__x0")
    corner = lambda dy, dx, w: F.struct((F.col("__y0") + dy).alias("i0"), (F.col("__x0") + dx).alias("j0"), w.alias("w"))
    corners = F.array(corner(0, 0, (1 - fy) * (1 - fx)), corner(0, 1, (1 - fy) * fx), corner(1, 0, fy * (1 - fx)), corner(1, 1, fy * fx))
    asked = new.select(*keys, "i", "j", F.inline(corners)).filter("w > 0")
    old = cells.select(*keys, F.col("i").cast("int").alias("i0"), F.col("j").cast("int").alias("j0"), F.col(value).alias("__v"))
    return asked.join(old, [*keys, "i0", "j0"]).groupBy(*keys, "i", "j").agg(F.sum(F.col("w") * F.col("__v")).alias(value))


def with_all_steps(cells: DataFrame, hour: str, variables: list[str]) -> DataFrame:
    """Hours for which some cell of the hour, the one before or the one after has every variable; others are passed over."""
    there = cells.groupBy(hour).agg(*[F.max(F.col(v).isNotNull()).alias(v) for v in variables])
    near = there.select(F.explode(F.array(F.col(hour) - 1, F.col(hour), F.col(hour) + 1)).alias(hour), *variables)
    good = near.groupBy(hour).agg(*[F.max(v).alias(v) for v in variables])
    every = F.lit(True)
    for v in variables:
        every = every & F.col(v)
    return cells.join(good.filter(every).select(hour), hour, "left_semi")


def step_means(cells: DataFrame, keys: list[str], hour: str, value: str) -> DataFrame:
    """Mean, 10th and 90th percentile of an area at each hour, and the means one hour before and after (null in gaps): one aggregate of the cells, then a window over hours."""
    p = F.percentile(value, F.array(F.lit(0.1), F.lit(0.9)))
    means = cells.groupBy(*keys, hour).agg(F.avg(value).alias("mean"), p.alias("p"))
    w = Window.partitionBy(*keys).orderBy(hour)
    return means.select(*keys, hour, "mean", F.col("p")[0].alias("p10"), F.col("p")[1].alias("p90"), F.max("mean").over(w.rangeBetween(-1, -1)).alias("prev"), F.max("mean").over(w.rangeBetween(1, 1)).alias("next"))


def runs_for(hours: DataFrame, day_ahead: bool, hour: str = "hour") -> DataFrame:
    """hour and run_day: the weather run that an hour is forecast by: day-ahead, the day before the hour's day (hours 24 to 47 of a run); else the run that began 1 to 24 hours ago."""
    run = F.floor(F.col(hour) / 24) - 1 if day_ahead else F.floor((F.col(hour) - 1) / 24)
    return hours.select(hour, run.alias("run_day")).distinct()


def daily(cells: DataFrame, hour: str, values: list[str], temperature: str) -> DataFrame:
    """Means of each day, and its highest and lowest temperature, at the day after (the day that they forecast)."""
    day = (F.floor(F.col(hour) / 24) + 1).alias("day")
    return cells.groupBy(day).agg(*[F.avg(v).alias(v) for v in values], F.max(temperature).alias("temp_max"), F.min(temperature).alias("temp_min"))


def rolled_up(wide: DataFrame, variables: dict[str, list[str]]) -> DataFrame:
    """wide with a column for each variable: the mean of its columns that have a value. Earlier and later hours keep their own columns."""
    out = {}
    for name, cols in variables.items():
        total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in cols), F.lit(0.0))
        there = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
        out[name] = F.try_divide(total, there)
    return wide.withColumns(out)


def columns_with(df: DataFrame, part: str) -> list[str]:
    """Columns whose names hold `part`, whatever the case."""
    return [c for c in df.columns if part.lower() in c.lower()]


def mean_of_matching(df: DataFrame, part: str, name: str) -> DataFrame:
    """The mean of all columns whose names hold `part`; also what stands in for a variable that a rule names and the data lack."""
    return df if name in df.columns else rolled_up(df, {name: columns_with(df, part)})


def in_daylight(df: DataFrame, flux: str, least: float = 1e-8) -> DataFrame:
    return df.filter(F.col(flux) > least)


def night_as_zero(index: DataFrame, pred: DataFrame, keys: list[str], value: str = "y_hat") -> DataFrame:
    """Forecasts on the whole index, 0 where the night was left out."""
    return index.select(*keys).join(pred.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(0.0)))

"""Streaming: requests scored in micro-batches, watermarked windows, recursive short-term forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(stream: DataFrame, ts: str, key: str, value: str, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Sums by event-time window; rows later than `late` are left out."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.sum(value).alias("y"), F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), key, "y", "n")


def scored(stream: DataFrame, fits: DataFrame, on: list[str], x: str) -> DataFrame:
    """Requests with the forecast of the latest fits: a stream-static join."""
    return stream.join(fits, on).withColumn("y_hat", F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * F.col(x)))


def answer(stream: DataFrame, path: str, checkpoint: str):
    """Write answers as JSON, exactly once by the sink's log, over what has arrived."""
    return stream.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def recursive(series: DataFrame, fits: DataFrame, start: int, steps: int, keys: list[str], time: str = "hour", y: str = "y") -> DataFrame:
    """Forecasts of `steps` times after `start` from the value one step before, each fed back as the next one's lag.

    With a linear fit the recursion y(t + 1) = a + b y(t) has a closed form, so all steps are one projection, not a loop of joins.
    """
    last = series.filter(F.col(time) == start).select(*keys, F.col(y).alias("y0")).join(fits, keys)
    b, n = F.col("slope"), F.col("step")
    power = F.pow(b, n)
    grown = F.when(b == 1, n.cast("double")).otherwise((1 - power) / (1 - b))
    steps_of = last.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return steps_of.select(*keys, (F.lit(start).cast("long") + n).alias(time), "step", (power * F.col("y0") + grown * F.col("intercept")).alias("y_hat"))

"""Combination of forecasts: averages, Bayesian (BCP) weights, recursive least squares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def average(pred: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of the forecasts that there are."""
    return pred.groupBy(*keys).agg(F.avg("y_hat").alias("y_hat"))


def blended(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The mean of several combinations' forecasts where they have one; not below zero."""
    both = parts[0].select(*keys, "y_hat")
    for p in parts[1:]:
        both = both.union(p.select(*keys, "y_hat"))
    return both.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.avg("y_hat")).alias("y_hat"))


def bcp_weights(pred: DataFrame, keys: list[str], method: str = "method") -> DataFrame:
    """Bayesian weights of methods without gaps, in closed form: softmax of -sum (y - y_hat)^2 / (2 pi sigma^2), sigma the population deviation of the residual. A method without deviation has no weight."""
    e = F.col("y") - F.col("y_hat")
    stats = pred.groupBy(*keys, method).agg(F.sum(e * e).alias("s"), F.stddev_pop(e).alias("sd"))
    stats = stats.withColumn("log_w", -F.try_divide("s", 2 * F.pi() * F.col("sd") * F.col("sd")))
    w = Window.partitionBy(*keys)
    stats = stats.withColumn("raw", F.coalesce(F.exp(F.col("log_w") - F.max("log_w").over(w)), F.lit(0.0)))
    return stats.select(*keys, method, F.try_divide(F.col("raw"), F.sum("raw").over(w)).alias("weight"))


def bcp_masked(pred: DataFrame, keys: list[str], method: str = "method") -> DataFrame:
    """Bayesian weights of methods with gaps: a method's mean exponent over the rows that it has stands for those that it hasn't, so gaps neither help nor harm it."""
    e = F.col("y") - F.col("y_hat")
    there = pred.filter(e.isNotNull())
    stats = there.groupBy(*keys, method).agg(F.avg(e * e).alias("s"), F.stddev_pop(e).alias("sd"))
    n = there.groupBy(*keys, method).count().groupBy(*keys).agg(F.max("count").alias("n"))
    stats = stats.join(n, keys).withColumn("log_w", -F.try_divide(F.col("s") * F.col("n"), 2 * F.pi() * F.col("sd") * F.col("sd")))
    w = Window.partitionBy(*keys)
    stats = stats.withColumn("raw", F.coalesce(F.exp(F.col("log_w") - F.max("log_w").over(w)), F.lit(0.0)))
    return stats.select(*keys, method, F.try_divide(F.col("raw"), F.sum("raw").over(w)).alias("weight"))


def project_forecasts(pred: DataFrame, weights: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """average and bcp forecasts side by side: the mean of what there is, and the weighted mean with weights scaled over what there is; neither below zero."""
    j = pred.join(weights, on, "left")
    there = F.col("y_hat").isNotNull()
    mass = F.sum(F.when(there, F.coalesce("weight", F.lit(0.0))))
    return j.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.avg("y_hat")).alias("average"), F.greatest(F.lit(0.0), F.try_divide(F.sum(F.col("y_hat") * F.coalesce("weight", F.lit(0.0))), mass)).alias("bcp"))


def weighted(pred: DataFrame, weights: DataFrame, keys: list[str], on: list[str]) -> DataFrame:
    """Weighted mean over the forecasts that there are, the weights scaled to sum to one; not below zero."""
    j = pred.join(weights, on)
    present = F.when(F.col("y_hat").isNotNull(), F.col("weight"))
    return j.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.try_divide(F.sum(F.col("y_hat") * F.col("weight")), F.sum(present))).alias("y_hat"))


def rls_weights(wide: DataFrame, key: str, time: str, methods: list[str], passes: int = 3, rows: int = 7001) -> DataFrame:
    """Recursive least squares weights on the simplex, by key: order matters, so each key is one ordered group of at most `rows` latest rows a pass (the operator's own limit). The forgetting factor is 0.75 + 0.249 f, f the share of the scaled squared errors so far that are below chi-square draws, which are seeded by the key."""
    import zlib

    import pandas as pd

    latest = Window.partitionBy(key).orderBy(F.desc(time))
    recent = wide.select(key, time, "y", *methods).dropna().withColumn("__r", F.row_number().over(latest)).filter(F.col("__r") <= rows).drop("__r")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        g = group.sort_values(time)
        x, y = g[methods].to_numpy(float), g["y"].to_numpy(float)
        w, p = np.full(len(methods), 1 / len(methods)), np.eye(len(methods)) * 1e-4
        rng = np.random.default_rng(zlib.crc32(str(g[key].iloc[0]).encode()))
        scaled, n, mean, squares = np.empty(passes * len(y)), 0, 0.0, 0.0
        for _ in range(passes):
            for a, b in zip(x, y, strict=True):
                e, spread = b - a @ w, a @ p @ a
                var = squares / n if n else 1.0
                scaled[n] = e * e * spread / (var * (1 + spread)) if var > 0 else np.inf
                n += 1
                forget = 0.75 + 0.249 * np.mean(rng.chisquare(len(methods), n) > scaled[:n])
                gain = p @ a / (forget + spread)
                w = w + gain * e
                p = (p - np.outer(gain, a @ p)) / forget
                # running variance of the errors
                off = e - mean
                mean += off / n
                squares += off * (e - mean)
                w = np.maximum(w, 0)
                w = w / w.sum() if w.sum() > 0 else np.full(len(methods), 1 / len(methods))
        return pd.DataFrame({key: g[key].iloc[0], "method": methods, "weight": w})

    kind = dict(wide.dtypes)[key]
    return recent.groupBy(key).applyInPandas(fit, f"{key} {kind}, method string, weight double")

"""Search helpers: task grids, Pareto fronts, acquisition values, spaces and test functions."""

from __future__ import annotations

import math
from collections.abc import Callable
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranks import bounds_of, range_of


def task_grid(spark: SparkSession, projects: list[str], rules: list[str], params: dict[str, list], devices: int = 2) -> DataFrame:
    """project, rule, trial, device and each parameter: all combinations, devices in turn."""
    names = sorted(params)
    rows = [(p, r, t, t % devices, *map(float, c)) for p in projects for r in rules for t, c in enumerate(product(*(params[n] for n in names)))]
    return spark.createDataFrame(rows, "project string, rule string, trial int, device int" + "".join(f", {n} double" for n in names))


def second_stage(trials: DataFrame, steps: dict[str, float], score: str = "acc", devices: int = 2) -> DataFrame:
    """The tasks after a first stage: around each (project, rule)'s best trial, every parameter of `steps` one step down, as it is and one step up; devices in turn. trials: project, rule, the parameters, score."""
    names = sorted(steps)
    best = trials.groupBy("project", "rule").agg(F.min_by(F.struct(*names), F.struct(score, *names)).alias("b")).select("project", "rule", "b.*")
    for n in names:
        best = best.withColumn(n, F.explode(F.array(F.col(n) - steps[n], F.col(n) * 1.0, F.col(n) + steps[n])))
    w = Window.partitionBy("project", "rule").orderBy(*names)  # three to the number of parameters
    return best.withColumn("trial", F.row_number().over(w) - 1).withColumn("device", F.col("trial") % devices)


def pareto_front(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows that none beats in one of two costs without losing in the other: by the best b among smaller a, not by pairs; least values of whole ranges first, then within a range."""
    best = df.groupBy(a).agg(F.min(b).alias("__b")).withColumn("__part", range_of(F.col(a).cast("double"), bounds_of(df, a)))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    lows = best.groupBy("__part").agg(F.min("__b").alias("__low"))
    lows = lows.select("__part", F.min("__low").over(earlier).alias("__before"))
    within = Window.partitionBy("__part").orderBy(a).rowsBetween(Window.unboundedPreceding, -1)
    front = best.withColumn("__own", F.min("__b").over(within)).join(F.broadcast(lows), "__part").withColumn("__least", F.least("__own", "__before")).filter("__least IS NULL OR __b < __least")
    return df.join(front.select(a, F.col("__b").alias(b)), [a, b], "left_semi")


def normal_cdf(z: Column) -> Column:
    """Rational approximation of the normal distribution, good to 7.5e-8, so that it stays in generated code."""
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - upper).otherwise(upper)


def acquisition(kind: str, mean: Column, std: Column, best: float, xi: float = 0.01, kappa: float = 1.96) -> Column:
    """lcb (smaller is better), pi or ei (larger is better) of minimised values."""
    if kind == "lcb":
        return mean - kappa * std
    z = F.try_divide(best - xi - mean, std)
    value = normal_cdf(z) if kind == "pi" else (best - xi - mean) * normal_cdf(z) + std * F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return F.when(std > 0, value).otherwise(0.0)


def branin(x: float, y: float) -> float:
    """The Branin function; its least value is 0.397887."""
    b, c, t = 5.1 / (4 * math.pi**2), 5 / math.pi, 1 / (8 * math.pi)
    return (y - b * x * x + c * x - 6) ** 2 + 10 * (1 - t) * math.cos(x) + 10


def halton(n: int, base: int) -> float:
    out, f = 0.0, 1.0
    while n:
        f /= base
        out, n = out + f * (n % base), n // base
    return out


def minimise(spark: SparkSession, cost: Callable[..., float], bounds: list[tuple[float, float]], calls: int = 64, rounds: int = 6) -> tuple[list[float], float]:
    """Driver-side search whose candidates are scored as one Spark job a round: a low-discrepancy box that shrinks around the best point."""
    primes = (2, 3, 5, 7, 11, 13)
    box, best = list(bounds), ([], math.inf)
    for r in range(rounds):
        points = [[lo + (hi - lo) * halton(r * calls + k + 1, primes[d]) for d, (lo, hi) in enumerate(box)] for k in range(calls)]
        rows = spark.createDataFrame([(p,) for p in points], "p array<double>").repartition(4)
        scored = rows.mapInPandas(lambda it: (g.assign(cost=[float(cost(*p)) for p in g["p"]]) for g in it), "p array<double>, cost double")
        top = scored.orderBy("cost", "p").limit(1).collect()[0]
        if top.cost < best[1]:
            best = (list(top.p), top.cost)
        box = [(max(lo, c - (hi - lo) / 6), min(hi, c + (hi - lo) / 6)) for (lo, hi), c in zip(bounds if r == 0 else box, best[0], strict=True)]
    return best

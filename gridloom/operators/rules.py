"""Soft rules: membership functions, activations, per-rule partitions, regressions and their combination."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import activation, gauss, trapezoid

ACTIVE = 0.01


@dataclass(frozen=True)
class Membership:
    """One membership function of a variable; kind: gauss (mean, sigma) or trap (four corners, sorted when used)."""

    variable: str
    kind: str
    params: tuple[float, ...]

    def column(self) -> Column:
        x = F.col(self.variable)
        return gauss(x, *self.params) if self.kind == "gauss" else trapezoid(x, *sorted(self.params))


def initial_memberships(variable: str, n: int, kind: str = "gauss") -> list[Membership]:
    """n functions spread over [-0.005, 1.005]; gauss widths 1.25 * 1.005 / n, trapezoid tops of half-width 1.125 * 1.005 / n."""
    step = 1.01 / (n - 1) if n > 1 else 0.0
    means = [-0.005 + k * step for k in range(n)]
    wide, top = 1.25 * 1.005 / n, 1.125 * 1.005 / n
    if kind == "gauss":
        return [Membership(variable, kind, (m, wide)) for m in means]
    return [Membership(variable, kind, (m - wide, m - top, m + top, m + wide)) for m in means]


def rule_base(variables: dict[str, list[Membership]]) -> dict[str, list[Membership]]:
    """rule.N: every combination of one function of each variable."""
    return {f"rule.{n}": list(c) for n, c in enumerate(product(*variables.values()))}


def with_activations(df: DataFrame, rules: dict[str, list[Membership]], p: float | None = None) -> DataFrame:
    """activations: an array of (rule, act), a projection in generated code; p defaults to the number of variables + 1."""
    made = [F.struct(F.lit(name).alias("rule"), activation([m.column() for m in fs], p or len(fs) + 1).alias("act")) for name, fs in rules.items()]
    return df.withColumn("activations", F.array(*made))


def partitioned(df: DataFrame, rules: dict[str, list[Membership]], threshold: float = ACTIVE, p: float | None = None) -> DataFrame:
    """A row for each row and active rule: rule, act. No cross join: the rules are columns first."""
    exploded = with_activations(df, rules, p).withColumn("a", F.explode("activations"))
    return exploded.select(*df.columns, F.col("a.rule").alias("rule"), F.col("a.act").alias("act")).filter(F.col("act") >= threshold)


def rescued(df: DataFrame, rules: dict[str, list[Membership]], threshold: float = ACTIVE, floor: float = 0.1) -> DataFrame:
    """As `partitioned`, but a row without an active rule goes to its nearest one with activation `floor`."""
    acts = with_activations(df, rules)
    best = F.array_max(F.transform("activations", lambda a: F.struct(a["act"].alias("act"), a["rule"].alias("rule"))))
    active = F.filter("activations", lambda a: a["act"] >= threshold)
    lone = F.array(F.struct(best["rule"].alias("rule"), F.lit(floor).alias("act")))
    return acts.withColumn("a", F.explode(F.when(F.size(active) > 0, active).otherwise(lone))).select(*df.columns, F.col("a.rule").alias("rule"), F.col("a.act").alias("act"))


def rescue_count(df: DataFrame, rules: dict[str, list[Membership]], most: int = 50, threshold: float = ACTIVE) -> int:
    """How many rows have no active rule; more than `most` are an error, as the rule base doesn't fit the data then."""
    lone = with_activations(df, rules).filter(~F.exists("activations", lambda a: a["act"] >= threshold)).count()
    if lone > most:
        raise ValueError(f"{lone} rows have no active rule")
    return lone


def regressions(train: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """slope and intercept of y on x for each key; the sums are pre-aggregated."""
    return train.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.count(F.lit(1)).alias("n_train"))


def rule_forecast(test: DataFrame, fits: DataFrame, keys: list[str], on: list[str], x: str) -> DataFrame:
    """Mean over the active rules' forecasts, not below zero."""
    joined = test.join(fits, on)
    each = joined.withColumn("y_hat", F.greatest(F.lit(0.0), F.col("intercept") + F.col("slope") * F.col(x)))
    return each.groupBy(*keys).agg(F.avg("y_hat").alias("y_hat"), F.first("y").alias("y"))


def covering(parts: DataFrame, key: str, rule: str) -> DataFrame:
    """Rules that can go: every row that they cover is covered by another rule too."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    lone = parts.withColumn("n", n).groupBy(rule).agg(F.sum((F.col("n") == 1).cast("int")).alias("alone"), F.count(F.lit(1)).alias("rows"))
    return lone.withColumn("removable", F.col("alone") == 0)

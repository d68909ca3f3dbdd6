"""Evolutionary search: populations scored as one Spark job a generation, with one or two costs, and the rule-base objective."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .rules import ACTIVE, Membership, partitioned

#: Trapezoids of the forecast horizon, in hours.
HORIZONS = [[0.5, 0.9, 1.1, 1.5], [1.5, 1.9, 2.1, 2.5], [2.5, 2.9, 3.1, 3.5], [3.5, 3.9, 4.1, 4.5], [4.5, 4.9, 5.1, 5.5], [5.5, 5.9, 6.1, 6.5], [6.5, 6.9, 7.1, 7.5], [7.5, 7.9, 8.1, 8.5], [8.5, 8.9, 12.1, 15.5], [12, 13.2, 22.1, 27.5], [22.1, 25.2, 36.1, 42.5], [38.1, 42.2, 48.1, 52.5]]
#: The forecast of a row without an active rule.
NONE_ACTIVE = 1e15


@dataclass
class Settings:
    """Of a search: sizes, generations, and the shares of crossed and changed children."""

    parents: int = 75
    children: int = 100
    generations: int = 20
    cross: float = 0.5
    change: float = 0.4
    tournament: int = 4
    seed: int = 0


def dominated(costs: np.ndarray) -> np.ndarray:
    """How many others beat each row in no cost worse and one better."""
    a, b = costs[:, None], costs[None]
    return ((b <= a).all(-1) & (b < a).any(-1)).sum(1)


def crossed(rng, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two-point exchange, or a blend up to half beyond both."""
    if rng.random() < 0.5 and len(a) > 2:
        i, j = sorted(rng.integers(0, len(a), 2))
        out = a.copy()
        out[i : j + 1] = b[i : j + 1]
        return out
    g = 2 * rng.random(len(a)) - 0.5
    return (1 - g) * a + g * b


def changed(rng, a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Gaussian steps, or polynomial ones, in about a third of the places."""
    at = rng.random(len(a)) < 0.3
    if rng.random() < 0.5:
        move = rng.normal(0, 0.1, len(a))
    else:
        u = rng.random(len(a))
        move = np.where(u < 0.5, (2 * u) ** (1 / 21) - 1, 1 - (2 * (1 - u)) ** (1 / 21))
    return a + at * move * (high - low)


def search(score: Callable[[list[list[float]]], list[tuple[float, ...]]], low: list[float], high: list[float], settings: Settings | None = None, start: list[list[float]] | None = None) -> tuple[list[list[float]], list[tuple[float, ...]]]:
    """The front of points that no other beats, and their costs. `score` takes a whole generation; what was scored is remembered. The best go on unchanged."""
    s = settings or Settings()
    rng = np.random.default_rng(s.seed)
    lo, hi = np.array(low, float), np.array(high, float)
    known: dict[bytes, tuple[float, ...]] = {}

    def costs(points: list[np.ndarray]) -> np.ndarray:
        new = {p.tobytes(): p for p in points if p.tobytes() not in known}
        if new:
            known.update(zip(new, score([p.tolist() for p in new.values()]), strict=True))
        return np.array([known[p.tobytes()] for p in points], float)

    pool = [np.clip(np.array(p, float), lo, hi) for p in (start or [])]
    pool += [lo + rng.random(len(lo)) * (hi - lo) for _ in range(s.parents - len(pool))]
    cost = costs(pool)
    for _ in range(s.generations):
        rank = dominated(cost)
        pick = lambda rank=rank: min(rng.integers(0, len(pool), s.tournament), key=lambda i: (rank[i], cost[i].sum()))
        made = []
        for _ in range(s.children):
            u, a = rng.random(), pool[pick()]
            made.append(np.clip(crossed(rng, a, pool[pick()]) if u < s.cross else changed(rng, a, lo, hi) if u < s.cross + s.change else a, lo, hi))
        pool, cost = pool + made, np.vstack([cost, costs(made)])
        keep = np.lexsort((cost.sum(1), dominated(cost)))[: s.parents]
        pool, cost = [pool[i] for i in keep], cost[keep]
    front = np.flatnonzero(dominated(cost) == 0)
    return [pool[i].tolist() for i in front], [tuple(cost[i].tolist()) for i in front]


def scored_on(spark: SparkSession, f: Callable[..., float | tuple]) -> Callable[[list[list[float]]], list[tuple[float, ...]]]:
    """A generation scored by f as one job."""

    def run(points: list[list[float]]) -> list[tuple[float, ...]]:
        rows = spark.createDataFrame(list(enumerate(points)), "n long, p array<double>").repartition(max(1, min(len(points), spark.sparkContext.defaultParallelism)))
        one = lambda p: [float(c) for c in np.atleast_1d(f(*p))]
        got = rows.mapInPandas(lambda it: (g.assign(cost=[one(p) for p in g["p"]])[["n", "cost"]] for g in it), "n long, cost array<double>").collect()
        return [tuple(r.cost) for r in sorted(got, key=lambda r: r.n)]

    return run


def with_params(rules: dict[str, list[Membership]], params: list[float]) -> dict[str, list[Membership]]:
    """The rule base with its functions' parameters in order of the rules' names: two for each gauss (its width as given, taken without sign), four, sorted, for each trapezoid."""
    out, k = {}, 0
    for name in sorted(rules):
        fs = []
        for f in rules[name]:
            n = 2 if f.kind == "gauss" else 4
            p = params[k : k + n]
            fs.append(Membership(f.variable, f.kind, (p[0], max(abs(p[1]), 1e-9)) if f.kind == "gauss" else tuple(sorted(p))))
            k += n
        out[name] = fs
    return out


def rule_objectives(train: DataFrame, test: DataFrame, rules: dict[str, list[Membership]], features: list[str], y: str, key: list[str], rated: float, least: int = 500, share: float = 0.33) -> tuple[float, float]:
    """(sum of squares, mean size) of the scaled errors on test rows: each rule with more than `least` rows and less than `share` of all has a linear model of all features; a row's forecast is the mean of its active rules', or NONE_ACTIVE."""
    from . import rulebase

    return rulebase.Problem(train, test, rules, features, y, rated, least, share).score([rulebase.start_of(rules)])[0]


def pruned(train: DataFrame, rules: dict[str, list[Membership]], key: list[str], least: int = 500, share: float = 0.4) -> dict[str, list[Membership]]:
    """The rules without those of too few or too many rows, as long as all rows stay covered; a rule that alone covers rows can't go, which is an error."""
    n = train.count()
    active = partitioned(train, rules, ACTIVE).select(*key, "rule")
    counts = {r.rule: r["count"] for r in active.groupBy("rule").count().collect()}
    left = dict(rules)
    for rule in sorted(rules):
        if least < counts.get(rule, 0) < share * n:
            continue
        others = active.filter(F.col("rule").isin([r for r in left if r != rule])).select(*key).distinct()
        if active.filter(F.col("rule") == rule).join(others, key, "left_anti").isEmpty():
            del left[rule]
        else:
            raise ValueError(f"{rule} can't be removed")
    return left


def with_horizons(rules: dict[str, list[Membership]]) -> dict[str, list[Membership]]:
    """Every rule at every horizon."""
    return {f"rule.{n}": [*fs, Membership("horizon", "trap", tuple(map(float, p)))] for n, (p, fs) in enumerate((p, fs) for p in HORIZONS for fs in rules.values())}


def optimised_rules(train: DataFrame, test: DataFrame, rules: dict[str, list[Membership]], features: list[str], y: str, key: list[str], rated: float, settings: Settings | None = None, least: int = 500, share: float = 0.33) -> dict[str, list[Membership]]:
    """The rule base whose functions' parameters are the front's point of least mean error."""
    from . import rulebase

    start = [p for name in sorted(rules) for f in rules[name] for p in f.params]
    kinds = [f.kind for name in sorted(rules) for f in rules[name] for _ in f.params]
    low, high = [p - 0.3 for p in start], [p + 0.3 for p in start]
    low = [0.01 if k == "gauss" and i % 2 else v for i, (k, v) in enumerate(zip(kinds, low, strict=True))] if set(kinds) == {"gauss"} else low
    score = rulebase.Problem(train, test, rules, features, y, rated, least, share).score  # a generation is a pass over the training rows and one over the test rows
    points, costs = search(score, low, high, settings, [start])
    return with_params(rules, min(zip(points, costs, strict=True), key=lambda pc: pc[1][1])[0])

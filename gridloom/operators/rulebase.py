"""Search for a rule base's parameters: a whole generation costs one pass over the training rows and one over the test rows.

Every individual gives each membership function its own parameters, so each has its own active rows by rule. A task
works out all activations of its rows in blocks, and adds up, by individual and rule, the products of (1, features, y)
over the active rows; these sums (individuals x rules x features squared, whatever the number of rows) give all linear
models. The second pass forecasts a row by the mean of its active rules' models, and adds up the errors by individual.
The number of jobs doesn't depend on the number of individuals or rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evolve import NONE_ACTIVE, Settings, dominated, with_params
from .rules import ACTIVE, Membership

#: Rows whose activations a task holds at once, for all individuals.
BLOCK_ROWS = 512
#: Share of a step that polynomial changes concentrate near: the larger, the smaller the steps.
ETA = 0.8
BLEND = 0.5

Rules = dict[str, list[Membership]]


def start_of(rules: Rules) -> list[float]:
    """The functions' parameters in order of the rules' names: an individual of `with_params`."""
    return [float(p) for name in sorted(rules) for f in rules[name] for p in f.params]


def bounds(rules: Rules, ranges: dict[str, tuple[float, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest parameters, and the spread of their steps: a function stays within its spread of where it began, and within its variable's range and a spread more."""
    low, high, spread = [], [], []
    for name in sorted(rules):
        for f in rules[name]:
            least, most = ranges[f.variable]
            p = sorted(f.params) if f.kind == "trap" else list(f.params)
            s = 2 * abs(p[1]) if f.kind == "gauss" else (p[3] - p[0]) / 2
            lo, hi = max(p[0] - s, least - s), min((p[0] if f.kind == "gauss" else p[3]) + s, most + s)
            low += [lo, 1e-4] if f.kind == "gauss" else [lo] * 4
            high += [hi, s] if f.kind == "gauss" else [hi] * 4
            spread += [s] * len(p)
    return np.array(low), np.array(high), np.array(spread)


@dataclass
class Layout:
    """The rules by name, each function as (variable, kind, place of its parameters in an individual)."""

    names: list[str]
    functions: list[list[tuple[str, str, int]]]

    @classmethod
    def of(cls, rules: Rules) -> Layout:
        names, functions, k = sorted(rules), [], 0
        for name in names:
            own = []
            for f in rules[name]:
                own.append((f.variable, f.kind, k))
                k += len(f.params)
            functions.append(own)
        return cls(names, functions)

    @property
    def variables(self) -> list[str]:
        return sorted({v for own in self.functions for v, _, _ in own})

    def active(self, rule: int, population: np.ndarray, at: dict[str, np.ndarray], threshold: float, power: float | None) -> np.ndarray:
        """Whether each individual's rule is active at each row."""
        act = 1.0
        for v, kind, k in self.functions[rule]:
            act = act * membership(kind, at[v], population[:, k : k + (2 if kind == "gauss" else 4)])
        return np.power(act, 1.0 / (power or len(self.functions[rule]) + 1)) >= threshold


def membership(kind: str, x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Individuals by rows: a gauss of (mean, width) or a trapezoid of four corners in any order."""
    x = x[None]
    if kind == "gauss":
        m, s = p[:, :1], np.maximum(np.abs(p[:, 1:2]), 1e-9)
        return np.exp(-((x - m) ** 2) / (2 * s * s))
    a, b, c, d = (q[:, None] for q in np.sort(p, axis=1).T)
    up = np.where(b > a, (x - a) / np.where(b > a, b - a, 1.0), 1.0)
    down = np.where(d > c, (d - x) / np.where(d > c, d - c, 1.0), 1.0)
    return np.where((x < a) | (x > d), 0.0, np.where((x >= b) & (x <= c), 1.0, np.where(x < b, up, down)))


def _blocks(batches, columns: list[str]) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        at = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in columns}
        for k in range(0, batch.num_rows, BLOCK_ROWS):
            yield {c: x[k : k + BLOCK_ROWS] for c, x in at.items()}


def _x(at: dict[str, np.ndarray], features: int) -> np.ndarray:
    return np.stack([np.ones(len(at["__y"])), *(at[f"__x{i}"] for i in range(features))], 1)


def _products(layout: Layout, population: np.ndarray, columns: list[str], features: int, threshold: float, power: float | None):
    """A task's rows and its sums by individual and rule, as one row."""

    def run(batches):
        import pyarrow as pa

        upper = np.triu_indices(features + 2)
        total, n = np.zeros((len(population), len(layout.names), len(upper[0]))), 0
        for at in _blocks(batches, columns):
            rows = np.c_[_x(at, features), at["__y"]]
            products = rows[:, upper[0]] * rows[:, upper[1]]
            n += len(rows)
            for r in range(len(layout.names)):
                total[:, r] += layout.active(r, population, at, threshold, power).astype(float) @ products
        if n:
            yield pa.RecordBatch.from_pydict({"n": pa.array([float(n)]), "s": pa.array([total.tobytes()], pa.binary())})

    return run


def _errors(layout: Layout, population: np.ndarray, columns: list[str], weights: np.ndarray, threshold: float, power: float | None):
    """A task's summed errors of each individual."""

    def run(batches):
        import pyarrow as pa

        good = ~np.isnan(weights[..., 0])
        known = np.nan_to_num(weights)
        squares, total, n = np.zeros(len(population)), np.zeros(len(population)), 0
        for at in _blocks(batches, columns):
            x = _x(at, weights.shape[-1] - 1)
            guess, active = np.zeros((len(population), len(x))), np.zeros((len(population), len(x)))
            for r in range(len(layout.names)):
                on = layout.active(r, population, at, threshold, power) & good[:, r, None]
                guess += np.where(on, known[:, r] @ x.T, 0.0)
                active += on
            e = (np.where(active > 0, guess / np.maximum(active, 1), NONE_ACTIVE) - at["__y"]) / at["__rated"]
            squares += (e * e).sum(1)
            total += np.abs(e).sum(1)
            n += len(x)
        if n:
            own = {"individual": pa.array(np.arange(len(population)), pa.int32()), "s": pa.array(squares), "a": pa.array(total)}
            yield pa.RecordBatch.from_pydict(own | {"n": pa.array([n] * len(population), pa.int64()), "rules": pa.array(good.sum(1), pa.int32())})

    return run


def _doubles(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(a) for a, c in columns.items()]).dropna()


class Problem:
    """Training and test rows, and the rule base whose parameters are sought.

    rated: what errors are divided by, a number or a column of the test rows. A rule counts if more than `least` and
    less than `share` of the training rows activate it; rows with a null are left out.
    """

    def __init__(self, train: DataFrame, test: DataFrame, rules: Rules, features: list[str], y: str, rated: float | str = 1.0, least: int = 500, share: float = 0.33, threshold: float = ACTIVE, power: float | None = None):
        self.rules, self.layout, self.features = rules, Layout.of(rules), list(features)
        self.least, self.share, self.threshold, self.power = least, share, threshold, power
        names = {v: v for v in self.layout.variables}
        own = names | {f"__x{i}": c for i, c in enumerate(features)} | {"__y": y}
        self.train = _doubles(train, own)
        test = test if isinstance(rated, str) else test.withColumn("__gl_rated", F.lit(float(rated)))
        self.test = _doubles(test, own | {"__rated": rated if isinstance(rated, str) else "__gl_rated"})

    def sums(self, population: np.ndarray) -> tuple[float, np.ndarray]:
        """All training rows' number, and by individual and rule the products of (1, features, y) over the active rows: one job."""
        d = len(self.features) + 2
        upper = np.triu_indices(d)
        shape = (len(population), len(self.layout.names), len(upper[0]))
        run = _products(self.layout, population, self.train.columns, d - 2, self.threshold, self.power)
        add = lambda a, b: b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])
        got = self.train.mapInArrow(run, "n double, s binary").rdd.treeAggregate(None, lambda a, r: add(a, (r.n, np.frombuffer(r.s).reshape(shape))), add)
        n, flat = got or (0.0, np.zeros(shape))
        full = np.zeros((*shape[:2], d, d))
        full[..., upper[0], upper[1]] = full[..., upper[1], upper[0]] = flat
        return n, full

    def models(self, population: np.ndarray) -> np.ndarray:
        """Least squares weights (intercept first) by individual and rule; NaN where a rule has too few or too many rows."""
        n, sums = self.sums(population)
        out = np.full((*sums.shape[:2], len(self.features) + 1), np.nan)
        for i, r in np.argwhere((sums[..., 0, 0] > self.least) & (sums[..., 0, 0] < self.share * n)):
            p = sums[i, r] / sums[i, r, 0, 0]
            mean, y = p[0, 1:-1], p[0, -1]
            w = np.linalg.lstsq(p[1:-1, 1:-1] - np.outer(mean, mean), p[1:-1, -1] - mean * y, rcond=None)[0]
            out[i, r] = np.r_[y - mean @ w, w]
        return out

    def costs(self, population: list[list[float]]) -> DataFrame:
        """individual, squares, mean, rules: summed squared and mean absolute errors of each individual on the test rows, and its rules that count."""
        p = np.array(population, float)
        run = _errors(self.layout, p, self.test.columns, self.models(p), self.threshold, self.power)
        sums = self.test.mapInArrow(run, "individual int, s double, a double, n long, rules int").groupBy("individual").agg(F.sum("s").alias("squares"), F.sum("a").alias("a"), F.sum("n").alias("n"), F.max("rules").alias("rules"))
        return sums.select("individual", "squares", (F.col("a") / F.col("n")).alias("mean"), "rules")

    def score(self, population: list[list[float]]) -> list[tuple[float, float]]:
        """Both costs of a generation."""
        return [(r.squares, r.mean) for r in sorted(self.costs(population).collect(), key=lambda r: r.individual)]


def mated(rng, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two-point exchange, or a blend by place that reaches BLEND beyond both."""
    if rng.random() > 0.5 and len(a) > 2:
        i, j = sorted(rng.choice(len(a) + 1, 2, replace=False))
        return np.r_[a[:i], b[i:j], a[j:]]
    g = (1 + 2 * BLEND) * rng.random(len(a)) - BLEND
    return (1 - g) * a + g * b


def stepped(rng, x: np.ndarray, low: np.ndarray, high: np.ndarray, spread: np.ndarray, share: float = 0.6) -> np.ndarray:
    """A quarter of the time Gaussian steps, else bounded polynomial ones, in about `share` of the places."""
    at = rng.random(len(x)) < share
    if rng.random() > 0.75:
        return np.where(at, x + rng.normal(0, 1, len(x)) * spread, x)
    width = np.maximum(high - low, 1e-12)
    u, power = rng.random(len(x)), ETA + 1
    down, up = np.clip((x - low) / width, 0, 1), np.clip((high - x) / width, 0, 1)
    fall = (2 * u + (1 - 2 * u) * (1 - down) ** power).clip(0) ** (1 / power) - 1
    rise = 1 - (2 * (1 - u) + (2 * u - 1) * (1 - up) ** power).clip(0) ** (1 / power)
    return np.where(at, np.clip(x + np.where(u < 0.5, fall, rise) * width / 2, low, high), x)


def searched(problem: Problem, ranges: dict[str, tuple[float, float]], settings: Settings | None = None) -> tuple[Rules, tuple[float, float], list[tuple[list[float], tuple[float, float]]]]:
    """The rule base with the least summed squares that any generation held, its two costs, and the front of all generations' individuals that no other beats.

    The first generation is the given base, steps from it, and random ones; each further one `children` by mating,
    steps or as they are, and the next parents are won from these by tournaments.
    """
    s = settings or Settings(cross=0.6, change=0.4)
    rng = np.random.default_rng(s.seed)
    low, high, spread = bounds(problem.rules, ranges)
    first = np.array(start_of(problem.rules))
    held = problem.train.persist(), problem.test.persist()
    try:
        pool = [first] + [stepped(rng, first, low, high, spread) if k < s.parents / 2 else low + rng.random(len(first)) * (high - low) for k in range(1, s.parents)]
        pool = [pool[0], *(np.clip(p, low, high) for p in pool[1:])]
        known = list(zip([p.tolist() for p in pool], problem.score([p.tolist() for p in pool]), strict=True))
        costs = [c for _, c in known]
        for _ in range(s.generations):
            made, new = [], []
            for _ in range(s.children):
                u, k = rng.random(), int(rng.integers(len(pool)))
                if u >= s.cross + s.change:  # goes on as it is, at no cost
                    made.append((pool[k], costs[k]))
                    continue
                child = mated(rng, pool[k], pool[int(rng.integers(len(pool)))]) if u < s.cross else stepped(rng, pool[k], low, high, spread)
                new.append(np.clip(child, low, high))
            scores = problem.score([p.tolist() for p in new]) if new else []
            made += zip(new, scores, strict=True)
            known = front(known + [(p.tolist(), c) for p, c in zip(new, scores, strict=True)])
            rank = dominated(np.array([c for _, c in made]))
            picks = [min(rng.integers(0, len(made), s.tournament), key=lambda i: (rank[i], made[i][1])) for _ in range(s.parents)]
            pool, costs = [made[i][0] for i in picks], [made[i][1] for i in picks]
    finally:
        for df in held:
            df.unpersist()
    known = front(known)
    params, cost = min(known, key=lambda pc: pc[1])
    return with_params(problem.rules, params), cost, known


def front(known: list[tuple[list[float], tuple[float, float]]]) -> list[tuple[list[float], tuple[float, float]]]:
    """Those that no other beats."""
    rank = dominated(np.array([c for _, c in known]))
    return [known[i] for i in np.flatnonzero(rank == 0)]

"""Sequential searches over a space of parameters: surrogates (Gaussian process, trees, boosted quantiles, densities), ask and tell, and what can be read from a surrogate afterwards.

The points of a search are few, so surrogates live on the driver; the costly part, scoring points, is one Spark job a
round (`evolve.scored_on`).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from .search import halton


@dataclass(frozen=True)
class Real:
    low: float
    high: float
    log: bool = False

    def unit(self, x: float) -> float:
        a, b, x = (math.log10(v) for v in (self.low, self.high, x)) if self.log else (self.low, self.high, x)
        return (x - a) / (b - a)

    def value(self, u: float) -> float:
        u = min(max(u, 0.0), 1.0)
        if self.log:
            a, b = math.log10(self.low), math.log10(self.high)
            return 10 ** (a + u * (b - a))
        return self.low + u * (self.high - self.low)


@dataclass(frozen=True)
class Integer:
    low: int
    high: int

    def unit(self, x: int) -> float:
        return (x - self.low) / max(1, self.high - self.low)

    def value(self, u: float) -> int:
        return int(round(self.low + min(max(u, 0.0), 1.0) * (self.high - self.low)))


@dataclass(frozen=True)
class Categorical:
    values: tuple

    def unit(self, x) -> float:
        return self.values.index(x) / max(1, len(self.values) - 1)

    def value(self, u: float):
        return self.values[int(round(min(max(u, 0.0), 1.0) * (len(self.values) - 1)))]


# kernels of points in the unit cube: functions of (a, b, length)
def _gap(a, b, length):
    return np.sqrt((((a[:, None] - b[None]) / length) ** 2).sum(-1))


def _matern(a, b, length, nu=2.5):
    d = _gap(a, b, length)
    if nu == 0.5:
        return np.exp(-d)
    s = math.sqrt(2 * nu) * d
    return (1 + s) * np.exp(-s) if nu == 1.5 else (1 + s + s * s / 3) * np.exp(-s)


KERNELS = {
    "rbf": lambda a, b, length: np.exp(-0.5 * _gap(a, b, length) ** 2),
    "matern": _matern,
    "matern15": lambda a, b, length: _matern(a, b, length, 1.5),
    "matern05": lambda a, b, length: _matern(a, b, length, 0.5),
    "rational": lambda a, b, length: 1 / (1 + 0.5 * _gap(a, b, length) ** 2),
    "periodic": lambda a, b, length: np.exp(-2 * (np.sin(np.pi * np.abs(a[:, None] - b[None])) ** 2 / length**2).sum(-1)),
    "hamming": lambda a, b, length: np.exp(-((np.abs(a[:, None] - b[None]) > 1e-9) / length).mean(-1)),
}


@dataclass
class GaussianProcess:
    """Mean and deviation of a process with one of the KERNELS; length and noise of the largest evidence on a grid."""

    kernel: str = "matern"
    lengths: tuple = (0.05, 0.1, 0.2, 0.4, 0.8, 1.6)
    noises: tuple = (1e-6, 1e-3, 1e-1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> GaussianProcess:
        self.x, self.mean, self.scale = x, float(y.mean()), float(y.std()) or 1.0
        t, best = (y - self.mean) / self.scale, -math.inf
        for length in self.lengths:
            k = KERNELS[self.kernel](x, x, length)
            for noise in self.noises:
                try:
                    low = np.linalg.cholesky(k + (noise + 1e-10) * np.eye(len(x)))
                except np.linalg.LinAlgError:
                    continue
                w = np.linalg.solve(low.T, np.linalg.solve(low, t))
                evidence = -0.5 * t @ w - np.log(np.diag(low)).sum()
                if evidence > best:
                    best, self.length, self.low, self.w = evidence, length, low, w
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = KERNELS[self.kernel](x, self.x, self.length)
        v = np.linalg.solve(self.low, k.T)
        own = np.ones(len(x))
        return self.mean + self.scale * (k @ self.w), self.scale * np.sqrt(np.maximum(own - (v * v).sum(0), 1e-12))


def _grow(x, y, rng, depth, random_cut):
    """A regression tree as nested tuples: (dimension, cut, left, right) or a leaf (mean, variance)."""
    if depth == 0 or len(y) < 4 or np.ptp(y) == 0:
        return float(y.mean()), float(y.var())
    best = None
    for d in rng.permutation(x.shape[1])[: max(1, (x.shape[1] + 2) // 3 + 1)]:
        lo, hi = x[:, d].min(), x[:, d].max()
        if lo == hi:
            continue
        cuts = [rng.uniform(lo, hi)] if random_cut else np.unique(x[:, d])[:-1] + np.diff(np.unique(x[:, d])) / 2
        for c in cuts:
            left = x[:, d] <= c
            n = int(left.sum())
            if 0 < n < len(y):
                cost = n * y[left].var() + (len(y) - n) * y[~left].var()
                if best is None or cost < best[0]:
                    best = cost, d, c, left
    if best is None:
        return float(y.mean()), float(y.var())
    _, d, c, left = best
    return d, c, _grow(x[left], y[left], rng, depth - 1, random_cut), _grow(x[~left], y[~left], rng, depth - 1, random_cut)


def _leaf(tree, row):
    while len(tree) == 4:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@dataclass
class Trees:
    """A forest (bootstrap samples, best cuts) or extremely random trees; the deviation is that of the trees' means and within their leaves."""

    trees: int = 50
    depth: int = 8
    extra: bool = False
    seed: int = 0

    def fit(self, x, y) -> Trees:
        rng = np.random.default_rng(self.seed)
        self.grown = []
        for _ in range(self.trees):
            at = np.arange(len(y)) if self.extra else rng.integers(0, len(y), len(y))
            self.grown.append(_grow(x[at], y[at], rng, self.depth, self.extra))
        return self

    def predict(self, x):
        got = np.array([[_leaf(t, row) for t in self.grown] for row in x])
        mean = got[..., 0].mean(1)
        return mean, np.sqrt(np.maximum(got[..., 1].mean(1) + got[..., 0].var(1), 1e-12))


@dataclass
class BoostedQuantiles:
    """Boosted trees for the 16th, 50th and 84th percentile; half the outer two's gap is the deviation."""

    rounds: int = 30
    rate: float = 0.2
    depth: int = 3
    seed: int = 0

    def fit(self, x, y) -> BoostedQuantiles:
        rng = np.random.default_rng(self.seed)
        self.models = []
        for q in (0.16, 0.5, 0.84):
            now = np.full(len(y), np.quantile(y, q))
            trees, size = [], float(y.std()) or 1.0
            for _ in range(self.rounds):
                tree = _grow(x, np.where(y > now, q, q - 1), rng, self.depth, False)
                trees.append(tree)
                now = now + self.rate * size * np.array([_leaf(tree, r)[0] for r in x])
            self.models.append((float(np.quantile(y, q)), size, trees))
        return self

    def predict(self, x):
        low, mid, high = (np.array([b + self.rate * s * sum(_leaf(t, r)[0] for t in ts) for r in x]) for b, s, ts in self.models)
        return mid, np.maximum((high - low) / 2, 1e-6)


SURROGATES = {"gp": GaussianProcess, "forest": Trees, "extra_trees": lambda: Trees(extra=True), "gbrt": BoostedQuantiles, "dummy": None, "tpe": None}


def _cdf(z):
    return 0.5 * (1 + np.vectorize(math.erf)(z / math.sqrt(2)))


def gain(kind: str, mean, std, best: float, xi: float = 0.01, kappa: float = 1.96, seconds=None):
    """How good points look (larger is better): lcb, pi or ei of minimised values; with expected seconds, a second's worth of it."""
    if kind == "lcb":
        out = kappa * std - mean
    else:
        z = (best - xi - mean) / std
        out = _cdf(z) if kind == "pi" else (best - xi - mean) * _cdf(z) + std * np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    return out if seconds is None else out / np.maximum(seconds, 1e-9)


@dataclass
class Optimizer:
    """Ask for points, tell their costs. The first `start` points are spread evenly; then the surrogate's best of `candidates` points (near the best one and anywhere)."""

    space: list
    surrogate: str = "gp"
    acquisition: str = "ei"
    start: int = 10
    candidates: int = 500
    seed: int = 0
    x: list = field(default_factory=list)
    y: list = field(default_factory=list)
    seconds: list = field(default_factory=list)

    def unit(self, points) -> np.ndarray:
        return np.array([[d.unit(v) for d, v in zip(self.space, p, strict=True)] for p in points], float).reshape(len(points), len(self.space))

    def values(self, unit: np.ndarray) -> list:
        return [[d.value(float(u)) for d, u in zip(self.space, row, strict=True)] for row in unit]

    def _candidates(self, rng) -> np.ndarray:
        anywhere = rng.random((self.candidates, len(self.space)))
        if not self.y:
            return anywhere
        best = self.unit([self.x[int(np.argmin(self.y))]])
        near = np.clip(best + rng.normal(0, 0.1, (self.candidates, len(self.space))), 0, 1)
        return np.concatenate([anywhere, near])

    def _density(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log density of a product of kernels over the points, and one over everything."""
        width = max(0.05, len(points) ** (-1 / (4 + points.shape[1])) * 0.5)
        d = np.exp(-0.5 * ((at[:, None] - points[None]) / width) ** 2) / width
        return np.log((d.mean(1) * 0.9 + 0.1) + 1e-12).sum(1)

    def ask(self, n: int = 1) -> list:
        """n points; more than one by pretending that those already chosen cost what the best did."""
        rng = np.random.default_rng([self.seed, len(self.y)])
        primes = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29)
        if len(self.y) < self.start or self.surrogate == "dummy":
            if self.surrogate == "dummy":
                return self.values(rng.random((n, len(self.space))))
            k = len(self.y)
            return self.values(np.array([[halton(k + i + 1, primes[d % 10]) for d in range(len(self.space))] for i in range(n)]))
        out, x, y = [], self.unit(self.x), np.array(self.y, float)
        for _ in range(n):
            at = self._candidates(rng)
            if self.surrogate == "tpe":
                order = np.argsort(y)
                good = max(2, len(y) // 4)
                worth = self._density(x[order[:good]], at) - self._density(x[order[good:]], at)
            else:
                mean, std = SURROGATES[self.surrogate]().fit(x, y).predict(at)
                seconds = None
                if len(self.seconds) == len(self.y) and self.seconds:
                    seconds = np.exp(GaussianProcess().fit(self.unit(self.x), np.log(np.maximum(self.seconds, 1e-6))).predict(at)[0])
                worth = gain(self.acquisition, mean, std, y.min(), seconds=seconds)
            pick = at[int(np.argmax(worth))]
            out.append(pick)
            x, y = np.vstack([x, pick]), np.append(y, y.min())
        return self.values(np.array(out))

    def tell(self, points: list, costs: list[float], seconds: list[float] | None = None) -> None:
        self.x += [list(p) for p in points]
        self.y += [float(c) for c in costs]
        self.seconds += list(seconds or [])

    def best(self) -> tuple[list, float]:
        k = int(np.argmin(self.y))
        return self.x[k], self.y[k]

    def state(self) -> dict:
        """What `stores.dump_search` keeps; `Optimizer(space, **...)` and `tell` bring it back."""
        return {"x": self.x, "y": self.y, "seconds": self.seconds, "surrogate": self.surrogate, "acquisition": self.acquisition}


def minimise(score: Callable[[list], list], space: list, calls: int = 30, batch: int = 1, stop: Callable[[Optimizer], bool] | None = None, **more) -> Optimizer:
    """A search of `calls` points, `batch` at a time (a batch is one call of score: one Spark job). `stop` is asked after each batch."""
    o = Optimizer(space, **more)
    while len(o.y) < calls:
        points = o.ask(min(batch, calls - len(o.y)))
        o.tell(points, [c[0] if isinstance(c, tuple | list) else c for c in score(points)])
        if stop is not None and stop(o):
            break
    return o


def stops_at(delta: float, last: int = 5) -> Callable[[Optimizer], bool]:
    """Stop once the best `last` costs differ by no more than delta."""
    return lambda o: len(o.y) > last and sorted(o.y)[last - 1] - min(o.y) <= delta


def expected_minimum(o: Optimizer, points: int = 2000) -> tuple[list, float]:
    """The point that the surrogate thinks best, and what it expects there."""
    at = np.concatenate([np.random.default_rng(0).random((points, len(o.space))), o.unit(o.x)])
    mean, _ = (SURROGATES[o.surrogate] or GaussianProcess)().fit(o.unit(o.x), np.array(o.y, float)).predict(at)
    k = int(np.argmin(mean))
    return o.values(at[k : k + 1])[0], float(mean[k])


def partial_dependence(o: Optimizer, dimension: int, steps: int = 20, samples: int = 100) -> list[tuple]:
    """(value, expected cost) along one dimension, averaged over the others."""
    model = (SURROGATES[o.surrogate] or GaussianProcess)().fit(o.unit(o.x), np.array(o.y, float))
    rest = np.random.default_rng(0).random((samples, len(o.space)))
    out = []
    for u in np.linspace(0, 1, steps):
        rest[:, dimension] = u
        out.append((o.space[dimension].value(float(u)), float(model.predict(rest)[0].mean())))
    return out

"""Clustering by alternating optimisation: hard, probabilistic, possibilistic, Gustafson-Kessel, varieties, and Rousseeuw-Trauwaert-Kaufman.

A round is one pass: every task adds up its rows' weighted sums (and outer products) for each of the few centres, the
sums are added on executors, and only they (centres x dimensions squared at most) reach the driver, which moves the
centres. Rows are (id, features).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("hard", "probabilistic", "possibilistic", "gustafson_kessel", "varieties", "rtk")


@dataclass
class State:
    """Centres, and what else a kind keeps of each: inverse shapes or main directions, and scales."""

    kind: str
    centres: np.ndarray
    m: float = 2.0
    alpha: float = 0.5
    r: int = 1
    shapes: np.ndarray | None = None
    scales: np.ndarray | None = None
    cost: list[float] = field(default_factory=list)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances, rows by centres."""
        v = x[:, None, :] - self.centres[None]
        if self.kind == "gustafson_kessel" and self.shapes is not None:
            return np.einsum("ncj,cjk,nck->nc", v, self.shapes, v)
        d = (v * v).sum(-1)
        if self.kind == "varieties" and self.shapes is not None:  # what lies along the main directions doesn't count
            d = d - (np.einsum("ncj,cjr->ncr", v, self.shapes) ** 2).sum(-1)
        return np.maximum(d, 1e-12)

    def memberships(self, d: np.ndarray) -> np.ndarray:
        """Rows by centres."""
        if self.kind == "hard":
            return np.eye(d.shape[1])[d.argmin(1)]
        if self.kind == "possibilistic" and self.scales is not None:
            return 1 / (1 + (d / self.scales) ** (1 / (self.m - 1)))
        if self.kind == "rtk":
            return self._threshold(d)
        w = d ** (-1 / (self.m - 1))
        return w / w.sum(1, keepdims=True)

    def _threshold(self, d: np.ndarray) -> np.ndarray:
        """Memberships under the mixed fuzzifier: far centres get none, the others share by inverse distances."""
        beta = (1 - self.alpha) / (1 + self.alpha)
        order = np.argsort(d, 1)
        inverse = np.cumsum(1 / np.take_along_axis(d, order, 1), 1)
        q = np.arange(1, d.shape[1] + 1)
        near = np.take_along_axis(d, order, 1) * inverse < (1 + q * beta) / max(beta, 1e-12)
        n = np.maximum(near.sum(1), 1)
        total = inverse[np.arange(len(d)), n - 1][:, None]
        u = ((1 + n[:, None] * beta) / (total * d) - beta) / 1.0
        rank = np.argsort(order, 1)
        u = np.where(rank < n[:, None], np.maximum(u, 0), 0)
        return u / np.maximum(u.sum(1, keepdims=True), 1e-12)

    def weights(self, u: np.ndarray) -> np.ndarray:
        if self.kind == "hard":
            return u
        return self.alpha * u + (1 - self.alpha) * u * u if self.kind == "rtk" else u**self.m


def _sums(rows: DataFrame, state: State) -> np.ndarray:
    """Of each centre: the weights' sum, weighted cost, weighted sums and, for shapes, weighted outer products about the centre; then whatever is left of memberships."""
    held = rows.sparkSession.sparkContext.broadcast(state)
    wide = state.kind in ("gustafson_kessel", "varieties")

    def run(batches):
        s, total = held.value, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column("features").to_pylist(), float)
            d = s.distances(x)
            u = s.memberships(d)
            g = s.weights(u)
            parts = [g.sum(0)[:, None], (g * d).sum(0)[:, None], ((1 - u) ** s.m).sum(0)[:, None], g.T @ x]
            if wide:
                v = x[:, None, :] - s.centres[None]
                parts.append(np.einsum("nc,ncj,nck->cjk", g, v, v).reshape(len(s.centres), -1))
            got = np.concatenate(parts, 1).ravel()
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["k", "v"])

    got = rows.select("features").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    held.unpersist()
    out = np.zeros(len(got))
    out[got.column("k").to_numpy()] = got.column("v").to_numpy()
    return out.reshape(len(state.centres), -1)


def step(rows: DataFrame, state: State) -> State:
    """One round: sums under the old centres, then new centres (and shapes)."""
    s = _sums(rows, state)
    p = state.centres.shape[1]
    mass = np.maximum(s[:, :1], 1e-12)
    new = State(state.kind, np.where(s[:, :1] > 1e-12, s[:, 3 : 3 + p] / mass, state.centres), state.m, state.alpha, state.r, state.shapes, state.scales, [*state.cost, float(s[:, 1].sum())])
    if s.shape[1] > 3 + p:
        cov = s[:, 3 + p :].reshape(-1, p, p) / mass[:, :, None] + 1e-9 * np.eye(p)
        if state.kind == "gustafson_kessel":
            new.shapes = np.linalg.inv(cov / np.linalg.det(cov)[:, None, None] ** (1 / p))
        else:
            new.shapes = np.linalg.eigh(cov)[1][:, :, ::-1][:, :, : state.r]
    return new


def fit(rows: DataFrame, centres: list[list[float]], kind: str = "probabilistic", rounds: int = 10, tol: float = 1e-6, m: float = 2.0, alpha: float = 0.5, r: int = 1) -> State:
    """The state after `rounds` rounds at most, or once no centre moves by more than tol. Possibilistic clustering starts from probabilistic centres and takes its scales from them."""
    if kind not in KINDS:
        raise ValueError(f"no such kind: {kind}")
    state = State(kind, np.array(centres, float), m, alpha, r)
    if kind == "possibilistic":
        state.centres = fit(rows, centres, "probabilistic", rounds, tol, m).centres
        s = _sums(rows, State("probabilistic", state.centres, m))
        state.scales = s[:, 1] / np.maximum(s[:, 0], 1e-12)
    for _ in range(rounds):
        new = step(rows, state)
        moved = np.abs(new.centres - state.centres).max(initial=0)
        state = new
        if moved <= tol:
            break
    return state


def initial_centres(rows: DataFrame, n: int, seed: int = 0) -> list[list[float]]:
    """n draws of 2 * deviation * (u - 0.5) + mean in each dimension: two numbers a dimension reach the driver."""
    dims = rows.select(F.posexplode("features").alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).orderBy("dim").collect()
    rng = np.random.default_rng(seed)
    return [[2 * r.sd * (rng.random() - 0.5) + r.mean for r in dims] for _ in range(n)]


def best_of(rows: DataFrame, n: int, kind: str, restarts: int = 3, rounds: int = 10) -> State:
    """The cheapest of some restarts."""
    runs = [fit(rows, initial_centres(rows, n, seed), kind, rounds) for seed in range(restarts)]
    return min(runs, key=lambda s: s.cost[-1] if s.cost else np.inf)


def assigned(rows: DataFrame, state: State) -> DataFrame:
    """id, c (the nearest centre), u (its membership)."""
    held = rows.sparkSession.sparkContext.broadcast(state)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("features").to_pylist(), float).reshape(batch.num_rows, -1)
            d = held.value.distances(x) if len(x) else np.zeros((0, 1))
            u = held.value.memberships(d)
            c = d.argmin(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(c.astype(np.int32)), pa.array(u[np.arange(len(u)), c])], ["id", "c", "u"])

    return rows.select(F.col("id").cast("long").alias("id"), "features").mapInArrow(run, "id long, c int, u double")


def rbf_centres(rows: DataFrame, n: int, seed: int = 0, rounds: int = 10) -> list[list[float]]:
    """n centres for radial bases: of linear varieties, or by k-means where these degenerate (a centre that isn't finite, or two that are one)."""
    try:
        got = fit(rows, initial_centres(rows, n, seed), "varieties", rounds).centres
    except np.linalg.LinAlgError:
        got = np.full((n, 1), np.nan)
    if np.isfinite(got).all() and len(np.unique(np.round(got, 9), axis=0)) == n:
        return got.tolist()
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=n, seed=seed + 1, featuresCol="v").fit(rows.select(array_to_vector("features").alias("v")))
    return [[float(x) for x in c] for c in model.clusterCenters()]

"""Linear models from one pass of sums, stacking, feature selection and searches over parameters.

Least squares, ridge, Bayesian ridge, elastic net and principal components need only the features' sums and products:
these are added up on executors in one pass, and the (features squared) numbers that reach the driver give any of the
models, so a search over penalties or subsets of features costs no further pass.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """n, sums and products of (1, features, y)."""

    features: list[str]
    products: np.ndarray

    @property
    def n(self) -> float:
        return float(self.products[0, 0])

    def centred(self, chosen: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float]:
        """Mean products of the features about their means, those with y, the means, y's mean and y's variance."""
        p = self.products / max(self.n, 1)
        k = np.arange(len(self.features)) if chosen is None else np.array(chosen, int)
        mean = p[0, 1:-1][k]
        xx = p[1:-1, 1:-1][np.ix_(k, k)] - np.outer(mean, mean)
        xy = p[1:-1, -1][k] - mean * p[0, -1]
        return xx, xy, mean, float(p[0, -1]), float(p[-1, -1] - p[0, -1] ** 2)


def moments(df: DataFrame, features: list[str], y: str) -> Moments:
    """One pass; rows with a null are left out."""
    size = len(features) + 2
    return moments_by(df, features, y, F.lit(0)).get(0, Moments(list(features), np.zeros((size, size))))


def moments_by(df: DataFrame, features: list[str], y: str, group: Column) -> dict[int, Moments]:
    """The sums of each group (a small number a row, such as its fold), in one pass over all; groups without rows are left out."""
    size = len(features) + 2

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(float) for i in range(size - 1)], 1)
            x, of = np.c_[np.ones(len(x)), x], batch.column(size - 1).to_numpy(zero_copy_only=False)
            for g in np.unique(of):
                own = x[of == g]
                total[int(g)] = total.get(int(g), 0) + own.T @ own
        for g, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size * size, g), pa.int32()), pa.array(np.arange(size * size)), pa.array(t.ravel())], ["g", "k", "v"])

    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate([*features, y])], group.cast("int").alias("g")).dropna()
    got = rows.mapInArrow(run, "g int, k long, v double").groupBy("g", "k").agg(F.sum("v").alias("v")).toArrow()
    out: dict[int, np.ndarray] = {}
    for g, k, v in zip(got.column("g").to_pylist(), got.column("k").to_pylist(), got.column("v").to_pylist(), strict=True):
        out.setdefault(g, np.zeros(size * size))[k] = v
    return {g: Moments(list(features), v.reshape(size, size)) for g, v in out.items()}


@dataclass
class Linear:
    """A fitted linear model."""

    features: list[str]
    weights: np.ndarray
    intercept: float

    def column(self) -> Column:
        out = F.lit(float(self.intercept))
        for c, w in zip(self.features, self.weights, strict=True):
            out = out + F.col(c) * float(w)
        return out


def ridge(m: Moments, penalty: float = 0.0, chosen: list[int] | None = None) -> Linear:
    """Least squares with penalty * |w|^2 on the sum of squares."""
    xx, xy, mean, y, _ = m.centred(chosen)
    w = np.linalg.lstsq(xx + penalty / max(m.n, 1) * np.eye(len(xx)), xy, rcond=None)[0]
    names = m.features if chosen is None else [m.features[k] for k in chosen]
    return Linear(names, w, float(y - mean @ w))


def bayesian_ridge(m: Moments, rounds: int = 300, tol: float = 1e-6) -> Linear:
    """Ridge whose penalty is the ratio of precisions that the evidence is largest for."""
    xx, xy, mean, y, var = m.centred()
    s, v = np.linalg.eigh(xx * m.n)
    s = np.maximum(s, 0)
    alpha, lam = 1 / max(var, 1e-12), 1.0
    w = np.zeros(len(xx))
    for _ in range(rounds):
        new = v @ ((v.T @ (xy * m.n)) / (s + lam / alpha))
        sse = max(m.n * (var - 2 * xy @ new + new @ xx @ new), 1e-12)
        gamma = (alpha * s / (lam + alpha * s)).sum()
        lam = (gamma + 2e-6) / ((new @ new) + 2e-6)
        alpha = (m.n - gamma + 2e-6) / (sse + 2e-6)
        moved, w = np.abs(new - w).sum(), new
        if moved < tol:
            break
    return Linear(m.features, w, float(y - mean @ w))


def elastic_net(m: Moments, penalty: float, mix: float = 0.5, rounds: int = 1000, tol: float = 1e-8, chosen: list[int] | None = None) -> Linear:
    """Half the mean squared error + penalty * (mix * |w|_1 + (1 - mix) / 2 * |w|^2), by coordinate descent on the products."""
    xx, xy, mean, y, _ = m.centred(chosen)
    w = np.zeros(len(xx))
    for _ in range(rounds):
        before = w.copy()
        for j in range(len(w)):
            rho = xy[j] - xx[j] @ w + xx[j, j] * w[j]
            w[j] = np.sign(rho) * max(abs(rho) - penalty * mix, 0) / max(xx[j, j] + penalty * (1 - mix), 1e-12)
        if np.abs(w - before).max(initial=0) < tol:
            break
    names = m.features if chosen is None else [m.features[k] for k in chosen]
    return Linear(names, w, float(y - mean @ w))


def mean_squared_error(m: Moments, model: Linear) -> float:
    """Of a linear model on the rows that the sums were taken of."""
    k = [m.features.index(c) for c in model.features]
    xx, xy, mean, y, var = m.centred(k)
    w = model.weights
    return float(var - 2 * xy @ w + w @ xx @ w + (y - mean @ w - model.intercept) ** 2)


def folds(df: DataFrame, key: str, n: int = 3) -> Column:
    """A fold of each row, by a hash of its key."""
    return F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")


def fold_moments(df: DataFrame, features: list[str], y: str, key: str, n: int = 3) -> list[tuple[Moments, Moments]]:
    """(train, test) sums of each fold, from one pass; the train sums are the others' sums together."""
    found = moments_by(df, features, y, folds(df, key, n))
    none = np.zeros((len(features) + 2, len(features) + 2))
    parts = [found.get(k, Moments(list(features), none)) for k in range(n)]
    return [(Moments(features, sum(p.products for j, p in enumerate(parts) if j != k)), parts[k]) for k in range(n)]


def cross_validated(pairs: list[tuple[Moments, Moments]], fit: Callable[[Moments], Linear]) -> float:
    return float(np.mean([mean_squared_error(test, fit(train)) for train, test in pairs]))


def elastic_net_cv(pairs: list[tuple[Moments, Moments]], penalties=None, mixes=(0.1, 0.5, 0.9, 1.0)) -> tuple[float, float]:
    """(penalty, mix) of the least cross-validated error: a grid search without a pass over the rows."""
    grid = [(a, x) for a in (penalties or np.logspace(-6, 1, 15)) for x in mixes]
    return min(grid, key=lambda g: cross_validated(pairs, lambda m: elastic_net(m, *g)))


def forward(pairs: list[tuple[Moments, Moments]], fit: Callable = ridge) -> list[str]:
    """Linear search: features in order, each kept if it lowers the cross-validated error; rejected ones are tried again until none helps."""
    names, chosen, best = pairs[0][0].features, [], float("inf")
    moved = True
    while moved:
        moved = False
        for k in range(len(names)):
            if k in chosen:
                continue
            got = cross_validated(pairs, lambda m, k=k: fit(m, chosen=[*chosen, k]))
            if got < best * (1 - 1e-9):
                chosen, best, moved = [*chosen, k], got, True
    return [names[k] for k in chosen]


def backward(pairs: list[tuple[Moments, Moments]], gain: float = 0.005, fit: Callable = ridge) -> list[str]:
    """Elimination: the feature whose loss hurts least goes first, while that lowers the error, or raises it by less than `gain` of itself."""
    names = pairs[0][0].features
    chosen = list(range(len(names)))
    best = cross_validated(pairs, lambda m: fit(m, chosen=chosen))
    while len(chosen) > 1:
        got, k = min((cross_validated(pairs, lambda m, k=k: fit(m, chosen=[c for c in chosen if c != k])), k) for k in chosen)
        if got > best * (1 + gain):
            break
        chosen.remove(k)
        best = min(best, got)
    return [names[k] for k in chosen]


def principal_components(m: Moments, share: float = 0.99) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, components by row, variances) of the fewest components that hold `share` of the variance."""
    xx, _, mean, _, _ = m.centred()
    value, vector = np.linalg.eigh(xx)
    value, vector = value[::-1], vector[:, ::-1]
    n = int(np.searchsorted(np.cumsum(value) / max(value.sum(), 1e-12), share)) + 1
    return mean, vector[:, :n].T, value[:n]


def projected(df: DataFrame, m: Moments, pca: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """df with pc_0, pc_1, ...; expressions in generated code."""
    mean, rows, _ = pca
    return df.withColumns({f"pc_{n}": sum(((F.col(c) - float(mu)) * float(w) for c, mu, w in zip(m.features, mean, row, strict=True)), F.lit(0.0)) for n, row in enumerate(rows)})


def stacked(pred: DataFrame, keys: list[str], methods: list[str], kind: str = "ridge") -> tuple[DataFrame, Linear]:
    """Forecasts of a linear model over the methods' forecasts (wide: keys, y, a column a method), and the model; not below zero."""
    m = moments(pred, methods, "y")
    model = {"ridge": lambda: ridge(m, 1.0), "bayesian": lambda: bayesian_ridge(m), "elastic": lambda: elastic_net(m, 1e-3)}[kind]()
    return pred.select(*keys, F.greatest(F.lit(0.0), model.column()).alias("y_hat")), model


def forest_importances(df: DataFrame, features: list[str], y: str, trees: int = 20, depth: int = 5, seed: int = 1) -> dict[str, float]:
    from .models import forest

    model = forest(df, features, y, trees, depth, seed).stages[-1]
    return dict(zip(features, model.featureImportances.toArray().tolist(), strict=True))


def permutation_importances(df: DataFrame, features: list[str], y: str, key: str, predict: Callable[[DataFrame], DataFrame], seed: int = 0) -> dict[str, float]:
    """How much the mean squared error of a fitted model grows when one feature's values are dealt to other rows.

    predict: gives a frame with the features `prediction` beside its columns. Every row gets, by one join for all
    features, the values of the row a drawn number of places further in a hashed order, so nothing is collected.
    """
    from .ranks import by_share
    from .resample import uniform

    placed = by_share(df.select(key, y, *features).dropna(), [], uniform(F.col(key), seed=seed), [key], "__r")
    n = placed.count()
    if n < 2:
        return dict.fromkeys(features, 0.0)
    shift = 1 + int(np.random.default_rng(seed).integers(n - 1))
    donors = placed.select(F.pmod(F.col("__r") - 1 + shift, F.lit(n)).alias("__d"), *[F.col(c).alias(f"__{c}") for c in features])
    both = placed.withColumn("__d", F.col("__r") - 1).join(donors, "__d").persist()
    error = F.avg((F.col("prediction") - F.col(y)) ** 2)
    try:
        base = predict(both).agg(error).collect()[0][0]
        return {c: predict(both.withColumn(c, F.col(f"__{c}"))).agg(error).collect()[0][0] - base for c in features}
    finally:
        both.unpersist()


def searched_regressor(kind: str, df: DataFrame, features: list[str], y: str, key: str, grid: dict[str, list], n_folds: int = 3) -> tuple[dict, object, list[tuple[dict, float]]]:
    """The parameters of the least cross-validated mean squared error among all of a grid, the estimator fitted with them on all rows, and every trial. A trial is a fit of Spark's own, over all rows but a fold's."""
    from itertools import product

    rows = df.withColumn("__fold", folds(df, key, n_folds)).persist()
    trials = []
    try:
        for values in product(*grid.values()):
            params = dict(zip(grid, values, strict=True))
            errors = []
            for k in range(n_folds):
                model = regressor(kind, features, y, **params).fit(rows.filter(F.col("__fold") != k))
                got = model.transform(rows.filter(F.col("__fold") == k)).agg(F.avg((F.col("prediction") - F.col(y)) ** 2)).collect()[0][0]
                errors += [] if got is None else [got]
            trials.append((params, float(np.mean(errors)) if errors else float("inf")))
        best = min(trials, key=lambda t: t[1])[0]
        return best, regressor(kind, features, y, **best).fit(rows), trials
    finally:
        rows.unpersist()


def boruta(df: DataFrame, features: list[str], y: str, key: str, n_folds: int = 3, rounds: int = 5, trees: int = 20) -> list[str]:
    """Features that beat the best of their shadows (the same columns in a hashed order) in most rounds of two folds or more.

    A shadow pairs row numbers by two hashed orders, so it is one join for all columns and nothing is collected.
    """
    from .ranks import by_share
    from .resample import uniform

    votes = dict.fromkeys(features, 0)
    for fold in range(n_folds):
        part = df.filter(folds(df, key, n_folds) != fold)
        wins = dict.fromkeys(features, 0)
        for r in range(rounds):
            rows = by_share(part, [], uniform(F.col(key), seed=2 * r), [key], "__r")
            shadow = by_share(part, [], uniform(F.col(key), seed=2 * r + 1), [key], "__r").select("__r", *[F.col(c).alias(f"shadow_{c}") for c in features])
            got = forest_importances(rows.join(shadow, "__r"), [*features, *[f"shadow_{c}" for c in features]], y, trees, seed=r + 1)
            best = max(got[f"shadow_{c}"] for c in features)
            for c in features:
                wins[c] += got[c] > best
        for c in features:
            votes[c] += 2 * wins[c] > rounds
    return [c for c in features if votes[c] >= min(2, n_folds)]


def recursive_elimination(df: DataFrame, features: list[str], y: str, key: str, n_folds: int = 3, trees: int = 20) -> list[str]:
    """Features by forest importances: the weakest goes each round; the set of the least cross-validated error stays."""
    from .models import forest

    best, kept, chosen = float("inf"), list(features), list(features)
    while chosen:
        errors = []
        for k in range(n_folds):
            model = forest(df.filter(folds(df, key, n_folds) != k), chosen, y, trees)
            got = model.transform(df.filter(folds(df, key, n_folds) == k)).agg(F.avg((F.col("prediction") - F.col(y)) ** 2)).collect()[0][0]
            errors.append(got if got is not None else float("inf"))
        if np.mean(errors) <= best:
            best, kept = float(np.mean(errors)), list(chosen)
        order = forest_importances(df, chosen, y, trees)
        chosen.remove(min(chosen, key=lambda c: order[c]))
    return kept


def regressor(name: str, features: list[str], y: str, **more):
    """A Spark ML pipeline of the zoo: forest, boosted, tree, elastic_net, or factorisation (`fm`)."""
    from pyspark.ml import Pipeline, regression
    from pyspark.ml.feature import VectorAssembler

    kinds = {"forest": regression.RandomForestRegressor, "boosted": regression.GBTRegressor, "tree": regression.DecisionTreeRegressor, "elastic_net": regression.LinearRegression, "fm": regression.FMRegressor}
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), kinds[name](labelCol=y, **more)])


def per_group_network(df: DataFrame, key: str, features: list[str], y: str, hidden: int = 16, steps: int = 400, rate: float = 0.01, most: int = 3000) -> DataFrame:
    """A one-layer network for each key: key, w1, b1, w2, b2. A group is at most `most` rows by hashed order (a bound of the model's own training set, stated here)."""
    import pandas as pd

    from .ranks import by_share
    from .resample import uniform

    rows = df.select(key, *features, y).dropna()
    rows = by_share(rows, [key], uniform(*[F.col(c) for c in (*features, y)]), [*features, y], "__r").filter(F.col("__r") <= most).drop("__r")

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        x, t = g[features].to_numpy(float), g[y].to_numpy(float)
        rng = np.random.default_rng(0)
        p = [rng.standard_normal((x.shape[1], hidden)) * 0.5, np.zeros(hidden), rng.standard_normal(hidden) * 0.1, np.array(t.mean())]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        for k in range(1, steps + 1):
            h = np.tanh(x @ p[0] + p[1])
            e = (h @ p[2] + p[3] - t) * 2 / len(t)
            dh = np.outer(e, p[2]) * (1 - h * h)
            for j, g_ in enumerate((x.T @ dh, dh.sum(0), h.T @ e, e.sum())):
                m[j], v[j] = 0.9 * m[j] + 0.1 * g_, 0.999 * v[j] + 0.001 * g_ * g_
                p[j] = p[j] - rate * (m[j] / (1 - 0.9**k)) / (np.sqrt(v[j] / (1 - 0.999**k)) + 1e-8)
        return pd.DataFrame({key: [g[key].iloc[0]], "w1": [p[0].ravel().tolist()], "b1": [p[1].tolist()], "w2": [p[2].tolist()], "b2": [float(p[3])]})

    return rows.groupBy(key).applyInPandas(fit, f"{key} {dict(df.dtypes)[key]}, w1 array<double>, b1 array<double>, w2 array<double>, b2 double")


def network_forecast(df: DataFrame, models: DataFrame, key: str, features: list[str]) -> DataFrame:
    """df with y_hat of its key's network: expressions over the model's arrays, no Python."""
    joined = df.join(models, key)
    out = F.col("b2")
    unit = lambda j: F.tanh(sum((F.col(c) * F.get("w1", i * F.size("b1") + j) for i, c in enumerate(features)), F.get("b1", j)))
    total = F.aggregate(F.sequence(F.lit(0), F.size("b1") - 1), F.lit(0.0), lambda s, j: s + unit(j) * F.get("w2", j))
    return joined.withColumn("y_hat", out + total).select(*df.columns, "y_hat")


def selected(kind: str, df: DataFrame, features: list[str], y: str, key: str, **more) -> list[str]:
    """Feature names by one of the methods: forward, backward, boruta (constant and correlated columns go first), recursive, or none."""
    if kind == "none":
        return list(features)
    if kind in ("forward", "backward"):
        return {"forward": forward, "backward": backward}[kind](fold_moments(df, features, y, key), **more)
    if kind == "recursive":
        return recursive_elimination(df, features, y, key, **more)
    if kind == "boruta":
        from .features import constant_features, spearman_drops

        constant = {r.feature for r in constant_features(df, features, 0.999).filter("constant").collect()}  # a row for each column
        left = [c for c in features if c not in constant]
        dropped = {r.feature for r in spearman_drops(df, left, more.pop("correlated", 0.95)).filter("dropped").collect()} if len(left) > 1 else set()
        return boruta(df, [c for c in left if c not in dropped], y, key, **more)
    raise ValueError(f"no such method: {kind}")

"""Kernel machines over all rows: landmark (Nystroem) features, kernel principal components, support-vector regression.

A Gaussian kernel exp(-gamma |x - z|^2) is replaced by the products of features that a bounded number of landmarks give:
phi(x) = S^(-1/2) U' k(x, landmarks), with U S U' the landmarks' own kernel matrix. With all distinct rows as landmarks
that is the kernel itself; with fewer the error is what the landmarks can't span. Everything else is sums over the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rbf import _matrix, _meet, candidate_centres, in_parts
from .regress import Linear

LANDMARKS = 256
#: Eigenvalues of the landmarks' matrix below this share of the largest are dropped.
LEAST_EIGEN = 1e-10


def whitener(marks: np.ndarray, gamma: float) -> np.ndarray:
    """U S^(-1/2) of the landmarks' kernel matrix: kernels with the landmarks times it are the features."""
    value, vector = np.linalg.eigh(gaussian(marks, marks, gamma))
    keep = value > LEAST_EIGEN * value[-1]
    return vector[:, keep] / np.sqrt(value[keep])


def gaussian(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]
    return np.exp(-gamma * np.maximum(d, 0))


def landmark_features(df: DataFrame, features: list[str], marks: np.ndarray, gamma: float, name: str = "phi") -> tuple[DataFrame, list[str]]:
    """df without rows with a null feature, and with the landmark features as columns; their names. marks: a bounded matrix, which goes to all tasks."""
    import pyarrow as pa

    white = whitener(marks, gamma)
    names = [f"{name}_{i}" for i in range(white.shape[1])]

    def run(batches):
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in features], 1)
            phi = gaussian(x, marks, gamma) @ white
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v) for v in phi.T)], names=[*batch.schema.names, *names])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{n} double" for n in names)])
    return df.dropna(subset=features).mapInArrow(run, schema), names


def landmarks(df: DataFrame, features: list[str], most: int = LANDMARKS) -> np.ndarray:
    """Up to `most` distinct rows, by hashed order."""
    x = df.select(*[F.col(c).cast("double").alias(c) for c in features]).dropna().distinct()
    return np.array([list(r) for r in x.orderBy(F.xxhash64(*features), *features).limit(most).collect()], float).reshape(-1, len(features))


def components(df: DataFrame, key: str, features: list[str], gamma: float, n: int = 2, most: int = LANDMARKS) -> DataFrame:
    """key, id and n kernel principal components of each key's rows (df: key, id, features): one pass adds up the landmark features' products by key, a second projects. A key's rows are dealt to parts; up to `most` of its distinct rows are landmarks, and with all of them the components are exact."""
    spark = df.sparkSession
    plain = df.select(F.col(key).alias("key"), "id", F.array(*[F.col(c).cast("double") for c in features]).alias("x"), F.col("id").alias("y")).filter(F.forall("x", lambda v: v.isNotNull()))
    parts = in_parts(plain)
    kinds = dict(plain.dtypes)
    side = candidate_centres(plain, most)

    def features_of(left, right) -> np.ndarray:
        marks = np.array(right.column("centres")[0].as_py(), float)
        return gaussian(_matrix(left.column("x")), marks, gamma) @ whitener(marks, gamma)

    def sums(left, right):
        import pyarrow as pa

        got = []
        if left.num_rows and right.num_rows:
            phi = np.c_[np.ones(left.num_rows), features_of(left, right)]
            got = [(right.column("key")[0].as_py(), (phi.T @ phi).tobytes())]
        return pa.table([pa.array([g[0] for g in got], right.schema.field("key").type), pa.array([g[1] for g in got], pa.binary())], ["key", "s"])

    add = lambda a, b: (np.frombuffer(a) + np.frombuffer(b)).tobytes()

    def axes(kv):
        key, s = kv
        m = np.frombuffer(s)
        m = m.reshape(int(len(m) ** 0.5), -1)
        mean = m[0, 1:] / m[0, 0]
        value, vector = np.linalg.eigh(m[1:, 1:] - m[0, 0] * np.outer(mean, mean))
        top = vector[:, ::-1][:, :n]
        if top.shape[1] < n:
            top = np.c_[top, np.zeros((len(top), n - top.shape[1]))]
        return key, mean.tolist(), top.T.tolist()

    whole = _meet(parts, side, sums, f"key {kinds['key']}, s binary").rdd.map(lambda r: (r.key, bytes(r.s))).reduceByKey(add, int(spark.conf.get("spark.sql.shuffle.partitions"))).map(axes)
    found = side.join(spark.createDataFrame(whole, f"key {kinds['key']}, mean array<double>, axes array<array<double>>"), "key")

    def project(left, right):
        import pyarrow as pa

        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], left.schema.field("key").type), pa.array([], left.schema.field("id").type), pa.array([], pa.list_(pa.float64()))], ["key", "id", "components"])
        out = (features_of(left, right) - np.array(right.column("mean")[0].as_py())) @ np.array(right.column("axes")[0].as_py()).T
        return pa.table([left.column("key"), left.column("id"), pa.array(out.tolist(), pa.list_(pa.float64()))], ["key", "id", "components"])

    return _meet(parts, found, project, f"key {kinds['key']}, id {kinds['id']}, components array<double>").withColumnRenamed("key", key)


def _residual_sums(w: np.ndarray, features: int, epsilon: float, penalty: float, smooth: float):
    """A task's weighted products for the next step, and its part of the objective: rows within epsilon have no weight."""

    def run(batches):
        import pyarrow as pa

        d = features + 1
        total, loss, n = np.zeros((d, d + 1)), 0.0, 0
        for batch in batches:
            x = np.stack([np.ones(batch.num_rows), *(batch.column(i).to_numpy(zero_copy_only=False) for i in range(features))], 1)
            y = batch.column(features).to_numpy(zero_copy_only=False)
            e = y - x @ w
            over = np.abs(e) - epsilon
            out = over > 0
            a = penalty / np.maximum(over[out], smooth)
            z = (y - np.sign(e) * epsilon)[out]
            total += (x[out] * a[:, None]).T @ np.c_[x[out], z]
            loss += penalty * over[out].sum()
            n += len(y)
        if n:
            yield pa.RecordBatch.from_pydict({"s": pa.array([total.tobytes()], pa.binary()), "loss": pa.array([loss]), "n": pa.array([n], pa.int64())})

    return run


def support_regression(df: DataFrame, features: list[str], y: str, penalty: float = 1.0, epsilon: float = 0.1, rounds: int = 60, tol: float = 1e-4, nu: float | None = None) -> tuple[Linear, float]:
    """Half |w|^2 + penalty * sum of max(0, |error| - epsilon), least over all rows, by reweighted least squares: a pass of sums a round, the step halved by the objective's fall. Also the objective. With `nu`, epsilon is each round's share of absolute errors that leaves nu of the rows outside (by an approximate quantile). Rows with a null are left out."""
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate([*features, y])]).dropna().persist()
    d = len(features) + 1

    def measured(w: np.ndarray, epsilon: float, smooth: float):
        got = rows.mapInArrow(_residual_sums(w, d - 1, epsilon, penalty, smooth), "s binary, loss double, n long").rdd.treeAggregate(None, lambda a, r: _plus(a, (np.frombuffer(r.s).reshape(d, d + 1), r.loss, r.n)), _plus)
        return got or (np.zeros((d, d + 1)), 0.0, 0)

    try:
        spread = rows.agg(F.stddev_pop(f"x{d - 1}"), F.avg(f"x{d - 1}")).collect()[0]
        sd = float(spread[0] or 1.0) or 1.0
        w = np.zeros(d)
        w[0] = spread[1] or 0.0
        best, cost, smooth = w, np.inf, 0.1 * sd
        ridge = np.diag([1e-9, *[1.0] * (d - 1)])
        for _ in range(rounds):
            if nu is not None:
                guess = F.lit(float(w[0]))
                for i in range(d - 1):
                    guess = guess + F.col(f"x{i}") * float(w[i + 1])
                epsilon = float(rows.agg(F.percentile_approx(F.abs(F.col(f"x{d - 1}") - guess), 1 - nu, 10_000)).collect()[0][0] or 0.0)
                cost = np.inf  # another problem each round
            s, loss, _ = measured(w, epsilon, smooth)
            now = 0.5 * float(w[1:] @ w[1:]) + loss
            if now < cost:
                gain, best, cost = cost - now, w, now
                step = np.linalg.solve(s[:, :d] + ridge, s[:, d]) - w
                if gain < tol * max(cost, 1e-12) and smooth <= 1e-4 * sd:
                    break
                smooth = max(smooth * 0.5, 1e-5 * sd)
            else:
                step = 0.5 * step
                if np.abs(step).max() < 1e-9 * (np.abs(best).max() + 1):
                    break
            w = best + step
        return Linear(list(features), best[1:], float(best[0])), float(cost)
    finally:
        rows.unpersist()


def _plus(a, b):
    return b if a is None else a if b is None else tuple(x + y for x, y in zip(a, b, strict=True))

"""Regressors by group, radial bases, quantiles and feature selection. Spark ML where it has the model; numpy per group elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def forest(train: DataFrame, features: list[str], y: str, trees: int = 20, depth: int = 5, seed: int = 1):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), RandomForestRegressor(labelCol=y, numTrees=trees, maxDepth=depth, seed=seed)]).fit(train)


def rbf_ols(df: DataFrame, key: str, features: list[str], y: str, width: float = 1.0, centres: int = 48, rows: int = 3000) -> DataFrame:
    """Orthogonal least squares choice of radial-basis centres, by key: key, step, centre (features), weight. All rows are fitted; the candidates are at most `rows` distinct ones of each key, by hashed order."""
    from . import rbf

    own = rbf.distinct_rows(df, key, features, y)
    models = rbf.fitted(rbf.in_parts(own), rbf.candidate_centres(own, rows), rbf.same_widths(own, [[width]]), centres)
    return models.select(F.col("key").alias(key), F.posexplode(F.arrays_zip("centres", "weights")).alias("step", "__m")).select(key, "step", F.col("__m.centres").alias("centre"), F.col("__m.weights").alias("weight"))


def quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float]) -> DataFrame:
    """Empirical quantiles (interpolated), one row for each."""
    p = F.percentile(value, F.array(*[F.lit(q) for q in qs])).alias("p")
    out = df.groupBy(*keys).agg(p)
    return out.select(*keys, F.posexplode("p").alias("n", "value")).withColumn("q", F.element_at(F.array(*[F.lit(q) for q in qs]), F.col("n") + 1)).select(*keys, "q", "value")


def width_sweep(df: DataFrame, key: str, features: list[str], y: str, widths: list[float], centres: int = 48, rows: int = 512) -> DataFrame:
    """key, width, centres, sse, mae, best: `rbf.swept`, with at most `rows` candidate centres a key; all rows are fitted or judged."""
    from . import rbf

    return rbf.swept(df, key, features, y, widths, centres, rows)


def quantile_fits(df: DataFrame, key: str, features: list[str], y: str, qs: list[float], rounds: int = 500, rows: int = 3000) -> DataFrame:
    """key, q, intercept, weights: linear quantile models by the pinball loss of the signed error, a group of `rows` rows at most (hashed) for each key."""
    import pandas as pd

    from .ranks import by_share
    from .resample import uniform

    kept = df.select(key, *features, y).dropna()
    kept = by_share(kept, [key], uniform(*[F.col(c) for c in (*features, y)]), [*features, y], "__r").filter(F.col("__r") <= rows).drop("__r")

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        x, t = g[features].to_numpy(float), g[y].to_numpy(float)
        mean, sd = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
        a = np.c_[np.ones(len(x)), (x - mean) / sd]
        out = []
        for q in qs:
            w = np.zeros(a.shape[1])
            for _ in range(rounds):  # reweighted least squares
                e = t - a @ w
                weight = np.where(e > 0, q, 1 - q) / np.maximum(np.abs(e), 1e-6 * (np.abs(t).mean() + 1e-9))
                new = np.linalg.solve(a.T @ (a * weight[:, None]) + 1e-12 * np.eye(len(w)), a.T @ (weight * t))
                done = np.abs(new - w).max() < 1e-9 * (np.abs(w).max() + 1)
                w = new
                if done:
                    break
            out.append((g[key].iloc[0], q, float(w[0] - (w[1:] * mean / sd).sum()), (w[1:] / sd).tolist()))
        return pd.DataFrame(out, columns=[key, "q", "intercept", "weights"])

    return kept.groupBy(key).applyInPandas(fit, f"{key} {dict(df.dtypes)[key]}, q double, intercept double, weights array<double>")


def kernel_components(df: DataFrame, key: str, features: list[str], gamma: float, n: int = 2, rows: int = 2000) -> DataFrame:
    """key, id and n kernel principal components of each key's rows (df: key, id, features), by numpy for each key: at most `rows` rows by id order, more are an error, as the method has no partial form."""
    import pandas as pd

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if len(g) > rows:
            raise ValueError(f"{len(g)} rows of {g[key].iloc[0]}, more than {rows}")
        g = g.sort_values("id")
        x = g[features].to_numpy(float)
        k = np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(-1))
        one = np.full_like(k, 1 / len(k))
        k = k - one @ k - k @ one + one @ k @ one
        value, vector = np.linalg.eigh(k)
        top = vector[:, ::-1][:, :n] * np.sqrt(np.maximum(value[::-1][:n], 0))
        top = top * np.where(top[np.abs(top).argmax(0), np.arange(top.shape[1])] < 0, -1, 1)  # signs don't depend on the solver
        return pd.DataFrame({key: g[key].to_numpy(), "id": g["id"].to_numpy(), "components": top.tolist()})

    kinds = dict(df.dtypes)
    return df.groupBy(key).applyInPandas(fit, f"{key} {kinds[key]}, id {kinds['id']}, components array<double>")


def transferred(params: DataFrame, donors: DataFrame) -> DataFrame:
    """Parameters of every project (params: project, method, params): its own, or those of its donor (donors: project, donor) where it has none."""
    own = params.select("project", "method", "params")
    from_donor = donors.join(own.withColumnRenamed("project", "donor"), "donor").select("project", "method", F.col("params").alias("__donated"))
    out = own.join(from_donor, ["project", "method"], "full")
    return out.select("project", "method", F.coalesce("params", "__donated").alias("params"), F.col("params").isNull().alias("transferred"))

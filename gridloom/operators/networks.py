"""Networks by key over all rows, with heads for the mean and for quantiles: data-parallel rounds.

A key's distinct rows, each with its number of copies, are dealt to parts of about PART_ROWS at most. In a round every part starts from its key's parameters and takes
EPOCHS passes over its rows in small batches; the parts' parameters are averaged by their rows, in a shuffle that adds
them up, so neither a key's rows nor its parts ever meet in a task. Parameters are one short array a key, a table between
rounds; no row is left out and no number of keys is broadcast. Batches come in an order that the rows' hashes and the seed
give, so the result doesn't depend on the input's partitions.

A model is one layer of `hidden` tanh units and a linear output a head: head 0 the mean (squared error), the others the
quantiles asked for (pinball loss of the signed error). Features and y are scaled by each key's mean and deviation, which
the model keeps. Rows with a null are left out; a key without rows has no model.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.interim import dropped, written
from .rbf import _meet, distinct_rows, in_parts

QUANTILES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
PART_ROWS = 20_000
BATCH = 64
EPOCHS = 5
#: Models of a few hundred numbers each that are broadcast to score rows.
BROADCAST_MODELS = 2000
MODEL = "x_mean array<double>, x_sd array<double>, y_mean double, y_sd double, hidden int, p array<double>"


def sizes(features: int, hidden: int, heads: int) -> list[tuple[int, ...]]:
    return [(features, hidden), (hidden,), (hidden, heads), (heads,)]


def unpacked(p: np.ndarray, features: int, hidden: int, heads: int) -> list[np.ndarray]:
    out, at = [], 0
    for s in sizes(features, hidden, heads):
        out.append(p[at : at + int(np.prod(s))].reshape(s))
        at += int(np.prod(s))
    return out


def first(features: int, hidden: int, heads: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = [rng.normal(0, 1 / np.sqrt(features), (features, hidden)), np.zeros(hidden), rng.normal(0, 0.1 / np.sqrt(hidden), (hidden, heads)), np.zeros(heads)]
    return np.concatenate([p.ravel() for p in parts])


def gradient(p: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, hidden: int, quantiles: tuple[float, ...]) -> np.ndarray:
    """Of the mean, over rows that stand n times each, of the heads' losses added up."""
    w1, b1, w2, b2 = unpacked(p, x.shape[1], hidden, 1 + len(quantiles))
    h = np.tanh(x @ w1 + b1)
    e = y[:, None] - (h @ w2 + b2)
    d = np.empty_like(e)
    d[:, 0] = -2 * e[:, 0]
    for i, q in enumerate(quantiles):
        d[:, i + 1] = np.where(e[:, i + 1] > 0, -q, 1 - q)
    d *= (n / n.sum())[:, None]
    dh = (d @ w2.T) * (1 - h * h)
    return np.concatenate([(x.T @ dh).ravel(), dh.sum(0), (h.T @ d).ravel(), d.sum(0)])


def trained(p: np.ndarray, x: np.ndarray, y: np.ndarray, n: np.ndarray, hidden: int, quantiles: tuple[float, ...], rate: float, seed: int, epochs: int = EPOCHS) -> np.ndarray:
    """Parameters after `epochs` passes in batches, by steps scaled to the gradients' running size (Adam)."""
    p, m, v, t = p.copy(), np.zeros_like(p), np.zeros_like(p), 0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            at = order[a : a + BATCH]
            g = gradient(p, x[at], y[at], n[at], hidden, quantiles)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return p


def outputs(x: np.ndarray, m: dict, heads: int) -> np.ndarray:
    """Rows by heads: the mean, then the quantiles, which never cross."""
    w1, b1, w2, b2 = unpacked(np.array(m["p"], float), x.shape[1], m["hidden"], heads)
    z = (x - np.array(m["x_mean"])) / np.array(m["x_sd"])
    out = (np.tanh(z @ w1 + b1) @ w2 + b2) * m["y_sd"] + m["y_mean"]
    out[:, 1:] = np.sort(out[:, 1:], axis=1)
    return out


def fit(df: DataFrame, key: str, features: list[str], y: str, quantiles: tuple[float, ...] = QUANTILES, hidden: int = 16, rounds: int = 10, rate: float = 0.02, seed: int = 0, part_rows: int = PART_ROWS) -> DataFrame:
    """key and the model's columns (MODEL), a row for each key that has rows."""
    spark = df.sparkSession
    parts = written(in_parts(distinct_rows(df, key, features, y), part_rows).select("key", "part", "x", "y", "n"), "parts")
    kind = dict(parts.dtypes)["key"]
    d, heads = len(features), 1 + len(quantiles)
    n = F.sum("n")
    mean = lambda v: F.sum(v * F.col("n")) / n
    scale = lambda m, v: F.sqrt(F.greatest(mean(v * v) - m * m, F.lit(0.0)))
    values = [*[F.col("x")[i] for i in range(d)], F.col("y")]
    stats = parts.groupBy("key").agg(F.array(*[mean(v) for v in values]).alias("m"), F.array(*[scale(mean(v), v) for v in values]).alias("s"))
    sd = F.transform("s", lambda s: F.when(s > 1e-12, s).otherwise(1.0))  # a constant column stays at 0
    stats = stats.select("key", F.slice("m", 1, d).alias("x_mean"), F.slice(sd, 1, d).alias("x_sd"), F.col("m")[d].alias("y_mean"), sd[d].alias("y_sd"))
    start = first(d, hidden, heads, seed).tolist()
    models = written(stats.withColumns({"hidden": F.lit(hidden), "p": F.array(*[F.lit(v) for v in start])}), "models")

    def run(r: int):
        def part(left, right):
            import pyarrow as pa

            got = []
            if left.num_rows and right.num_rows:
                m = {c: right.column(c)[0].as_py() for c in ("x_mean", "x_sd", "y_mean", "y_sd", "p")}
                left = left.sort_by([("h", "ascending"), ("y", "ascending")])
                x, t, n = np.array(left.column("x").to_pylist(), float), left.column("y").to_numpy(), left.column("n").to_numpy().astype(float)
                z, t = (x - np.array(m["x_mean"])) / np.array(m["x_sd"]), (t - m["y_mean"]) / m["y_sd"]
                new = trained(np.array(m["p"], float), z, t, n, hidden, quantiles, rate / (1 + r / 3), seed + r)
                got.append((right.column("key")[0].as_py(), np.append(new * n.sum(), n.sum()).tobytes()))
            return pa.table([pa.array([g[0] for g in got], right.schema.field("key").type), pa.array([g[1] for g in got], pa.binary())], ["key", "s"])

        return part

    add = lambda a, b: (np.frombuffer(a) + np.frombuffer(b)).tobytes()
    hashed = parts.withColumn("h", F.xxhash64("x"))
    for r in range(rounds):
        sums = _meet(hashed, models, run(r), f"key {kind}, s binary").rdd.map(lambda v: (v.key, bytes(v.s))).reduceByKey(add, int(spark.conf.get("spark.sql.shuffle.partitions")))
        means = spark.createDataFrame(sums.map(lambda kv: (kv[0], (np.frombuffer(kv[1])[:-1] / np.frombuffer(kv[1])[-1]).tolist())), f"key {kind}, p array<double>")
        before, models = models, written(models.drop("p").join(means, "key"), "models")
        dropped(before)
    dropped(parts)
    return models.select(F.col("key").alias(key), "x_mean", "x_sd", "y_mean", "y_sd", "hidden", "p")


def forecast(df: DataFrame, key: str, features: list[str], models: DataFrame, quantiles: tuple[float, ...] = QUANTILES) -> DataFrame:
    """df with y_hat and q (an array, ascending, one for each quantile): null where a feature is null or the key has no model. Up to BROADCAST_MODELS models go to all tasks, and rows stay where they are; more meet their rows by key, in parts."""
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    spark, heads = df.sparkSession, 1 + len(quantiles)
    schema = StructType([*df.schema.fields, StructField("y_hat", DoubleType()), StructField("q", ArrayType(DoubleType()))])
    kept = ["x_mean", "x_sd", "y_mean", "y_sd", "hidden", "p"]
    if models.count() <= BROADCAST_MODELS:
        held = spark.sparkContext.broadcast({r[0]: r.asDict() for r in models.select(key, *kept).collect()})
        return df.mapInArrow(lambda batches: (_scored(b, key, features, held.value, heads) for b in batches), schema)
    rows = df.withColumn("__part", F.pmod(F.xxhash64(*df.columns), F.lit(spark.sparkContext.defaultParallelism)))
    places = rows.select(F.col(key).alias("__k"), F.col("__part").alias("__at")).distinct()
    theirs = models.select(F.col(key).alias("__k"), *kept).join(places, "__k", "right")
    theirs = theirs.select(*[F.col(c).alias(c) for c in theirs.columns])  # both sides may come from one table

    def run(left, right):
        import pyarrow as pa

        m = {} if not right.num_rows else {right.column("__k")[0].as_py(): right.slice(0, 1).to_pylist()[0]}
        return pa.Table.from_batches([_scored(b, key, features, {k: v for k, v in m.items() if v["p"] is not None}, heads) for b in left.drop_columns(["__part"]).to_batches()]) if left.num_rows else pa.table([pa.array([], f.type) for f in _schema(left.schema)], schema=pa.schema(_schema(left.schema)))

    return rows.groupBy(F.col(key), "__part").cogroup(theirs.groupBy("__k", "__at")).applyInArrow(run, schema)


def _schema(schema) -> list:
    import pyarrow as pa

    return [*(f for f in schema if f.name != "__part"), pa.field("y_hat", pa.float64()), pa.field("q", pa.list_(pa.float64()))]


def _scored(batch, key: str, features: list[str], models: dict, heads: int):
    """The batch with its rows' forecasts, worked out by key."""
    import pyarrow as pa

    x = np.stack([batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in features], 1) if batch.num_rows else np.zeros((0, len(features)))
    keys = np.array(batch.column(key).to_pylist(), object)
    out = np.full((len(x), heads), np.nan)
    for k in set(keys.tolist()) & set(models):
        at = np.flatnonzero((keys == k) & ~np.isnan(x).any(1))
        if len(at):
            out[at] = outputs(x[at], models[k], heads)
    none = np.isnan(out[:, 0])
    q = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(none, 0, heads - 1))], pa.int32()), pa.array(out[~none, 1:].ravel()), mask=pa.array(none))
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[:, 0], mask=none), q], schema=pa.schema(_schema(batch.schema)))


def stacked(pred: DataFrame, keys: list[str], methods: list[str], key: str, **more) -> DataFrame:
    """Forecasts of the methods (wide: a column each, and y), combined by a network for each `key`: keys, y, y_hat, q."""
    models = fit(pred, key, methods, "y", **more)
    return forecast(pred, key, methods, models, more.get("quantiles", QUANTILES)).select(*keys, "y", "y_hat", "q")

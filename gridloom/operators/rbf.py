"""Radial-basis models by key over all rows: centres by orthogonal least squares on sums of products.

The candidate centres of a key are bounded (`candidates` of its distinct rows, by hashed order; all of them where there
are fewer), its rows aren't. Distinct rows, with their numbers of copies, are dealt to parts of at most PART_ROWS; a part
and the candidates give products of the basis functions with each other and with y, for every asked vector of widths,
and the parts' products are added up by a shuffle. The choice of centres and all weights follow from these sums alone,
so neither the number of rows nor that of widths adds a pass over the rows. A function of a row x and a centre c is
exp(-sum over features of (width * (x - c))^2), with one width or one for each feature.

Rows with a null are left out; a key without rows has no model; ties of gains go to the earlier candidate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .evolve import Settings
from .ranks import by_share
from .resample import uniform

#: Distinct rows of a part, and candidate centres of a key.
PART_ROWS = 20_000
CANDIDATES = 512
CENTRES = 48
#: Share of a function's power that must be left beside those chosen before.
LEAST_POWER = 1e-9


def distinct_rows(df: DataFrame, key: str, features: list[str], y: str) -> DataFrame:
    """key, x (array), y, n: the distinct rows without nulls and how often each stands."""
    plain = df.select(F.col(key).alias("key"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(y).cast("double").alias("y")).dropna()
    names = [f"x{i}" for i in range(len(features))]
    return plain.groupBy("key", *names, "y").agg(F.count(F.lit(1)).alias("n")).select("key", F.array(*names).alias("x"), "y", "n")


def in_parts(rows: DataFrame, size: int = PART_ROWS) -> DataFrame:
    """rows with a part of their key, each of about `size` rows at most."""
    many = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("__parts"))
    return rows.join(many, "key").withColumn("part", F.pmod(F.xxhash64("x", "y"), F.col("__parts")).cast("int"))


def candidate_centres(rows: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """key and centres: up to `most` distinct places of each key, by hashed order."""
    places = rows.select("key", "x").distinct()
    ranked = by_share(places, ["key"], uniform(F.col("x").cast("string")), ["x"], "__r").filter(F.col("__r") <= most)
    return ranked.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("__r", "x"))), lambda s: s["x"]).alias("centres"))


def basis(x: np.ndarray, centres: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Functions (rows by centres) of one width or one a feature."""
    a, b = x * width, centres * width
    d = (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]
    return np.exp(-np.maximum(d, 0))


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), float)


def _meet(rows: DataFrame, side: DataFrame, run, schema: str) -> DataFrame:
    """`run` of each part of the rows and its key's row of `side`."""
    theirs = rows.select("key", "part").distinct().join(side, "key")
    fresh = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  both come from one table
    return fresh(rows).groupBy("key", "part").cogroup(fresh(theirs).groupBy("key", "part")).applyInArrow(run, schema)


def _sums(left, right):
    """A part's products, a row for each vector of widths: upper triangle of the functions', those with y, of y, rows."""
    import pyarrow as pa

    out: dict[str, list] = {"key": [], "w": [], "s": []}
    if left.num_rows and right.num_rows:
        x, y, n = _matrix(left.column("x")), left.column("y").to_numpy(), left.column("n").to_numpy().astype(float)
        centres = np.array(right.column("centres")[0].as_py(), float)
        upper = np.triu_indices(len(centres))
        for k, width in enumerate(right.column("widths")[0].as_py()):
            phi = basis(x, centres, np.array(width, float))
            heavy = phi * n[:, None]
            out["key"].append(right.column("key")[0].as_py())
            out["w"].append(k)
            out["s"].append(np.r_[(phi.T @ heavy)[upper], heavy.T @ y, (n * y * y).sum(), n.sum()].tobytes())
    return pa.table({"key": pa.array(out["key"], right.schema.field("key").type), "w": pa.array(out["w"], pa.int32()), "s": pa.array(out["s"], pa.binary())})


def chosen(gram: np.ndarray, b: np.ndarray, tt: float, most: int) -> list[int]:
    """Functions by orthogonal least squares from their products alone: the one with the largest gain beside those before, first."""
    power, left = gram.diagonal().copy(), b.copy()
    least, taken, used = LEAST_POWER * np.maximum(power, 1e-300), [], np.zeros(len(b), bool)
    rows = np.zeros((0, len(b)))  # products of the orthonormal functions with all others
    for _ in range(min(most, len(b))):
        gain = np.where(used | (power <= least), -1.0, left * left / np.maximum(power, 1e-300))
        k = int(gain.argmax())
        if gain[k] <= 1e-12 * (tt + 1e-12):
            break
        q = (gram[k] - rows[:, k] @ rows) / np.sqrt(power[k])
        left = left - q * (left[k] / np.sqrt(power[k]))
        power = power - q * q
        rows = np.vstack([rows, q])
        used[k] = True
        taken.append(k)
    return taken


def _model(s: bytes, most: int) -> tuple[list[int], np.ndarray, float, float]:
    """Chosen functions, their weights, the summed squares that they leave, and the rows."""
    v = np.frombuffer(s)
    m = int((np.sqrt(9 + 8 * (len(v) - 2)) - 3) / 2 + 0.5)
    gram = np.zeros((m, m))
    gram[np.triu_indices(m)] = v[: m * (m + 1) // 2]
    gram = gram + np.triu(gram, 1).T
    b, tt, n = v[-m - 2 : -2], float(v[-2]), float(v[-1])
    k = chosen(gram, b, tt, most)
    w = np.linalg.lstsq(gram[np.ix_(k, k)], b[k], rcond=None)[0] if k else np.zeros(0)
    return k, w, max(0.0, tt - 2 * float(w @ b[k]) + float(w @ gram[np.ix_(k, k)] @ w)) if k else tt, n


def fitted(parts: DataFrame, centres: DataFrame, widths: DataFrame, most: int = CENTRES) -> DataFrame:
    """key, w (the widths' place), width, centres and weights (arrays by order of choice), sse, n: a model of every vector of `widths` (key, widths) from one pass over `parts` (of `in_parts`)."""
    spark = parts.sparkSession
    side = centres.join(widths, "key")
    sums = _meet(parts.select("key", "part", "x", "y", "n"), side, _sums, f"key {dict(parts.dtypes)['key']}, w int, s binary")
    add = lambda a, b: (np.frombuffer(a) + np.frombuffer(b)).tobytes()
    whole = sums.rdd.map(lambda r: ((r.key, r.w), bytes(r.s))).reduceByKey(add, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def model(kv):
        (key, w), s = kv
        k, weights, sse, n = _model(s, most)
        return key, w, [int(i) for i in k], [float(v) for v in weights], float(sse), int(round(n))

    models = spark.createDataFrame(whole.map(model), f"key {dict(parts.dtypes)['key']}, w int, k array<int>, weights array<double>, sse double, n long")
    at = lambda a, i: F.element_at(a, i + 1)
    return models.join(side, "key").select("key", "w", at(F.col("widths"), F.col("w")).alias("width"), F.transform("k", lambda i: at(F.col("centres"), i)).alias("centres"), "weights", "sse", "n")


def _errors(left, right):
    """A part's summed squared and absolute errors under each of its key's models."""
    import pyarrow as pa

    got: list[tuple] = []
    if left.num_rows and right.num_rows:
        x, y, n = _matrix(left.column("x")), left.column("y").to_numpy(), left.column("n").to_numpy().astype(float)
        for m in right.column("models")[0].as_py():
            guess = basis(x, np.array(m["centres"], float), np.array(m["width"], float)) @ np.array(m["weights"]) if m["centres"] else np.zeros(len(x))
            e = y - guess
            got.append((right.column("key")[0].as_py(), m["w"], float((n * e * e).sum()), float((n * np.abs(e)).sum()), int(n.sum())))
    kinds = [("key", right.schema.field("key").type), ("w", pa.int32()), ("sse", pa.float64()), ("sae", pa.float64()), ("n", pa.int64())]
    return pa.table([pa.array([g[i] for g in got], t) for i, (_, t) in enumerate(kinds)], [c for c, _ in kinds])


def errors(parts: DataFrame, models: DataFrame) -> DataFrame:
    """key, w, sse, mae, n of every model (of `fitted`) on other rows, in one pass over them."""
    side = models.groupBy("key").agg(F.collect_list(F.struct("w", "width", "centres", "weights")).alias("models"))
    rows = _meet(parts.select("key", "part", "x", "y", "n"), side, _errors, f"key {dict(parts.dtypes)['key']}, w int, sse double, sae double, n long")
    return rows.groupBy("key", "w").agg(F.sum("sse").alias("sse"), (F.sum("sae") / F.sum("n")).alias("mae"), F.sum("n").alias("n"))


def forecast(df: DataFrame, key: str, features: list[str], models: DataFrame) -> DataFrame:
    """df with y_hat: its key's model's (key, width, centres, weights: one row a key); null where there is none or a feature is null. Sums in generated code."""
    x = F.array(*[F.col(c).cast("double") for c in features])
    own = models.select(F.col("key").alias("__key"), F.col("width").alias("__width"), F.col("centres").alias("__centres"), F.col("weights").alias("__weights"))
    j = df.withColumn("__x", x).join(own, F.col(key) == F.col("__key"), "left")
    wide = F.when(F.size("__width") == 1, F.array_repeat(F.col("__width")[0], len(features))).otherwise(F.col("__width"))
    gap = lambda c: F.aggregate(F.zip_with(F.zip_with("__x", c, lambda a, b: a - b), wide, lambda d, w: d * w), F.lit(0.0), lambda s, v: s + v * v)
    total = F.aggregate(F.zip_with("__centres", "__weights", lambda c, w: w * F.exp(-gap(c))), F.lit(0.0), lambda s, v: s + v)
    return j.select(*df.columns, total.alias("y_hat"))


def same_widths(keys: DataFrame, widths: list[list[float]]) -> DataFrame:
    """key and widths: the same vectors for every key."""
    return keys.select("key").distinct().withColumn("widths", F.array(*[F.array(*[F.lit(float(v)) for v in w]) for w in widths]))


def swept(df: DataFrame, key: str, features: list[str], y: str, widths: list[float], most: int = CENTRES, candidates: int = CANDIDATES, held_out: float = 0.25) -> DataFrame:
    """key, width, centres (their number), sse, mae, best: models of every width on a hashed part of each key's distinct rows, their errors on the rest; best: the least sse * mae, the smaller width at ties. One pass to fit all widths, one to judge them."""
    rows = distinct_rows(df, key, features, y)
    fold = uniform(F.col("x").cast("string"), F.col("y").cast("string"))
    train, test = rows.filter(fold >= held_out), rows.filter(fold < held_out)
    models = fitted(in_parts(train), candidate_centres(train, candidates), same_widths(train, [[w] for w in widths]), most)
    out = models.select("key", "w", F.col("width")[0].alias("width"), F.size("centres").alias("centres")).join(errors(in_parts(test), models).select("key", "w", "sse", "mae"), ["key", "w"], "left")
    best = out.groupBy("key").agg(F.min_by("w", F.struct(F.col("sse") * F.col("mae"), "width")).alias("__best"))
    return out.join(best, "key").select(F.col("key").alias(key), "width", "centres", "sse", "mae", F.coalesce(F.col("w") == F.col("__best"), F.lit(False)).alias("best"))


def searched(df: DataFrame, key: str, features: list[str], y: str, low: float = 0.05, high: float = 12.8, settings: Settings | None = None, most: int = CENTRES, candidates: int = CANDIDATES, held_out: float = 0.25) -> DataFrame:
    """key, width (one a feature), centres, weights, sse, mae: an evolutionary search for widths by key, on the held-out part's error. A generation of all keys' individuals is one pass to fit and one to judge; the individuals, a bounded number of short vectors a key, are what the driver holds."""
    s = settings or Settings(parents=40, children=60, generations=64)
    rows = distinct_rows(df, key, features, y)
    fold = uniform(F.col("x").cast("string"), F.col("y").cast("string"))
    train, test = rows.filter(fold >= held_out), rows.filter(fold < held_out)
    centres = candidate_centres(train, candidates).persist()
    fit_on, judge_on = in_parts(train).persist(), in_parts(test).persist()
    spark, kind = df.sparkSession, dict(rows.dtypes)["key"]
    try:
        keys = sorted(r.key for r in centres.select("key").collect())
        rngs = {k: np.random.default_rng([s.seed, i]) for i, k in enumerate(keys)}
        log_low, log_high = np.log(low), np.log(high)

        def scored(asked: dict) -> dict:
            listed = spark.createDataFrame([(k, [np.exp(p).tolist() for p in v]) for k, v in asked.items()], f"key {kind}, widths array<array<double>>")
            got = errors(judge_on, fitted(fit_on, centres, F.broadcast(listed), most)).collect()
            out = {k: [float("inf")] * len(v) for k, v in asked.items()}
            for r in got:
                out[r.key][r.w] = r.sse
            return out

        pool = {k: [log_low + rngs[k].random(len(features)) * (log_high - log_low) for _ in range(s.parents)] for k in keys}
        cost = scored(pool) if keys else {}
        for _ in range(s.generations if keys else 0):
            made = {k: [_child(rngs[k], pool[k], cost[k], s, log_low, log_high) for _ in range(s.children)] for k in keys}
            new = scored(made)
            for k in keys:
                order = np.argsort(np.r_[cost[k], new[k]], kind="stable")[: s.parents]
                both, costs = pool[k] + made[k], [*cost[k], *new[k]]
                pool[k], cost[k] = [both[i] for i in order], [costs[i] for i in order]
        best = spark.createDataFrame([(k, [np.exp(pool[k][int(np.argmin(cost[k]))]).tolist()]) for k in keys], f"key {kind}, widths array<array<double>>")
        models = fitted(in_parts(train), candidate_centres(train, candidates), F.broadcast(best), most)
        return models.join(errors(in_parts(test), models).select("key", F.col("sse").alias("held_sse"), "mae"), "key", "left").select(F.col("key").alias(key), "width", "centres", "weights", F.col("held_sse").alias("sse"), "mae")
    finally:
        for df_ in (centres, fit_on, judge_on):
            df_.unpersist()


def _child(rng, pool: list, cost: list, s: Settings, low: float, high: float) -> np.ndarray:
    win = lambda: pool[min(rng.integers(0, len(pool), s.tournament), key=lambda i: cost[i])]
    u, a = rng.random(), win()
    if u < s.cross:
        g = 2 * rng.random(len(a)) - 0.5
        a = (1 - g) * a + g * win()
    elif u < s.cross + s.change:
        a = a + rng.normal(0, 0.1 * (high - low), len(a))
    return np.clip(a, low, high)

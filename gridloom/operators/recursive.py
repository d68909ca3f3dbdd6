"""Recursive least squares weights on the simplex, with forgetting that adapts to the residuals, in a state of fixed size.

A row's forgetting factor is LEAST + SPAN * f, where f is the expected share of the scaled squared errors so far that lie
below a chi-square draw with a degree for each method. That expectation is the mean of the errors' tail probabilities, so
their sum and number are all that is remembered of them: no draws, no list of errors, and a stream that goes on from the
state gives what one batch gives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The least forgetting factor, its span, and the first covariance.
LEAST, SPAN = 0.75, 0.249
FIRST_COVARIANCE = 1e-4


def chi_square_tail(x: float, degrees: int) -> float:
    """The probability that a chi-square draw exceeds x, in closed form for whole degrees."""
    if x <= 0:
        return 1.0
    if not math.isfinite(x):
        return 0.0
    half = x / 2
    if degrees % 2 == 0:
        term = total = math.exp(-half)
        for i in range(1, degrees // 2):
            term *= half / i
            total += term
        return total
    total, term = math.erfc(math.sqrt(half)), math.exp(-half) * math.sqrt(half) / math.gamma(1.5)
    for i in range(1, (degrees + 1) // 2):
        total += term
        term *= half / (i + 0.5)
    return min(1.0, total)


@dataclass
class State:
    """Weights, their covariance, and sums over the errors: their number, mean, squares about it, and tail probabilities."""

    w: np.ndarray
    p: np.ndarray
    n: int = 0
    mean: float = 0.0
    squares: float = 0.0
    tails: float = 0.0

    @classmethod
    def first(cls, methods: int) -> State:
        return cls(np.full(methods, 1 / methods), np.eye(methods) * FIRST_COVARIANCE)

    def update(self, x: np.ndarray, y: np.ndarray, forget: float | None = None) -> State:
        """After more rows in order; `forget`: a constant factor instead of the adaptive one."""
        k = x.shape[1]
        for a, b in zip(x, y, strict=True):
            e, spread = b - a @ self.w, a @ self.p @ a
            var = self.squares / self.n if self.n else 1.0
            self.n += 1
            self.tails += chi_square_tail(e * e * spread / (var * (1 + spread)), k) if var > 0 else 0.0
            factor = LEAST + SPAN * self.tails / self.n if forget is None else forget
            gain = self.p @ a / (factor + spread)
            w = np.maximum(self.w + gain * e, 0)
            self.w = w / w.sum() if w.sum() > 0 else np.full(k, 1 / k)
            self.p = (self.p - np.outer(gain, a @ self.p)) / factor
            off = e - self.mean
            self.mean += off / self.n
            self.squares += off * (e - self.mean)
        return self


def weights(wide: DataFrame, key: str, time: str, methods: list[str], passes: int = 3) -> DataFrame:
    """key, method, weight after `passes` passes over all of each key's rows in order of time; rows with a null are left out.

    The recursion is in order, so a key's rows are one sorted stretch of a partition, which streams through its task
    batch by batch: a key may have any number of rows, and the state is all that a task holds.
    """
    rows = wide.select(key, time, "y", *methods).dropna().withColumn("__pass", F.explode(F.sequence(F.lit(1), F.lit(passes))))
    ordered = rows.repartition(key).sortWithinPartitions(key, "__pass", time, "y", *methods).select(F.col(key).alias("key"), F.col("y").cast("double").alias("y"), *[F.col(m).cast("double").alias(f"m{i}") for i, m in enumerate(methods)])
    kind = ordered.schema["key"].dataType.simpleString()
    return ordered.mapInArrow(_streamed(list(methods)), f"key {kind}, method string, weight double").withColumnRenamed("key", key)


def _streamed(methods: list[str]):
    def run(batches) -> Iterator:
        import pyarrow as pa

        now, state, kind = None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([now] * len(methods), kind), pa.array(methods), pa.array(state.w)], names=["key", "method", "weight"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, kind = batch.column("key").to_pylist(), batch.schema.field("key").type
            y = batch.column("y").to_numpy()
            x = np.stack([batch.column(f"m{i}").to_numpy() for i in range(len(methods))], 1)
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if state is None or keys[a] != now:
                    if state is not None:
                        yield done()
                    now, state = keys[a], State.first(len(methods))
                state.update(x[a:b], y[a:b])
        if state is not None:
            yield done()

    return run

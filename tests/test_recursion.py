"""Recursive forecasts, and the samplers that go round by round: plans that don't grow, results of plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import resample
from gridloom.streaming import stateful
from gridloom.streaming.stateful import Vectors

SITES = {"a": [float(t % 5) for t in range(40)], "b": [float(t % 7) * 2 for t in range(40)], "c": [1.0] * 40}
LAGS, STEPS = [1, 2, 24], 240
TEXT = "0.5 * lag_0 + 0.2 * greatest(lag_1, 1) + 0.25 * lag_2 + 1"


def plain(y):
    y = list(y)
    for _ in range(STEPS):
        y.append(0.5 * y[-1] + 0.2 * max(y[-2], 1) + 0.25 * y[-24] + 1)
    return y[40:]


@pytest.fixture(scope="module")
def series(spark):
    return spark.createDataFrame([(k, t, v) for k, y in SITES.items() for t, v in enumerate(y)] + [("a", 39, -5.0), ("late", 3, 1.0)], "project string, hour long, y double")


MODELS = {"text": TEXT, "vectors": Vectors(lambda x: 0.5 * x[:, 0] + 0.2 * np.maximum(x[:, 1], 1) + 0.25 * x[:, 2] + 1)}


@pytest.mark.parametrize("kind", MODELS)
def test_240_steps_equal_the_loop(spark, series, kind):
    got = {}
    for r in stateful.feedback(series, ["project"], "hour", "y", LAGS, STEPS, MODELS[kind], 39).orderBy("project", "hour").collect():
        got.setdefault(r.project, []).append(r.y_hat)
    assert set(got) == set(SITES) and all(got[k] == pytest.approx(plain(y)) for k, y in SITES.items())  # nothing is known of `late`


def nodes(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())


@pytest.mark.parametrize("kind", MODELS)
def test_the_plan_has_no_part_for_each_step(series, kind):
    of = lambda n: stateful.feedback(series, ["project"], "hour", "y", LAGS, n, MODELS[kind], 39)
    assert nodes(of(1)) == nodes(of(240)) < 20


def test_a_column_model_costs_a_projection_a_step(series):
    model = lambda w: 0.5 * F.col("lag_0") + 0.2 * F.greatest(F.col("lag_1"), F.lit(1)) + 0.25 * F.col("lag_2") + 1
    df = stateful.feedback(series, ["project"], "hour", "y", LAGS, 12, model, 39)
    assert [r.y_hat for r in df.filter("project = 'b'").orderBy("hour").collect()] == pytest.approx(plain(SITES["b"])[:12])
    assert nodes(stateful.feedback(series, ["project"], "hour", "y", LAGS, 6, model, 39)) - nodes(stateful.feedback(series, ["project"], "hour", "y", LAGS, 3, model, 39)) <= 6


@pytest.mark.parametrize("kind", MODELS)
def test_gaps_give_null_and_no_rows_none(spark, series, kind):
    gaps = series.filter("hour <> 16 AND project = 'b'")
    got = [r.y_hat for r in stateful.feedback(gaps, ["project"], "hour", "y", LAGS, 30, MODELS[kind], 39).orderBy("hour").collect()]
    assert got[0] is None and all(y is None for y in got) and len(got) == 30
    assert stateful.feedback(series.filter("false"), ["project"], "hour", "y", LAGS, 5, MODELS[kind], 39).collect() == []
    assert stateful.feedback(series, ["project"], "hour", "y", LAGS, 0, MODELS[kind], 39).collect() == []


def cloud(n, seed, dim=2, classes=3):
    rng = np.random.default_rng(seed)
    label = np.r_[np.zeros(max(2, n // 40), int), rng.integers(1, classes, n)]
    x = rng.normal(0, 1, (len(label), dim)) + (label[:, None] == 0) * 0.5
    ids = rng.permutation(len(label) * 3)[: len(label)]
    return ids, label, x


def sequential(ids, label, x):
    """The store, one row after the other."""
    few, kept = x[label == 0], set(ids[label == 0].tolist())
    for c in set(label.tolist()) - {0}:
        at = np.flatnonzero(label == c)
        at = at[np.argsort(ids[at])]
        far = np.sqrt(((x[at][:, None] - few[None]) ** 2).sum(-1)).min(1)
        own = np.full(len(at), np.inf)
        for i, k in enumerate(at):
            if i == 0 or far[i] < own[i]:
                kept.add(int(ids[k]))
                own = np.minimum(own, np.sqrt(((x[at] - x[k]) ** 2).sum(1)))
    return kept


@pytest.mark.parametrize(("n", "prefix"), [(400, 1), (400, 7), (3000, 64), (3000, 4096), (20_000, 1024)])
def test_condensed_equals_the_sequential_store(spark, n, prefix):
    ids, label, x = cloud(n, n + prefix) if prefix > 1 else cloud(60, 1)
    import pandas as pd

    rows = spark.createDataFrame(pd.DataFrame({"id": ids, "label": label.astype(np.int32), "features": x.tolist()}), "id long, label int, features array<double>")
    assert {r.id for r in resample.condensed(rows.repartition(5), 0, prefix).select("id").collect()} == sequential(ids, label, x)


def test_condensed_without_a_minority_keeps_first_rows(spark):
    rows = spark.createDataFrame([(i, 1 + i % 2, [float(i)]) for i in range(9)], "id long, label int, features array<double>")
    assert sorted(r.id for r in resample.condensed(rows, 0).collect()) == [0, 1]
    assert resample.condensed(rows.filter("false"), 0).collect() == []
    same = spark.createDataFrame([(i, int(i > 2), [1.0, 2.0]) for i in range(9)], "id long, label int, features array<double>")  # all in one place
    assert sorted(r.id for r in resample.condensed(same, 0).collect()) == [0, 1, 2, 3]


def test_rounds_keep_plans_of_one_size(spark):
    rows = spark.createDataFrame([(i, i % 2, [float(i * 37 % 101), float(i * 53 % 97)]) for i in range(300)], "id long, label int, features array<double>")
    one = len(resample.all_knn(rows, 1)._jdf.queryExecution().logical().toString())
    assert len(resample.all_knn(rows, 4)._jdf.queryExecution().logical().toString()) < 1.5 * one
    assert len(resample.repeated_edited(rows)._jdf.queryExecution().logical().toString()) < one

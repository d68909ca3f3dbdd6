"""Kernel machines against the whole kernel matrix and plain descent, stores and samplers against their rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import machines, models


def frame(spark, n, seed, key=lambda i: "s"):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [1.0, 0.4]
    return spark.createDataFrame([(key(i), i, float(a), float(b)) for i, (a, b) in enumerate(x)], "k string, id long, a double, b double"), x


def up_to_sign(a, b, tol):
    return all(min(np.abs(a[:, i] - b[:, i]).max(), np.abs(a[:, i] + b[:, i]).max()) < tol for i in range(a.shape[1]))


def test_components_with_all_landmarks_are_exact(spark):
    df, _ = frame(spark, 120, 1, lambda i: "st"[i % 2])
    got = {(r.k, r.id): r.components for r in machines.components(df, "k", ["a", "b"], 0.5).collect()}
    want = {(r.k, r.id): r.components for r in models.kernel_components(df, "k", ["a", "b"], 0.5).collect()}
    assert set(got) == set(want)
    for k in "st":
        ids = sorted(i for key, i in got if key == k)
        assert up_to_sign(np.array([got[k, i] for i in ids]), np.array([want[k, i] for i in ids]), 1e-5)


def test_components_of_more_rows_than_a_matrix_may_have(spark, monkeypatch):
    """4000 rows in four parts, 60 landmarks: the error against the exact kernel is measured."""
    monkeypatch.setattr(machines, "in_parts", lambda rows, make=machines.in_parts: make(rows, 1000))
    df, x = frame(spark, 4000, 2)
    rows = sorted(machines.components(df, "k", ["a", "b"], 0.2, most=60).collect(), key=lambda r: r.id)
    got = np.array([r.components for r in rows])
    k = machines.gaussian(x, x, 0.2)
    centred = k - k.mean(0)[None] - k.mean(1)[:, None] + k.mean()
    v = np.random.default_rng(0).normal(size=(4000, 2))
    for _ in range(60):
        v, _ = np.linalg.qr(centred @ v)
    value = np.diag(v.T @ centred @ v)
    assert len(got) == 4000 and up_to_sign(got, v * np.sqrt(value), 0.02 * np.sqrt(value[0] / 4000) * 4)
    phi = machines.gaussian(x, x[:60], 0.2) @ machines.whitener(x[:60], 0.2)
    assert np.abs(phi @ phi.T - k).max() < 0.2 and np.abs(phi @ phi.T - k).mean() < 0.01
    assert machines.components(df.filter("false"), "k", ["a", "b"], 0.2).collect() == []


def plain(x, y, penalty, epsilon):
    """The objective's least value by descent with shrinking steps, from several starts."""
    one = np.c_[np.ones(len(x)), x]
    f = lambda w: 0.5 * w[1:] @ w[1:] + penalty * np.maximum(0, np.abs(y - one @ w) - epsilon).sum()
    w = np.linalg.lstsq(one, y, rcond=None)[0]
    best, at = f(w), w
    for t in range(40_000):
        e = y - one @ w
        g = np.r_[0, w[1:]] - penalty * one.T @ (np.sign(e) * (np.abs(e) > epsilon))
        w = w - 0.5 / (1 + t) ** 0.7 * g / (np.linalg.norm(g) + 1e-12)
        if f(w) < best:
            best, at = f(w), w
    return best, at


@pytest.mark.parametrize(("penalty", "epsilon"), [(1.0, 0.2), (0.05, 0.5), (5.0, 0.0)])
def test_support_regression_is_least(spark, penalty, epsilon):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    y = 1 + x @ [2.0, -1.0] + rng.standard_t(2, 300) * 0.3
    rows = [(float(a), float(b), float(t)) for (a, b), t in zip(x, y, strict=True)] + [(None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "a double, b double, y double").repartition(3)
    model, cost = machines.support_regression(df, ["a", "b"], "y", penalty, epsilon)
    want, _ = plain(x, y, penalty, epsilon)
    e = y - model.intercept - x @ model.weights
    assert cost == pytest.approx(0.5 * model.weights @ model.weights + penalty * np.maximum(0, np.abs(e) - epsilon).sum(), rel=1e-6)
    assert cost < want * 1.01


def test_nu_leaves_its_share_outside(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=600)
    y = 3 * x + rng.normal(0, 1, 600)
    df = spark.createDataFrame([(float(a), float(t)) for a, t in zip(x, y, strict=True)], "a double, y double")
    model, _ = machines.support_regression(df, ["a"], "y", 1.0, nu=0.3, rounds=25)
    e = np.abs(y - model.intercept - model.weights[0] * x)
    assert abs(model.weights[0] - 3) < 0.2
    assert abs(model.intercept) < 0.2 and 0.5 < np.median(e) < 0.9


def test_kernel_support_regression(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-2, 2, 3000)
    y = np.sin(2 * x) + rng.normal(0, 0.05, 3000)
    df = spark.createDataFrame([(float(a), float(t)) for a, t in zip(x, y, strict=True)], "a double, y double")
    wide, names = machines.landmark_features(df, ["a"], machines.landmarks(df, ["a"], 40), 2.0)
    model, _ = machines.support_regression(wide, names, "y", 10.0, 0.05, rounds=30)
    mae = wide.agg(F.avg(F.abs(F.col("y") - model.column()))).collect()[0][0]
    assert mae < 0.06 and wide.columns == ["a", "y", *names]

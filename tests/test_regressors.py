"""Sums by fold in one pass, permutation importances and grids over Spark's estimators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import regress


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    y = 3 * x[:, 0] - x[:, 1] + rng.normal(0, 0.1, 600)
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))] + [(900, None, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(3)


def test_folds_in_one_pass_equal_passes_by_fold(df):
    pairs = regress.fold_moments(df, ["a", "b", "c"], "y", "id", 4)
    for k, (train, test) in enumerate(pairs):
        own = F.pmod(F.xxhash64("id"), F.lit(4)) == k
        assert np.allclose(test.products, regress.moments(df.filter(own), ["a", "b", "c"], "y").products)
        assert np.allclose(train.products, regress.moments(df.filter(~own), ["a", "b", "c"], "y").products)
    assert sum(t.n for _, t in pairs) == 600
    empty = regress.moments(df.filter("false"), ["a", "b"], "y")
    assert empty.n == 0 and empty.products.shape == (4, 4)


def test_permutation_importances_of_a_known_model(df):
    model = lambda f: f.withColumn("prediction", 3 * F.col("a") - F.col("b"))
    got = regress.permutation_importances(df, ["a", "b", "c"], "y", "id", model)
    rows = df.dropna().toPandas()
    # of two independent draws of x: mean of (w (x' - x))^2 is twice w^2 var(x)
    assert got["a"] == pytest.approx(2 * 9 * rows["a"].var(), rel=0.15) and got["b"] == pytest.approx(2 * rows["b"].var(), rel=0.2) and got["c"] == 0
    assert got == pytest.approx(regress.permutation_importances(df.repartition(5), ["a", "b", "c"], "y", "id", model))
    fitted = regress.regressor("tree", ["a", "b", "c"], "y", maxDepth=6).fit(df.dropna())
    tree = regress.permutation_importances(df, ["a", "b", "c"], "y", "id", fitted.transform)
    assert tree["a"] > tree["b"] > tree["c"] and tree["c"] < 0.5


def test_grid_over_estimators(df):
    best, model, trials = regress.searched_regressor("elastic_net", df.dropna(), ["a", "b", "c"], "y", "id", {"regParam": [0.0, 1.0, 10.0], "elasticNetParam": [0.5]}, n_folds=2)
    assert best == {"regParam": 0.0, "elasticNetParam": 0.5} and len(trials) == 3
    assert sorted(e for _, e in trials) == [e for _, e in trials]
    assert np.allclose(model.stages[-1].coefficients.toArray(), [3, -1, 0], atol=0.05)

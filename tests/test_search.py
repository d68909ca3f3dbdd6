"""Sequential searches, SQL functions, and models by group."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import registry
from gridloom.operators import bayes, evolve, linking, models, search
from gridloom.sources import stores


def bowl(point):
    x, k, c = point
    return (x - 0.3) ** 2 + 0.05 * abs(k - 3) + (0 if c == "b" else 0.5)


SPACE = [bayes.Real(-1.0, 1.0), bayes.Integer(0, 8), bayes.Categorical(("a", "b", "c"))]


@pytest.mark.parametrize("kind", sorted(bayes.SURROGATES))
def test_surrogates_find_the_bowl(kind):
    o = bayes.minimise(lambda points: [bowl(p) for p in points], SPACE, calls=45, surrogate=kind, start=12, candidates=200)
    point, cost = o.best()
    assert cost < (0.5 if kind == "dummy" else 0.16) and len(o.y) == 45
    assert all(-1 <= p[0] <= 1 and 0 <= p[1] <= 8 and p[2] in "abc" for p in o.x)


def test_branin_as_one_job_a_batch(spark):
    o = bayes.minimise(evolve.scored_on(spark, search.branin), [bayes.Real(-5.0, 10.0), bayes.Real(0.0, 15.0)], calls=40, batch=8, start=16)
    assert o.best()[1] < 1.5


@pytest.mark.parametrize("kernel", sorted(bayes.KERNELS))
def test_processes_pass_through_their_points(kernel):
    x = np.array([[0.0], [0.15], [0.4], [0.7], [0.95]])
    y = np.sin(5 * x[:, 0])
    mean, std = bayes.GaussianProcess(kernel, noises=(1e-8,)).fit(x, y).predict(x)
    assert np.abs(mean - y).max() < 0.05 and std.max() < 0.2


def test_acquisition_of_normal_values():
    mean, std = np.array([0.0, 0.0]), np.array([1.0, 1e-9])
    assert np.allclose(bayes.gain("ei", mean, std, 0.0, 0.0)[0], 1 / math.sqrt(2 * math.pi)) and np.allclose(bayes.gain("pi", mean, std, 0.0, 0.0)[0], 0.5)
    assert bayes.gain("ei", mean, std, 0.0, 0.0, seconds=np.array([2.0, 1.0]))[0] == bayes.gain("ei", mean, std, 0.0, 0.0)[0] / 2


def test_dimensions_and_stops(spark, tmp_path):
    log = bayes.Real(1e-3, 10.0, log=True)
    assert abs(log.value(log.unit(0.5)) - 0.5) < 1e-12 and bayes.Integer(2, 9).value(bayes.Integer(2, 9).unit(7)) == 7 and SPACE[2].value(SPACE[2].unit("c")) == "c"
    o = bayes.minimise(lambda points: [0.0] * len(points), [bayes.Real(0.0, 1.0)], calls=40, start=6, stop=bayes.stops_at(1e-3))
    assert len(o.y) == 6
    o = bayes.minimise(lambda points: [(p[0] - 0.4) ** 2 for p in points], [bayes.Real(0.0, 1.0), bayes.Real(0.0, 1.0)], calls=25)
    point, cost = bayes.expected_minimum(o)
    line = bayes.partial_dependence(o, 0)
    assert abs(point[0] - 0.4) < 0.15 and cost < 0.05 and abs(min(line, key=lambda v: v[1])[0] - 0.4) < 0.2
    stores.dump_search(o.state(), str(tmp_path / "s"), spark)
    again = bayes.Optimizer(o.space)
    state = stores.load_search(str(tmp_path / "s"), spark)
    again.tell(state["x"], state["y"])
    assert again.best() == o.best() and registry.named(["a", "b"])(lambda a, b: a - b)([3, 1]) == 2


def test_sql_functions(spark):
    assert len(registry.register(spark)) == 5
    registry.register_batch(spark, "twice", lambda s: s * 2, "double")
    r = spark.sql("SELECT gl_wind_speed(3, 4) AS ws, gl_wind_direction(0, 1) AS wd, gl_gauss(1, 1, 2) AS g, twice(2.5D) AS t").collect()[0]
    assert (r.ws, r.wd, r.g, r.t) == (5.0, 180.0, 1.0, 5.0)
    assert abs(spark.sql("SELECT gl_rmse(y, h) AS e FROM VALUES (1D, 2D), (3D, 3D) AS t(y, h)").collect()[0].e - math.sqrt(0.5)) < 1e-12
    assert [(x.lag, x.at) for x in spark.sql("SELECT * FROM gl_lags(100L, array(1, 24))").collect()] == [(1, 99), (24, 76)]


def test_models_by_group(spark):
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, 200)
    rows = [("s", i, float(v), float(np.sin(6 * v) + rng.normal(0, 0.05))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, id long, x double, y double")
    got = models.width_sweep(df, "k", ["x"], "y", [0.05, 3.0, 200.0], centres=10).collect()
    assert len(got) == 3 and [r.width for r in got if r.best] == [3.0] and max(r.centres for r in got) <= 10
    line = df.withColumn("y", 2 * F.col("x") + 1 + F.col("y") * 0)
    q = {r.q: r for r in models.quantile_fits(line, "k", ["x"], "y", [0.1, 0.9]).collect()}
    assert abs(q[0.1].intercept - 1) < 1e-3 and abs(q[0.9].weights[0] - 2) < 1e-3
    spread = models.quantile_fits(df, "k", ["x"], "y", [0.1, 0.9]).collect()
    under = [sum(y < r.intercept + r.weights[0] * v for _, _, v, y in rows) / 200 for r in spread]
    assert abs(under[0] - 0.1) < 0.03 and abs(under[1] - 0.9) < 0.03
    parts = models.kernel_components(df.filter("id < 50"), "k", ["x"], 2.0).collect()
    c = np.array([r.components for r in sorted(parts, key=lambda r: r.id)])
    assert c.shape == (50, 2) and abs(c.mean(0)).max() < 1e-9 and abs(c[:, 0] @ c[:, 1]) < 1e-6
    with pytest.raises(Exception, match="more than 10"):
        models.kernel_components(df, "k", ["x"], 2.0, rows=10).collect()
    params = spark.createDataFrame([("a", "RF", "1"), ("a", "EN", "2"), ("b", "RF", "3")], "project string, method string, params string")
    donors = spark.createDataFrame([("b", "a")], "project string, donor string")
    assert {(r.project, r.method, r.params, r.transferred) for r in models.transferred(params, donors).collect()} == {("a", "RF", "1", False), ("a", "EN", "2", False), ("b", "RF", "3", False), ("b", "EN", "2", True)}


def test_transfer_groups_of_two_thresholds():
    corr = {("a", "b"): 0.95, ("b", "c"): 0.93, ("a", "c"): 0.5, ("d", "e"): 0.92, ("c", "d"): 0.2, ("e", "f"): 0.86}
    got = linking.grouped(corr, 0.9)
    assert sorted(map(sorted, got)) == [["a", "b", "c"], ["d", "e"]]
    assert sorted(map(sorted, linking.grouped(corr, 0.85))) == [["a", "b", "c"], ["d", "e", "f"]]
    nested = linking.settled([{"a", "b"}, {"a", "b", "c"}, {"c", "d"}], {("a", "b"): 0.9, ("b", "c"): 0.8, ("a", "c"): 0.7, ("c", "d"): 0.95})
    assert sorted(map(sorted, nested)) == [["a", "b", "c"]] or sorted(map(sorted, nested)) == [["a", "b"], ["c", "d"]]


def test_second_stage_is_around_the_best(spark):
    trials = spark.createDataFrame([("a", "rule.0", 1.0, 5.0, 0.3), ("a", "rule.0", 2.0, 5.0, 0.1), ("b", "rule.0", 3.0, 7.0, 0.2)], "project string, rule string, lr double, width double, acc double")
    got = search.second_stage(trials, {"lr": 0.5, "width": 1.0}).collect()
    assert len(got) == 18 and {r.lr for r in got if r.project == "a"} == {1.5, 2.0, 2.5} and {r.device for r in got} == {0, 1}


def test_selection_and_centres(spark):
    from gridloom.operators import alternating, regress

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3))
    rows = [(i, *map(float, r), float(r[0]), 1.0, float(2 * r[0] - r[1])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, twin double, one double, y double")
    names = ["a", "b", "c", "twin", "one"]
    assert regress.selected("none", df, names, "y", "id") == names
    assert {"a", "b"} <= set(regress.selected("forward", df, ["a", "b", "c"], "y", "id"))
    got = regress.selected("boruta", df, names, "y", "id", n_folds=2, rounds=2, trees=8)
    assert "a" in got and not {"twin", "one"} & set(got)
    with pytest.raises(ValueError, match="no such method"):
        regress.selected("x", df, names, "y", "id")
    v = spark.createDataFrame([(i, [float(i % 2 * 5), float(i % 7)]) for i in range(40)], "id long, features array<double>")
    assert np.isfinite(alternating.rbf_centres(v, 2)).all()
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(10)], "id long, features array<double>")
    assert len(alternating.rbf_centres(same, 1)) == 1

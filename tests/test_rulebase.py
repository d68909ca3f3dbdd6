"""The rule base's search: costs against plain numpy, jobs that don't grow with the population, steps within bounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import evolve, rulebase, rules


def rows(n, seed):
    rng = np.random.default_rng(seed)
    x, z, y = rng.random(n), rng.normal(size=n), None
    y = np.where(x < 0.5, 2 * z + 1, -z) + rng.normal(0, 0.1, n)
    return x, z, y


def frame(spark, n, seed):
    return spark.createDataFrame([tuple(map(float, r)) for r in zip(*rows(n, seed), strict=True)], "x double, z double, y double")


def plain(train, test, p, least, share, rated):
    """Costs and the number of rules of one individual of three functions: two gausses and a trapezoid."""

    def acts(x):
        a, b, c, d = sorted(p[4:])
        trap = np.array([0 if v < a or v > d else 1 if b <= v <= c else (v - a) / (b - a) if v < b else (d - v) / (d - c) for v in x])
        return [np.sqrt(m) >= 0.01 for m in (np.exp(-((x - p[0]) ** 2) / (2 * p[1] ** 2)), np.exp(-((x - p[2]) ** 2) / (2 * p[3] ** 2)), trap)]

    (x, z, y), (tx, tz, ty) = train, test
    total, n, good = np.zeros(len(tx)), np.zeros(len(tx)), 0
    for on, at in zip(acts(x), acts(tx), strict=True):
        if not least < on.sum() < share * len(x):
            continue
        good += 1
        w = np.linalg.lstsq(np.c_[np.ones(on.sum()), x[on], z[on]], y[on], rcond=None)[0]
        total += np.where(at, np.c_[np.ones(len(tx)), tx, tz] @ w, 0)
        n += at
    e = (np.where(n > 0, total / np.maximum(n, 1), evolve.NONE_ACTIVE) - ty) / rated
    return (e**2).sum(), np.abs(e).mean(), good


BASE = {"rule.0": [rules.Membership("x", "gauss", (0.2, 0.08))], "rule.1": [rules.Membership("x", "gauss", (0.8, 0.08))], "rule.2": [rules.Membership("x", "trap", (0.3, 0.4, 0.6, 0.7))]}


def test_costs_equal_plain_numpy(spark):
    rng = np.random.default_rng(4)
    population = [rulebase.start_of(BASE), [0.1, -0.05, 0.9, 0.06, 0.7, 0.2, 0.6, 0.4], [0.5, 2.0, 9.0, 0.01, 0, 0, 1, 1]]
    population += [[*rng.random(1), 0.1, *rng.random(1), 0.1, *rng.random(4)] for _ in range(5)]
    problem = rulebase.Problem(frame(spark, 1500, 1).repartition(3), frame(spark, 700, 2), BASE, ["x", "z"], "y", 2.0, least=30, share=0.9)
    got = {r.individual: (r.squares, r.mean, r.rules) for r in problem.costs(population).collect()}
    for i, p in enumerate(population):
        assert got[i] == pytest.approx(plain(rows(1500, 1), rows(700, 2), p, 30, 0.9, 2.0), rel=1e-6), i


def jobs(spark, run):
    group = f"g{np.random.default_rng().integers(1 << 60)}"
    spark.sparkContext.setJobGroup(group, "counted")
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_a_generation_is_a_fixed_number_of_jobs(spark):
    problem = rulebase.Problem(frame(spark, 600, 1), frame(spark, 300, 2), BASE, ["x", "z"], "y", least=10, share=0.9)
    p = rulebase.start_of(BASE)
    one, many = (jobs(spark, lambda n=n: problem.score([[v + 0.01 * k for v in p] for k in range(n)])) for n in (1, 40))
    assert one == many <= 3  # a pass over the training rows, one over the test rows and its sums


def test_empty_tables_and_nulls(spark):
    none = frame(spark, 5, 1).filter("false")
    problem = rulebase.Problem(none, frame(spark, 20, 2), BASE, ["x", "z"], "y", least=0, share=2)
    assert problem.costs([rulebase.start_of(BASE)]).first().rules == 0
    assert rulebase.Problem(frame(spark, 50, 1), none, BASE, ["x", "z"], "y").costs([rulebase.start_of(BASE)]).collect() == []
    gaps = frame(spark, 300, 1).withColumn("z", F.when(F.col("z") > 0, F.col("z")))
    full = rulebase.Problem(gaps.dropna(), gaps, BASE, ["x", "z"], "y", least=5, share=0.9).score([rulebase.start_of(BASE)])
    assert rulebase.Problem(gaps, gaps, BASE, ["x", "z"], "y", least=5, share=0.9).score([rulebase.start_of(BASE)])[0] == pytest.approx(full[0])


def test_search_lowers_the_error(spark):
    train, test = frame(spark, 1500, 1), frame(spark, 700, 2)
    start = {"rule.0": [rules.Membership("x", "gauss", (0.35, 0.2))], "rule.1": [rules.Membership("x", "gauss", (0.65, 0.2))]}
    problem = rulebase.Problem(train, test, start, ["x", "z"], "y", least=20, share=0.999)
    before = rulebase.Problem(train, test, start, ["x", "z"], "y", least=20, share=1.1).score([rulebase.start_of(start)])[0]
    found, cost, front = rulebase.searched(problem, {"x": (0.0, 1.0)}, evolve.Settings(parents=10, children=16, generations=6, cross=0.6, change=0.4, seed=2))
    assert cost[0] < 0.5 * before[0] and set(found) == set(start)
    assert problem.score([rulebase.start_of(found)])[0] == pytest.approx(cost) and min(c for _, c in front) == cost
    again = rulebase.searched(problem, {"x": (0.0, 1.0)}, evolve.Settings(parents=10, children=16, generations=6, cross=0.6, change=0.4, seed=2))
    assert again[1] == pytest.approx(cost)  # the seed decides


def test_steps_stay_within_bounds():
    rng = np.random.default_rng(3)
    low, high, spread = rulebase.bounds(BASE, {"x": (0.0, 1.0)})
    assert (low < high).all() and len(low) == len(rulebase.start_of(BASE))
    x = np.clip(np.array(rulebase.start_of(BASE)), low, high)
    moved = 0
    for _ in range(500):
        y = np.clip(rulebase.stepped(rng, x, low, high, spread), low, high)
        moved += (y != x).mean()
        assert (y >= low).all() and (y <= high).all() and np.isfinite(y).all()
    assert 0.4 < moved / 500 < 0.7
    a, b = np.zeros(8), np.ones(8)
    for _ in range(200):
        c = rulebase.mated(rng, a, b)
        assert (c >= -0.5).all() and (c <= 1.5).all()

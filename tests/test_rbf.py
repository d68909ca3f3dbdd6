"""Radial-basis models from summed products, against orthogonal least squares on the whole matrix of functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import evolve, models, rbf


def classical(x, t, centres, width, most):
    """Choice and weights by Gram-Schmidt on the functions of all rows."""
    phi = np.exp(-(((x[:, None] - centres[None]) * width) ** 2).sum(-1))
    chosen, rest = [], phi.copy()
    first = (phi**2).sum(0)
    for _ in range(min(most, len(centres))):
        power = (rest**2).sum(0)
        gain = np.where(power > 1e-9 * first, (rest.T @ t) ** 2 / np.maximum(power, 1e-300), -1)
        gain[chosen] = -1
        k = int(gain.argmax())
        if gain[k] <= 1e-12 * (t @ t + 1e-12):
            break
        q = rest[:, k] / np.sqrt(power[k])
        rest = rest - np.outer(q, q @ rest)
        chosen.append(k)
    w = np.linalg.lstsq(phi[:, chosen], t, rcond=None)[0]
    return centres[chosen], w, ((t - phi[:, chosen] @ w) ** 2).sum()


def data(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 2)).round(3)
    return x, np.sin(5 * x[:, 0]) + 0.3 * x[:, 1] + rng.normal(0, 0.05, n).round(4)


@pytest.fixture(scope="module")
def df(spark):
    rows = []
    for key, n in (("a", 400), ("b", 150)):
        x, y = data(n, n)
        rows += [(key, float(p), float(q), float(t), "w", 1) for (p, q), t in zip(x, y, strict=True)]
    rows += rows[:60] + [("a", None, 0.1, 0.2, "w", 1), ("b", 0.3, 0.1, None, "w", 1), ("none", None, None, 1.0, "w", 1)]
    return spark.createDataFrame(rows, "site string, p double, q double, t double, widths string, n int")


def of(df, key):
    rows = df.filter((F.col("site") == key)).dropna().collect()
    return np.array([[r.p, r.q] for r in rows]), np.array([r.t for r in rows])


@pytest.mark.parametrize("part_rows", [40, 20_000])
def test_sums_of_parts_equal_the_whole_matrix(df, monkeypatch, part_rows):
    rows = rbf.distinct_rows(df, "site", ["p", "q"], "t")
    centres = rbf.candidate_centres(rows, 40)
    widths = rbf.same_widths(rows, [[1.5], [4.0], [2.0, 0.5]])
    got = {(r.key, r.w): r for r in rbf.fitted(rbf.in_parts(rows, part_rows), centres, widths, 12).collect()}
    assert set(got) == {(k, w) for k in "ab" for w in range(3)}
    for r in centres.collect():
        x, t = of(df, r.key)
        for w, width in enumerate(([1.5], [4.0], [2.0, 0.5])):
            c, weights, sse = classical(x, t, np.array(r.centres), np.array(width), 12)
            m = got[r.key, w]
            assert m.n == len(x) and np.allclose(m.centres[:5], c[:5]) and m.sse == pytest.approx(sse, rel=1e-4, abs=1e-6) and m.width == width


def test_all_rows_are_fitted_and_all_may_be_centres(df):
    got = models.rbf_ols(df, "site", ["p", "q"], "t", 3.0).collect()
    assert {r.site for r in got} == {"a", "b"} and max(r.step for r in got) < 48
    for key in "ab":
        x, t = of(df, key)
        own = sorted((r for r in got if r.site == key), key=lambda r: r.step)
        guess = np.exp(-(((x[:, None] - np.array([r.centre for r in own])[None]) * 3.0) ** 2).sum(-1)) @ np.array([r.weight for r in own])
        _, _, sse = classical(x, t, np.unique(x, axis=0), 3.0, 48)
        assert ((t - guess) ** 2).sum() < 1.05 * sse


def test_more_rows_than_any_cap(spark):
    """Rows that a cap of 3000 would have left out decide the fit."""
    x, y = data(3000, 1)
    far, late = data(6000, 2)
    rows = [("s", *map(float, p), float(t)) for p, t in zip(x, y, strict=True)] + [("s", *map(float, p), float(t) + 2) for p, t in zip(far, late, strict=True)]
    big = spark.createDataFrame(rows, "k string, p double, q double, t double")
    got = rbf.distinct_rows(big, "k", ["p", "q"], "t")
    m = rbf.fitted(rbf.in_parts(got, 1000), rbf.candidate_centres(got, 64), rbf.same_widths(got, [[3.0]])).collect()[0]
    assert m.n == 9000 and len(m.centres) <= 48
    guess = np.exp(-(((x[:, None] - np.array(m.centres)[None]) * 3.0) ** 2).sum(-1)) @ np.array(m.weights)
    assert abs((guess - y).mean() - 4 / 3) < 0.05  # two thirds of the rows lie 2 above


def test_errors_and_forecasts_agree(df):
    rows = rbf.distinct_rows(df, "site", ["p", "q"], "t")
    fit = rbf.fitted(rbf.in_parts(rows), rbf.candidate_centres(rows, 60), rbf.same_widths(rows, [[2.0, 3.0]])).persist()
    judged = {r.key: r for r in rbf.errors(rbf.in_parts(rows, 50), fit).collect()}
    out = rbf.forecast(df, "site", ["p", "q"], fit)
    assert out.columns == [*df.columns, "y_hat"] and out.count() == df.count()
    sums = {r.site: r for r in out.dropna().groupBy("site").agg(F.sum((F.col("t") - F.col("y_hat")) ** 2).alias("sse"), F.avg(F.abs(F.col("t") - F.col("y_hat"))).alias("mae")).collect()}
    for r in fit.collect():
        assert judged[r.key].sse == pytest.approx(r.sse, rel=1e-5) == sums[r.key].sse and judged[r.key].mae == pytest.approx(sums[r.key].mae)
    assert out.filter("site = 'none' OR p IS NULL").filter("y_hat IS NOT NULL").count() == 0


def jobs(spark, run):
    group = f"g{np.random.default_rng().integers(1 << 60)}"
    spark.sparkContext.setJobGroup(group, "counted")
    run()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_widths_cost_no_further_pass(spark, df):
    rows = rbf.distinct_rows(df, "site", ["p", "q"], "t")
    parts, centres = rbf.in_parts(rows).persist(), rbf.candidate_centres(rows, 20).persist()
    parts.count(), centres.count()
    one, many = (jobs(spark, lambda n=n: rbf.fitted(parts, centres, rbf.same_widths(rows, [[1.0 + k] for k in range(n)])).collect()) for n in (1, 12))
    assert one == many


def test_sweep_finds_the_width(df):
    got = rbf.swept(df, "site", ["p", "q"], "t", [0.01, 3.0, 300.0], most=20, candidates=100).collect()
    assert len(got) == 6 and {(r.site, r.width) for r in got if r.best} == {("a", 3.0), ("b", 3.0)}


def test_search_by_feature(spark):
    """The second feature doesn't matter, so its width should be small, or its search no worse than one width for both."""
    x, _ = data(500, 9)
    t = np.sin(9 * x[:, 0])
    one = spark.createDataFrame([("s", *map(float, p), float(v)) for p, v in zip(x, t, strict=True)] + [("u", *map(float, p[::-1]), float(v)) for p, v in zip(x, t, strict=True)], "k string, p double, q double, t double")
    got = {r.k: r for r in rbf.searched(one, "k", ["p", "q"], "t", settings=evolve.Settings(parents=8, children=10, generations=5, seed=3), most=8, candidates=60).collect()}
    assert got["s"].width[0] > 2 * got["s"].width[1] and got["u"].width[1] > 2 * got["u"].width[0]
    shared = rbf.swept(one, "k", ["p", "q"], "t", [0.5, 1.0, 2.0, 4.0, 8.0], most=8, candidates=60).filter("best").collect()
    assert all(got[r.k].sse < r.sse for r in shared)
    assert rbf.searched(one.filter("false"), "k", ["p", "q"], "t", settings=evolve.Settings(parents=2, children=2, generations=1)).collect() == []

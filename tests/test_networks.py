"""Networks over all rows: gradients, coverage of the quantiles, parts and copies, forecasts in generated code."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import networks as N


def test_gradient_equals_differences():
    rng = np.random.default_rng(1)
    x, y, n, qs = rng.normal(size=(20, 3)), rng.normal(size=20), rng.integers(1, 4, 20).astype(float), (0.1, 0.7)
    p = N.first(3, 4, 3, 5)

    def loss(p):
        w1, b1, w2, b2 = N.unpacked(p, 3, 4, 3)
        e = y[:, None] - (np.tanh(x @ w1 + b1) @ w2 + b2)
        each = e[:, 0] ** 2 + sum(np.maximum(q * e[:, i + 1], (q - 1) * e[:, i + 1]) for i, q in enumerate(qs))
        return (each * n).sum() / n.sum()

    g = N.gradient(p, x, y, n, 4, qs)
    for k in range(len(p)):
        step = np.eye(len(p))[k] * 1e-6
        assert g[k] == pytest.approx((loss(p + step) - loss(p - step)) / 2e-6, abs=1e-4)


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(2)
    rows = []
    for key, n in (("a", 4000), ("b", 800)):  # above the 3000 of any cap
        x = rng.uniform(-1, 1, (n, 2))
        y = np.sin(3 * x[:, 0]) + x[:, 1] + rng.normal(0, 1, n) * (0.1 + 0.3 * (x[:, 0] > 0))
        rows += [(key, *map(float, r), float(t)) for r, t in zip(x, y, strict=True)]
    rows += [("c", 1.0, 2.0, 5.0)] * 3 + [("a", None, 1.0, 1.0), ("d", None, None, 1.0), ("b", 0.5, 0.5, None)]
    return spark.createDataFrame(rows, "site string, u double, v double, t double")


@pytest.fixture(scope="module")
def models(df):
    out = N.fit(df, "site", ["u", "v"], "t", hidden=10, rounds=5, part_rows=1500).persist()
    assert {r.site for r in out.collect()} == {"a", "b", "c"}
    return out


def test_quantiles_cover_their_shares(df, models):
    out = N.forecast(df, "site", ["u", "v"], models).dropna().filter("site <> 'c'")
    shares = [F.avg((F.col("t") <= F.col("q")[i]).cast("double")).alias(f"s{i}") for i in range(9)]
    for r in out.groupBy("site").agg(*shares, F.avg((F.col("t") - F.col("y_hat")) ** 2).alias("e"), F.var_pop("t").alias("v")).collect():
        assert all(abs(r[f"s{i}"] - (i + 1) / 10) < 0.05 for i in range(9)), r
        assert r.e < 0.2 * r.v
    # both halves of the first feature, though their spread differs
    for r in out.filter("site = 'a'").groupBy((F.col("u") > 0).alias("wide")).agg(*shares).collect():
        assert all(abs(r[f"s{i}"] - (i + 1) / 10) < 0.09 for i in range(9)), r
    assert out.filter(~F.forall(F.sequence(F.lit(0), F.lit(7)), lambda i: F.get("q", i) <= F.get("q", i + 1))).count() == 0


def test_forecasts_equal_numpy(df, models):
    got = N.forecast(df, "site", ["u", "v"], models)
    assert got.columns == [*df.columns, "y_hat", "q"] and got.count() == df.count()
    for m in models.collect():
        rows = got.filter(F.col("site") == m.site).filter("u IS NOT NULL AND v IS NOT NULL").limit(50).collect()
        want = N.outputs(np.array([[r.u, r.v] for r in rows]), m.asDict(), 10)
        assert np.allclose([[r.y_hat, *r.q] for r in rows], want)
    assert got.filter("site = 'd' OR u IS NULL").filter("y_hat IS NOT NULL OR q IS NOT NULL").count() == 0
    assert [r.y_hat for r in got.filter("site = 'c'").collect()] == pytest.approx([5.0] * 3, abs=0.02)  # a constant


def test_models_that_are_too_many_to_broadcast(df, models, monkeypatch):
    few = df.limit(200).union(df.filter("site <> 'a' AND t < 0.2 OR u IS NULL"))
    of = lambda: sorted(str((r.site, r.u, r.v, r.t, r.y_hat and round(r.y_hat, 6), r.q and [round(x, 6) for x in r.q])) for r in N.forecast(few, "site", ["u", "v"], models).collect())
    want = of()
    monkeypatch.setattr(N, "BROADCAST_MODELS", 1)
    assert of() == want


def test_partitions_do_not_matter_and_copies_count(spark, df):
    small = df.filter("site = 'b'").limit(400)
    options = {"hidden": 4, "rounds": 2, "quantiles": (0.5,), "part_rows": 150}
    one = N.fit(small, "site", ["u", "v"], "t", **options).collect()[0].p
    assert np.allclose(one, N.fit(small.repartition(7), "site", ["u", "v"], "t", **options).collect()[0].p)
    twice = N.fit(small.union(small), "site", ["u", "v"], "t", **options).collect()[0].p
    assert np.allclose(one, twice)
    assert N.fit(small.filter("false"), "site", ["u", "v"], "t", **options).collect() == []


def test_stacking_beats_its_parts(spark):
    rng = np.random.default_rng(4)
    y = rng.normal(0, 1, 1500)
    m1, m2 = y + rng.normal(0, 0.5, 1500) + 1, y + rng.normal(0, 0.5, 1500)
    wide = spark.createDataFrame([("s", i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, m1, m2, strict=True))], "site string, hour int, y double, m1 double, m2 double")
    out = N.stacked(wide, ["site", "hour"], ["m1", "m2"], "site", hidden=8, rounds=5, quantiles=(0.1, 0.9))
    e = out.agg(F.avg((F.col("y") - F.col("y_hat")) ** 2)).collect()[0][0]
    assert out.columns == ["site", "hour", "y", "y_hat", "q"] and e < 0.8 * min(((y - m1) ** 2).mean(), ((y - m2) ** 2).mean())

"""Positional windows in blocks, against plain Python over whole series; ranks, category ties and representatives by their rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import features, halos, oversample, series

KEYS = ("site",)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = {}
    for key, n in (("a", 331), ("b", 7), (None, 40), ("one", 1)):
        t = np.sort(rng.choice(2000, n, replace=False)) - 300
        out[key] = [(int(h), None if rng.random() < 0.3 else float(rng.integers(0, 50))) for h in t]
    return out


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame([(k, t, v, "z") for k, s in rows.items() for t, v in s], "site string, hour long, y double, other string").repartition(3)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(halos, "dealt", lambda rows, reach, make=halos.dealt: make(rows, reach, 16))
    monkeypatch.setattr(series, "STRETCH", 32)


def got(out, *columns):
    found = {}
    for r in out.collect():
        found[r.site, r.hour] = tuple(r[c] for c in columns)
    return found


def test_row_shifts(df, rows):
    out = got(series.row_shifts(df, "hour", [1, -2, 9], keys=KEYS), "shift_1", "shift_m2", "shift_9")
    for k, s in rows.items():
        y = [v for _, v in s]
        for i, (t, _) in enumerate(s):
            assert out[k, t] == tuple(y[i - d] if 0 <= i - d < len(y) else None for d in (1, -2, 9))


def test_backfill(df, rows):
    filled = series.backfill(df, "hour", "y", KEYS)
    assert filled.columns == df.columns
    out = got(filled, "y")
    for k, s in rows.items():
        for i, (t, _) in enumerate(s):
            assert out[k, t] == (next((v for _, v in s[i:] if v is not None), None),)


@pytest.mark.parametrize("half", [2, 11])
def test_smooth(df, rows, half):
    out = got(series.smooth(df.fillna(0.0, subset=["y"]), "hour", "y", half, KEYS), "smooth")
    weight = 0.5 + 0.5 * np.cos(np.pi * np.arange(-half, half + 1) / (half + 1))
    for k, s in rows.items():
        y, n = [v or 0.0 for _, v in s], len(s)
        for i, (t, _) in enumerate(s):
            at = [i + d for d in range(-half, half + 1)]
            at = [-j if j < 0 else 2 * (n - 1) - j if j >= n else j for j in at]
            if any(not max(0, i - half) <= j <= min(n - 1, i + half) for j in at):
                assert out[k, t] == (None,)  # a series shorter than its reflection
            else:
                assert out[k, t][0] == pytest.approx(sum(w * y[j] for w, j in zip(weight, at, strict=True)) / weight.sum())


def test_neighbours_and_holdouts(df, rows):
    out = got(series.neighbours(df, "hour", keys=KEYS), "prev", "next")
    held = got(series.contiguous_holdout(df, "hour", 0.2, 0.5, KEYS), "test")
    for k, s in rows.items():
        of = dict(s)
        for i, (t, _) in enumerate(s):
            assert out[k, t] == (of.get(t - 1), of.get(t + 1))
            first = int(len(s) * 0.5)
            assert held[k, t] == (first <= i <= first + int(len(s) * 0.2),)


def test_a_series_is_several_tasks(spark):
    one = spark.range(2000).select(F.col("id").alias("day"), F.col("id").cast("double").alias("y"))
    placed, size = halos.dealt(halos.numbered(one, "day"), 2)
    assert placed.select(halos.SLOT).distinct().count() >= 125 and size == 16
    assert placed.groupBy(halos.SLOT).count().agg(F.max("count")).collect()[0][0] <= 20
    plan = series.smooth(one, "day", "y", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert halos.SLOT in plan and "Window" in plan


def test_average_ranks(spark):
    rng = np.random.default_rng(2)
    x = np.c_[rng.integers(0, 5, 400), rng.integers(0, 300, 400), np.zeros(400)].astype(float)
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(400, None, 1.0, 0.0)], "id long, a double, b double, c double")
    for most in (10**6, 3):  # broadcast, and by a shuffle
        features.BROADCAST_VALUES = most
        try:
            out = {r.id: r for r in features.average_ranks(table, ["a", "b", "c"]).collect()}
        finally:
            features.BROADCAST_VALUES = 1_000_000
        assert len(out) == 401
        for i, name in enumerate("bc", 1):
            v = np.append(x[:, i], 1.0 if name == "b" else 0.0)
            want = [(v < u).sum() + ((v == u).sum() + 1) / 2 for u in v]
            assert [out[k][f"rank_{name}"] for k in range(401)] == want


def test_category_ties_go_to_the_first_name(spark):
    """Two neighbours of each category: `a` before `ab`, null before both."""
    for names, want in ((["ab", "a", "ab", "a"], "a"), (["b", "a", None, None], None), (["ab", "ab", "a", "c"], "ab")):
        rows = [(i, 1, [0.1 * i, 0.0], c) for i, c in enumerate(["x", *names])] + [(9, 0, [50.0, 0.0], "x")]
        df = spark.createDataFrame(rows, "id long, label int, features array<double>, kind string")
        made = oversample.with_categories(df, 1, 40, ["kind"], k=4).filter("id = 0").collect()
        assert made and {r.kind for r in made} == {want}


def test_categories_count_as_half_a_deviation(spark):
    """The nearest neighbour is the one of the same category, though another is nearer by number."""
    rows = [(0, 1, [0.0], "a"), (1, 1, [0.2], "b"), (2, 1, [0.9], "a"), (3, 1, [4.0], "b"), (4, 1, [5.0], None), (5, 1, [5.3], None), (6, 1, [5.2], "c"), (7, 0, [9.0], "a")]
    df = spark.createDataFrame(rows, "id long, label int, features array<double>, kind string")
    sd = np.std([0, 0.2, 0.9, 4, 5, 5.3, 5.2])
    made = oversample.with_categories(df, 1, 60, ["kind"], k=1).collect()
    for r in made:
        at = {i: x[0] for i, _, x, _ in rows}[r.id]
        kind = {i: c for i, *_, c in rows}[r.id]
        d = {i: abs(x[0] - at) ** 2 + (2 * (sd / 2) ** 2 if c != kind else 0) for i, l, x, c in rows if l == 1 and i != r.id}
        near = min(d, key=lambda i: (d[i], i))
        other = next(x[0] for i, _, x, _ in rows if i == near)
        lo, hi = sorted((at, other))
        assert lo - 1e-9 <= r.features[0] <= hi + 1e-9 and r.kind == next(c for i, *_, c in rows if i == near)
    assert len(made) == 60


def test_representatives_with_any_ids_and_labels(spark):
    """Labels from 1000 on, and negative ids that an encoding of centres could meet."""
    rows = [(-1000, 0, [0.0]), (-2001, 1, [1.0]), (-1, 1000, [5.0]), (-1001, 1000, [7.0]), (-2, 2000, [9.0]), (5, 0, [3.0])]
    df = spark.createDataFrame(rows, "id long, label int, features array<double>")
    centres = spark.createDataFrame([(0, [0.1]), (0, [2.8]), (1, [9.0]), (1000, [6.9]), (2000, [0.0])], "label int, features array<double>")
    assert sorted(r.id for r in oversample.nearest_representatives(df, centres).collect()) == [-2001, -1001, -1000, -2, 5]

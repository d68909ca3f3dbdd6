"""Catalog queries do their whole job: nothing is sampled or capped below the operators' own limits."""

import inspect
import zlib

import numpy as np
import pytest

from gridloom.operators import combine, models, resample
from gridloom.plans import catalog

from . import duck


def test_rbf_ols_keeps_all_rows_and_centres(spark, monkeypatch):
    asked, fit = [], models.rbf_ols

    def seen(*args, **more):
        asked.append(inspect.signature(fit).bind(*args, **more))
        asked[-1].apply_defaults()
        return fit(*args, **more)

    monkeypatch.setattr(models, "rbf_ols", seen)
    rows = catalog.rbf_ols(spark, duck.SF).collect()
    assert (asked[0].arguments["rows"], asked[0].arguments["centres"]) == (3000, 48)
    assert max(r.step for r in rows) >= 12


def test_rls_forgets_by_the_residuals(spark):
    """Against the recursion written out, with the variance and the draws taken anew at each row."""
    rng = np.random.default_rng(1)
    x = rng.uniform(1, 9, (40, 2))
    y = x @ [0.7, 0.3] + rng.normal(0, 0.5, 40)
    rows = spark.createDataFrame([("s", i, float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(40)], "project string, hour long, y double, a double, b double")
    got = {r.method: r.weight for r in combine.rls_weights(rows, "project", "hour", ["a", "b"]).collect()}
    draws, w, p, errors, c = np.random.default_rng(zlib.crc32(b"s")), np.full(2, 0.5), np.eye(2) * 1e-4, [], []
    for _ in range(3):
        for a, b in zip(x, y, strict=True):
            e, sigma = b - w @ a, np.std(errors) ** 2 if errors else 1.0
            c.append(e * e * (a @ p @ a) / (sigma * (1 + a @ p @ a)) if sigma > 0 else np.inf)
            forget = 0.75 + (0.999 - 0.75) * np.mean(draws.chisquare(2, len(c)) > c)
            p = (p - p @ np.outer(a, a) @ p / (forget + a @ p @ a)) / forget
            w = np.maximum(w + p @ a * e, 0)
            w /= w.sum()
            errors.append(e)
    assert np.allclose([got["a"], got["b"]], w, atol=1e-6)


def test_repeated_enn_goes_on_until_nothing_goes(spark, tmp_path):
    """A chain of class 1, held at its end, that loses its first row in each of nine rounds to the rows of class 0 beside it."""
    rows = [(10 * j, 1, [float(j), 0.0]) for j in range(10)] + [(101 + n, 1, [9.9 + n / 10, 0.0]) for n in range(3)]
    rows += [(10 * j + n, 0, [float(j), 1.5 + n / 100]) for j in range(9) for n in range(1, 5)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "made"))
    (sf := tmp_path / "sf").mkdir()
    next((tmp_path / "made").glob("part-*.parquet")).rename(sf / "embeddings.parquet")
    left = catalog.repeated_enn(spark, str(sf))
    assert sorted(r.id for r in left.collect() if r.label == 1) == [90, 101, 102, 103]
    duck.compare(duck.connect(str(sf)), left, catalog.SQL["repeated_enn"])
    assert inspect.signature(resample.repeated_edited).parameters["most"].default is None


@pytest.mark.parametrize(("kind", "targets"), [("mode", [0, 2]), ("all", [0, 1])])
def test_rounds_of_edits_equal_searches_anew(spark, kind, targets):
    """Whole numbers, so that many distances are ties."""
    rng = np.random.default_rng(4)
    label = rng.choice(3, 240, p=[0.5, 0.2, 0.3])
    x = np.round(rng.normal(0, 3, (240, 2)) + 3 * label[:, None])
    rows = spark.createDataFrame([(i, int(label[i]), x[i].tolist()) for i in range(240)], "id long, label int, features array<double>")
    ids, counts, rounds = np.arange(240), np.bincount(label), 0
    while True:
        far = ((x[ids][:, None] - x[ids]) ** 2).sum(2)
        np.fill_diagonal(far, np.inf)
        votes = np.array([np.bincount(v, minlength=3) for v in label[ids][far.argsort(1, kind="stable")[:, :3]]])
        good = votes.argmax(1) == label[ids] if kind == "mode" else votes[np.arange(len(ids)), label[ids]] == 3
        kept = ids[good | ~np.isin(label[ids], [0, 1, 2] if targets is None else targets)]
        now, rounds = np.bincount(label[kept], minlength=3), rounds + 1
        same, ids = len(kept) == len(ids), kept if now.all() else ids
        if same or now.min() < now[counts.argmin()] or not now.all():
            break
    assert rounds > 1 and sorted(r.id for r in resample.repeated_edited(rows, 3, kind, targets).collect()) == ids.tolist()

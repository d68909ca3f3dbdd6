"""Every query with SQL equals it; the others hold their invariants."""

import pytest

import __spark_entry__ as entry
from gridloom.plans import catalog

from . import duck


@pytest.fixture(scope="module")
def db():
    return duck.connect()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, db, name):
    duck.compare(db, catalog.QUERIES[name](spark, duck.SF), catalog.SQL[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 5


def test_all_queries_are_named():
    assert set(catalog.SQL) <= set(catalog.QUERIES) <= set(entry.queries())


def test_smote_stays_between_its_class(spark):
    rows = {r.id: r for r in catalog.vec(spark, duck.SF).collect()}
    made = catalog.smote(spark, duck.SF).collect()
    assert len(made) == 100
    own = [r.features for r in rows.values() if r.label == 1]
    lo, hi = [min(v) for v in zip(*own, strict=True)], [max(v) for v in zip(*own, strict=True)]
    assert all(a - 1e-5 <= x <= b + 1e-5 for r in made for a, x, b in zip(lo, r.features, hi, strict=True))


def test_over_and_under_sampling_reach_their_targets(spark):
    counts = {r.label: r["count"] for r in catalog.vec(spark, duck.SF).groupBy("label").count().collect()}
    over = {r.label: r["count"] for r in catalog.random_over_sampler(spark, duck.SF).groupBy("label").count().collect()}
    under = {r.label: r["count"] for r in catalog.random_under_sampler(spark, duck.SF).groupBy("label").count().collect()}
    assert set(over.values()) == {max(counts.values())}
    assert min(counts.values()) in under.values() and all(under[k] <= counts[k] for k in counts)


def test_rls_weights_are_on_the_simplex(spark):
    rows = catalog.rls_weights(spark, "/root/testdata/sf0.01").collect()
    for site in {r.project for r in rows}:
        w = [r.weight for r in rows if r.project == site]
        assert len(w) == 3 and abs(sum(w) - 1) < 1e-5 and min(w) >= 0

"""Searches of neighbours against brute force, and what they shuffle."""

import numpy as np
import pytest

from gridloom.operators import resample


def frame(spark, ids, labels, x):
    return spark.createDataFrame([(int(i), int(c), v.tolist()) for i, c, v in zip(ids, labels, x, strict=True)], "id long, label int, features array<double>")


def expected(qi, ql, q, xi, xl, x, k, within, farthest):
    out = set()
    for i, c, v in zip(qi, ql, q, strict=True):
        dist = np.sqrt(((v - x) ** 2).sum(1))
        at = np.flatnonzero((xi != i) & ((xl == c) | (not within)))
        order = np.lexsort((-xi[at], -dist[at])) if farthest else np.lexsort((xi[at], dist[at]))
        out |= {(int(i), int(xi[j]), int(xl[j]), float(dist[j]), r + 1) for r, j in enumerate(at[order[:k]])}
    return out


@pytest.mark.parametrize("within", [False, True])
@pytest.mark.parametrize("farthest", [False, True])
def test_searches_equal_brute_force(spark, within, farthest):
    rng = np.random.default_rng(3)
    x, q = np.round(rng.normal(size=(300, 2)), 1), np.round(rng.normal(size=(120, 2)) * 3, 1)  # with ties, and queries far from all rows
    xi, qi, xl, ql = np.arange(300), np.arange(250, 370), rng.integers(0, 3, 300), rng.integers(0, 4, 120)
    got = resample.nearest(frame(spark, qi, ql, q), frame(spark, xi, xl, x), 4, block_rows=40, within=within, farthest=farthest)
    assert {tuple(r) for r in got.collect()} == expected(qi, ql, q, xi, xl, x, 4, within, farthest)


def test_nothing_to_search(spark):
    one, none = frame(spark, [1], [0], np.zeros((1, 2))), frame(spark, [], [], np.zeros((0, 2)))
    assert resample.nearest(one, none, 3).collect() == [] == resample.nearest(none, one, 3).collect() == resample.nearest(one, one, 3).collect()


def shuffled(spark):
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
    return sum(stages.apply(n).shuffleWriteBytes() for n in range(stages.size()))


def test_blocks_are_not_copied_for_each_other(spark):
    """In many dimensions no bound rules a block out, so all 40 meet all; yet a search shuffles a fixed number of copies of its input."""
    x = np.random.default_rng(4).normal(size=(1200, 64))
    rows = frame(spark, range(1200), [0] * 1200, x)
    before = shuffled(spark)
    assert resample.nearest(rows, rows, 2, block_rows=30).count() == 2400
    assert shuffled(spark) - before < 10 * x.nbytes


def test_rows_far_from_a_minority_of_another_size(spark):
    """The k farthest are those of the whole minority, whatever is kept."""
    rng = np.random.default_rng(5)
    x, label = rng.normal(size=(60, 3)), np.arange(60) % 3
    few = x[label == 0]
    score = {i: np.sort(np.sqrt(((x[i] - few) ** 2).sum(1)))[-3:].mean() for i in range(60) if label[i]}
    kept = {i for c in (1, 2) for i in sorted((i for i in score if label[i] == c), key=score.get)[:7]}
    got = resample.near_miss(frame(spark, range(60), label, x), 0, version=2, keep=7)
    assert {r.id for r in got.collect()} == kept | set(range(0, 60, 3))


def test_searches_of_synthetic_rows_have_short_plans(spark):
    x, label = np.random.default_rng(6).normal(size=(90, 3)), np.arange(90) % 3
    rows = frame(spark, range(90), label, x)
    for df in (resample.smote_tomek(rows, 1, 10), resample.smote_enn(rows, 1, 10), resample.one_sided(rows, 0, [1, 2])):
        assert len(df._jdf.queryExecution().logical().toString()) < 20_000

"""Centroid clustering against plain Python integers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import centroids

from .. import duck

TYPE = "vec_id long, embedding array<float>, label int, cluster int, q string, p double"


def brute(rows, k=8, rounds=10, dim=64):
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each kept row."""
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    c = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, x, strict=True)), j) for j, x in enumerate(c))

    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        c = [[sum(col) // len(own[j]) for col in zip(*own[j], strict=True)] if j in own else x for j, x in enumerate(c)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = Counter()
    for _, j, d in found:
        sums[j] += d
    top = (1 << 63) - 1
    return sorted(((i, j, min(d, top), min(sums[j], top), min(sum(sums.values()), top), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in found), key=str)


def got(spark, rows):
    return sorted((tuple(r) for r in centroids.label(spark.createDataFrame([(i, e, 1, 2, "q", 0.5) for i, e in rows], TYPE)).collect()), key=str)


def near(rng, size=1.0):
    return [float(np.float32(rng.gauss(0, size))) for _ in range(64)]


def test_equals_sql(spark):
    from gridloom.llm.queries import oracle_sql, queries

    name = "op13_centroid_clustering"
    duck.compare(duck.connect(), queries()[name](spark, duck.SF), oracle_sql()[name])


def test_odd_vectors(spark):
    rng = random.Random(1)
    rows = [(i, near(rng)) for i in range(60)]
    rows += [rows[3], rows[3], (3, near(rng)), (None, near(rng)), (None, rows[5][1])]
    rows += [(90, None), (91, []), (92, [1.0] * 63), (93, [1.0] * 65), (94, [1.0] * 63 + [None]), (95, [float("nan")] + [0.0] * 63), (96, [0.0] * 63 + [float("-inf")]), (97, [-0.0] * 64)]
    assert got(spark, rows) == brute(rows)


def test_fewer_vectors_than_clusters_and_none(spark):
    rng = random.Random(2)
    rows = [(i, near(rng)) for i in range(3)] + [(1, None)]
    assert got(spark, rows) == brute(rows) and len(brute(rows)) == 3
    assert got(spark, rows[3:]) == [] == got(spark, [])
    same = [(i, [0.25] * 64) for i in range(20)]  # all ties, seven empty clusters
    assert got(spark, same) == brute(same) and {r[1] for r in got(spark, same)} == {0}


@pytest.mark.parametrize("size", [2000.0, 3e4, 1e7, 1e38])
def test_beyond_exact_floats(spark, size):
    """Vectors on both sides of the bound, and beyond 64 bits."""
    rng = random.Random(size)
    rows = [(i, near(rng, size if i % 3 else 1.0)) for i in range(40)]
    assert got(spark, rows) == brute(rows)


def test_distances_at_the_bound():
    rng = random.Random(5)
    for top in (2**22, 2**23, int((2**53 / 64) ** 0.5) // 2, 2**40):
        q = np.array([[float(rng.choice([top, top - 1, -top, 0, 1])) for _ in range(64)] for _ in range(6)])
        c = [[rng.choice([top, -top, 3]) for _ in range(64)], [0] * 64, [top * 8] * 64]
        want = [[sum((int(a) - b) ** 2 for a, b in zip(v, x, strict=True)) for x in c] for v in q]
        assert [[int(x) for x in row] for row in centroids.distances(q, c)] == want


def test_any_partitioning_and_batches(spark):
    df = spark.read.parquet(f"{duck.SF}/embeddings.parquet")
    rows = sorted(centroids.label(df).collect())
    assert sorted(centroids.label(df.repartition(7)).collect()) == rows
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(centroids.label(df).collect()) == rows
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)

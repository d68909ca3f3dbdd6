"""Centroid clustering in exact integers: k-means rounds whose result depends on no partitioning, order or rounding.

Vectors become whole numbers once, in a table of their own. A round is one pass: tasks find the nearest centroid of
each vector by |x|^2 - 2 x.c + |c|^2 on float64 blocks (BLAS), which is exact while every number on the way stays below
2^53; vectors and centroids beyond that bound are compared in Python's integers. A task yields one row a cluster (count,
sums, summed distances), and an RDD `treeAggregate` adds these. Only k centroids and k rows a task ever leave the tasks.

Vectors that are null, of another length, or hold a null, NaN or infinity (also after scaling) are left out. Repeated rows are vectors of
their own; null ids start no cluster before others are used up; of one id's rows the smaller vector is first. An empty
table gives no rows. Other columns are never read. A distance or inertia beyond 64 bits is given as 2^63 - 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

DIM = 64
CLUSTERS = 8
ROUNDS = 10
SEED = 3
SCALE = 1024
#: Rows of an Arrow batch while blocks are multiplied: 1 MB of float64 at 64 components.
BLOCK_ROWS = 2048
EXACT = 1 << 53
LONG_MAX = (1 << 63) - 1

Centroids = list[list[int]]


class Clustering(NamedTuple):
    vectors: DataFrame  #: vec_id and q, the vector's whole numbers (as doubles, which hold them exactly)
    centroids: Centroids
    inertia: list[int]  #: summed squared distances by cluster


def whole_numbers(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """vec_id and q = floor(scale * x) of the vectors with dim components whose products are all finite; scale is a power of two, so products are exact."""
    if scale < 1 or scale & (scale - 1):
        raise ValueError("the scale must be a power of two")
    p = F.transform(F.col("embedding").cast("array<double>"), lambda x: x * F.lit(float(scale)))
    finite = F.forall("p", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(F.size("embedding") == dim).select("vec_id", p.alias("p")).filter(finite).mapInArrow(_floored, "vec_id long, q array<double>")


def _floored(batches) -> Iterator:
    import pyarrow as pa

    for b in batches:
        q = np.floor(_matrix(b.column("p"))) + 0.0  # no negative zeros
        yield pa.RecordBatch.from_arrays([b.column("vec_id").cast(pa.int64()), pa.FixedSizeListArray.from_arrays(pa.array(q.ravel()), q.shape[1]).cast(pa.list_(pa.float64()))], names=["vec_id", "q"])


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> Centroids:
    """The k vectors whose `seed:vec_id` has the smallest SHA-256, fewer if there are fewer."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(key.alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(k).collect()
    return [[int(x) for x in r.q] for r in rows]


def distances(q: np.ndarray, centroids: Centroids) -> np.ndarray:
    """Exact squared distances, vectors by centroids: float64 where no number on the way reaches 2^53, else Python integers."""
    dim = q.shape[1]
    size = np.abs(q).max(axis=1, initial=0)
    reach = [max(map(abs, c), default=0) for c in centroids]
    # any partial sum of |x|^2 - 2 x.c + |c|^2 is at most dim * (max|x| + max|c|)^2
    near = lambda a, b: dim * (a + b) ** 2 < EXACT
    if not len(q) or near(int(size.max()), max(reach)):
        return _expanded(q, centroids)
    out = np.empty((len(q), len(centroids)), object)
    for j, c in enumerate(centroids):
        # the sum of the two largest sizes is below root(2^53 / dim), so a float bound on the size alone decides
        bound = float(max(0, int((EXACT / dim) ** 0.5) - 1 - reach[j])) if near(0, reach[j]) else 0.0
        fast = size < bound
        if fast.any():
            out[fast, j] = _expanded(q[fast], [c])[:, 0].astype(np.int64).astype(object)
        for i in np.flatnonzero(~fast):
            out[i, j] = sum((int(a) - b) ** 2 for a, b in zip(q[i], c, strict=True))
    return out


def _expanded(q: np.ndarray, centroids: Centroids) -> np.ndarray:
    c = np.array(centroids, np.float64)
    return np.einsum("ij,ij->i", q, q)[:, None] - 2.0 * (q @ c.T) + np.einsum("ij,ij->i", c, c)[None, :]


def assign(q: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the smaller number at ties) and squared distance of each vector."""
    d = distances(q, centroids)
    if d.dtype == object:
        nearest = np.array([min(range(len(row)), key=row.__getitem__) for row in d.tolist()], np.int64)
    else:
        nearest = d.argmin(axis=1)
    return nearest, d[np.arange(len(q)), nearest]


def _sum(q: np.ndarray) -> list[int]:
    """Exact sums by component."""
    if len(q) * int(np.abs(q).max(initial=0)) < EXACT:
        return [int(x) for x in q.sum(axis=0)]
    return [sum(map(int, column)) for column in q.T]


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), DIM if not len(column) else -1)


def _round(vectors: DataFrame, centroids: Centroids) -> dict[int, tuple[int, list[int], int]]:
    """cluster -> count, sums by component, summed distances, of all vectors."""

    def partial(batches):
        import pyarrow as pa

        total: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b.column("q"))
            nearest, d = assign(q, centroids)
            for j in np.unique(nearest):
                own = nearest == j
                _add(total, int(j), (int(own.sum()), _sum(q[own]), sum(map(int, d[own]))))
        ks = sorted(total)
        yield pa.RecordBatch.from_pydict({"k": pa.array(ks, pa.int32()), "n": pa.array([total[k][0] for k in ks], pa.int64()), "s": pa.array([list(map(str, total[k][1])) for k in ks], pa.list_(pa.string())), "d": pa.array([str(total[k][2]) for k in ks], pa.string())})

    rows = vectors.select("q").mapInArrow(partial, "k int, n long, s array<string>, d string").rdd
    return rows.treeAggregate({}, lambda total, r: _add(total, r.k, (r.n, list(map(int, r.s)), int(r.d))), _joined)


def _add(total: dict, k: int, part: tuple[int, list[int], int]) -> dict:
    if k in total:
        n, s, d = total[k]
        part = (n + part[0], [a + b for a, b in zip(s, part[1], strict=True)], d + part[2])
    total[k] = part
    return total


def _joined(a: dict, b: dict) -> dict:
    for k, part in b.items():
        _add(a, k, part)
    return a


def fit(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: int = SEED) -> Clustering:
    """The vectors as whole numbers, and the centroids and inertias after so many rounds of assigning and averaging (floor of the exact mean; a cluster without vectors keeps its centroid)."""
    rows = cut(whole_numbers(vectors, dim, scale), "vectors", batch_rows=BLOCK_ROWS)
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return Clustering(rows, [], [])
    for _ in range(rounds):
        total = _round(rows, centroids)
        centroids = [[s // total[j][0] for s in total[j][1]] if j in total else c for j, c in enumerate(centroids)]
    total = _round(rows, centroids)
    return Clustering(rows, centroids, [total[j][2] if j in total else 0 for j in range(len(centroids))])


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def label(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that `whole_numbers` keeps."""
    rows, centroids, inertia = fit(vectors, **options)
    sums = [min(x, LONG_MAX) for x in inertia]
    total, names = min(sum(inertia), LONG_MAX), [digest(c) for c in centroids]

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            nearest, d = assign(_matrix(b.column("q")), centroids)
            short = pa.array([min(int(x), LONG_MAX) for x in d], pa.int64()) if d.dtype == object else pa.array(d.astype(np.int64))
            pick = pa.array(nearest.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pick, short, pa.array(sums, pa.int64()).take(pick), pa.array(np.full(len(pick), total, np.int64)), pa.array(names, pa.string()).take(pick)],
                names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
            )

    return rows.mapInArrow(run, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")

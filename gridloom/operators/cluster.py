"""Fuzzy c-means steps, distances and validity indices over vectors (id, features) and few centres (c, centre)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def canberra(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(F.try_divide(F.abs(x - y), F.abs(x) + F.abs(y)), F.lit(0.0))), F.lit(0.0), lambda s, v: s + v)


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def correlation_distance(a: Column, b: Column) -> Column:
    """1 - the correlation of two arrays."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    centred = lambda x: F.transform(x, lambda v: v - mean(x))
    return cosine_distance(centred(a), centred(b))


def image_distance(a: Column, b: Column, rows: int, cols: int, width: float = 1.0) -> Column:
    """Squared distance of two images (row by row) in which near pixels count for one another: the sum of v_i * g_ij * v_j, g by the pixels' distance."""
    import math

    places = [(i, j) for i in range(rows) for j in range(cols)]
    g = F.array(*[F.array(*[F.lit(math.exp(-((p - r) ** 2 + (q - c) ** 2) / (2 * width))) for r, c in places]) for p, q in places])
    v = F.zip_with(a, b, lambda x, y: x - y)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    return dot(F.transform(g, lambda row: dot(row, v)), v)


def memberships(rows: DataFrame, centres: DataFrame, m: float = 2.0) -> DataFrame:
    """id, features, c, d2, u: fuzzy memberships (they sum to one for each row). Centres are few: an array in each row, no cross join of rows."""
    listed = centres.agg(F.sort_array(F.collect_list(F.struct("c", "centre"))).alias("cs"))
    at = rows.crossJoin(F.broadcast(listed))  # one row
    d2 = F.transform("cs", lambda c: F.struct(c["c"].alias("c"), squared_distance(F.col("features"), c["centre"]).alias("d2")))
    at = at.withColumn("ds", d2)
    power = 1.0 / (m - 1)
    inverse = lambda x: F.pow(F.lit(1.0) / F.greatest(x, F.lit(1e-12)), F.lit(power))
    total = F.aggregate("ds", F.lit(0.0), lambda s, d: s + inverse(d["d2"]))
    out = at.withColumn("total", total).withColumn("d", F.explode("ds"))
    return out.select("id", "features", F.col("d.c").alias("c"), F.col("d.d2").alias("d2"), (inverse(F.col("d.d2")) / F.col("total")).alias("u"))


def next_centres(member: DataFrame, m: float = 2.0) -> DataFrame:
    """c, dim, value: weighted means, summed on the map side."""
    w = F.pow("u", F.lit(m))
    each = member.select("c", w.alias("w"), F.posexplode("features").alias("dim", "x"))
    return each.groupBy("c", "dim").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("value"))


def as_centres(values: DataFrame) -> DataFrame:
    return values.groupBy("c").agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("centre"))


def fuzzy_c_means(rows: DataFrame, centres: DataFrame, rounds: int = 10, m: float = 2.0) -> DataFrame:
    """Centres after `rounds` steps; between steps only the few centres pass through the driver."""
    spark, schema = rows.sparkSession, "c int, centre array<double>"
    for _ in range(rounds):
        now = as_centres(next_centres(memberships(rows, centres, m), m)).collect()
        centres = spark.createDataFrame([(r.c, r.centre) for r in now], schema)
    return centres


def partition_coefficient(member: DataFrame) -> DataFrame:
    return member.agg((F.sum(F.col("u") * F.col("u")) / F.count_distinct("id")).alias("partition_coefficient"))


def centre_gaps(centres: DataFrame) -> DataFrame:
    """a, b, d2 of each pair of the few centres."""
    a, b = centres.select(F.col("c").alias("a"), F.col("centre").alias("ca")), centres.select(F.col("c").alias("b"), F.col("centre").alias("cb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", squared_distance(F.col("ca"), F.col("cb")).alias("d2"))


def xie_beni(member: DataFrame, centres: DataFrame) -> DataFrame:
    spread = member.agg(F.sum(F.col("u") * F.col("u") * F.col("d2")).alias("s"), F.count_distinct("id").alias("n"))
    gap = centre_gaps(centres).agg(F.min("d2").alias("gap"))
    return spread.crossJoin(gap).select((F.col("s") / (F.col("n") * F.col("gap"))).alias("xie_beni"))  # one row each


def davies_bouldin(member: DataFrame, centres: DataFrame) -> DataFrame:
    """Over hard assignments (nearest centre, ties: the smallest): the mean of each cluster's worst (s_a + s_b) / d_ab."""
    hard = member.groupBy("id").agg(F.min(F.struct("d2", "c")).alias("x")).select(F.col("x.c").alias("c"), F.sqrt("x.d2").alias("d"))
    s = hard.groupBy("c").agg(F.avg("d").alias("s"))
    gaps = centre_gaps(centres)
    both = gaps.union(gaps.select("b", "a", "d2"))
    r = both.join(s.withColumnsRenamed({"c": "a", "s": "sa"}), "a").join(s.withColumnsRenamed({"c": "b", "s": "sb"}), "b")
    return r.groupBy("a").agg(F.max((F.col("sa") + F.col("sb")) / F.sqrt("d2")).alias("r")).agg(F.avg("r").alias("davies_bouldin"))


def dunn(member: DataFrame, centres: DataFrame) -> DataFrame:
    """Smallest gap of centres over the widest cluster (twice the largest distance to its centre): the centroid form, linear in the rows."""
    hard = member.groupBy("id").agg(F.min(F.struct("d2", "c")).alias("x")).select(F.sqrt("x.d2").alias("d"))
    wide = hard.agg((2 * F.max("d")).alias("wide"))
    gap = centre_gaps(centres).agg(F.sqrt(F.min("d2")).alias("gap"))
    return gap.crossJoin(wide).select(F.try_divide("gap", F.col("wide")).alias("dunn"))  # one row each


def pbmf(member: DataFrame, centres: DataFrame, m: float = 2.0) -> DataFrame:
    """(e1 / (k * jm) * widest gap) squared; e1: distances to the mean vector, jm: weighted distances to the centres."""
    dims = member.filter(F.col("c") == 0).select("id", F.posexplode("features").alias("dim", "x"))
    mean = dims.groupBy("dim").agg(F.avg("x").alias("value"))
    mean = mean.agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "value"))), lambda s: s["value"]).alias("mean"))
    e1 = member.filter(F.col("c") == 0).crossJoin(F.broadcast(mean)).agg(F.sum(F.sqrt(squared_distance(F.col("features"), F.col("mean")))).alias("e1"))  # one row
    jm = member.agg(F.sum(F.pow("u", F.lit(m)) * F.sqrt("d2")).alias("jm"), F.count_distinct("c").alias("k"))
    gap = centre_gaps(centres).agg(F.sqrt(F.max("d2")).alias("gap"))
    return e1.crossJoin(jm).crossJoin(gap).select(F.pow(F.col("e1") / (F.col("k") * F.col("jm")) * F.col("gap"), F.lit(2)).alias("pbmf"))  # one row each

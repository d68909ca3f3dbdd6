"""Weather-grid operators: stencils, percentiles, block means, areas. Cells are rows (key, i, j, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rings of the 5 x 5 stencil around the site's cell.
RINGS = {
    "centre": [(2, 2)],
    "l1": [(1, 1), (1, 2), (1, 3), (2, 1), (3, 1)],
    "l2": [(2, 3), (3, 2), (3, 3)],
    "l3d": [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0), (2, 0), (3, 0), (4, 0)],
    "l3u": [(4, 1), (4, 2), (4, 3), (4, 4), (1, 4), (2, 4), (3, 4)],
}


def ring(i: Column, j: Column) -> Column:
    out = None
    for name, cells in RINGS.items():
        inside = F.struct(i.cast("int"), j.cast("int")).isin(*[F.struct(F.lit(a), F.lit(b)) for a, b in cells])
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def ring_features(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """For each key and ring: the 5th, 50th and 95th percentile (interpolated) and the mean."""
    ringed = cells.withColumn("ring", ring(F.col("i"), F.col("j"))).filter("ring IS NOT NULL")
    p = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return ringed.groupBy(*keys, "ring").agg(p.alias("p"), F.avg(value).alias("mean")).select(*keys, "ring", F.col("p")[0].alias("p5"), F.col("p")[1].alias("p50"), F.col("p")[2].alias("p95"), "mean")


def block_means(cells: DataFrame, keys: list[str], value: str, size: int = 2) -> DataFrame:
    """Means of size x size blocks; blocks at the far edges may be smaller."""
    return cells.groupBy(*keys, F.floor(F.col("i") / size).cast("int").alias("bi"), F.floor(F.col("j") / size).cast("int").alias("bj")).agg(F.avg(value).alias("mean"))


def in_area(cells: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    return cells.filter(F.col("lat").between(*lat) & F.col("lon").between(*lon))


def area_percentiles(cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, and the 10th and 90th percentile, over an area."""
    p = F.percentile(value, F.array(F.lit(0.1), F.lit(0.9)))
    return cells.groupBy(*keys).agg(F.avg(value).alias("mean"), p.alias("p")).select(*keys, "mean", F.col("p")[0].alias("p10"), F.col("p")[1].alias("p90"))


def best_cell(cells: DataFrame, target: DataFrame, on: str, value: str, y: str) -> DataFrame:
    """The cell whose values correlate best with the target, and the correlation; ties: smallest i, then j."""
    corr = cells.join(target, on).groupBy("i", "j").agg(F.corr(value, y).alias("corr")).filter("corr IS NOT NULL")
    return corr.orderBy(F.desc(F.round("corr", 9)), "i", "j").limit(1)

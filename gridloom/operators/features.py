"""Feature filters, scaling and ordering; wide frames become long once, so that one pass serves all columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.interim import written
from .ranks import before, range_of


def scaled(df: DataFrame, columns: list[str], keys: tuple[str, ...] = (), kind: str = "minmax") -> DataFrame:
    """minmax: (x - min) / (max - min); maxabs: x / max|x|. Statistics are one small aggregate, joined back."""
    stats = df.groupBy(*keys).agg(*[f(c).alias(f"__{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])
    joined = df.join(stats, list(keys)) if keys else df.crossJoin(F.broadcast(stats))  # one row
    for c in columns:
        lo, hi = F.col(f"__lo_{c}"), F.col(f"__hi_{c}")
        joined = joined.withColumn(c, F.try_divide(F.col(c) - lo, hi - lo) if kind == "minmax" else F.try_divide(F.col(c), F.greatest(F.abs(lo), F.abs(hi))))
    return joined.select(*df.columns)


def correlations(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """feature, corr with the target and rank: the strongest (by size, whatever the sign) is first; constant ones, which have none, are last; ties by name."""
    row = df.agg(*[F.corr(c, target).alias(c) for c in columns])
    long = row.unpivot([], columns, "feature", "corr")
    return long.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("corr").desc_nulls_last(), "feature")))  # a row for each column


def column_order(df: DataFrame, columns: list[str], target: str) -> list[str]:
    """Column names, strongest correlation first; a few rows reach the driver."""
    return [r.feature for r in sorted(correlations(df, columns, target).collect(), key=lambda r: r.rank)]


def reordered(df: DataFrame, order: list[str]) -> DataFrame:
    """The columns of a saved order, then all others: what was fitted in one order is scored in the same."""
    return df.select(*order, *[c for c in df.columns if c not in order])


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, corr of each pair of columns, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr")) for a, b in pairs]).alias("m"))
    return row.select(F.explode("m").alias("m")).select("m.*")


#: A column's ranks are broadcast up to so many distinct values (16 bytes each); beyond that they meet the rows by a shuffle.
BROADCAST_VALUES = 1_000_000
RANK_RANGES = 200


def value_ranks(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """feature, v, rank: the average rank of every distinct value of all columns, as a table of its own; and how many there are by column. One pass over df counts all columns' values, whose numbering is by ranges, so that no task holds a column's."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "v")
    counts = written(long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n")), "counts")
    found = {r.feature: r for r in counts.groupBy("feature").agg(F.count(F.lit(1)).alias("kinds"), F.percentile_approx("v", [k / RANK_RANGES for k in range(1, RANK_RANGES)], 1000).alias("p")).collect()}
    part = F.lit(0)
    for c, r in found.items():
        part = F.when(F.col("feature") == c, range_of(F.col("v"), sorted(set(r.p or [])))).otherwise(part)
    placed = counts.withColumn("part", part)
    base = before(placed.groupBy("feature", "part").agg(F.sum("n").alias("n")), ["feature"], "part", "n")  # RANK_RANGES rows a column
    w = Window.partitionBy("feature", "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranks = placed.withColumn("own", F.coalesce(F.sum("n").over(w), F.lit(0))).join(F.broadcast(base), ["feature", "part"])
    return written(ranks.select("feature", "v", (F.col("base") + F.col("own") + (F.col("n") + 1) / 2).alias("rank")), "ranks"), {c: r.kinds for c, r in found.items()}


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column's average ranks: `value_ranks`, joined back by value."""
    ranks, kinds = value_ranks(df, columns)
    out = df
    for c in columns:
        own = ranks.filter(F.col("feature") == c).select(F.col("v").alias("__v"), F.col("rank").alias(f"rank_{c}"))
        own = F.broadcast(own) if kinds.get(c, 0) <= BROADCAST_VALUES else own
        out = out.join(own, F.col(c).cast("double").eqNullSafe(F.col("__v"))).drop("__v")
    return out


def spearman_drops(df: DataFrame, columns: list[str], threshold: float) -> DataFrame:
    """feature, dropped: the later column of each pair whose rank correlation is above the threshold goes."""
    m = correlation_matrix(average_ranks(df, columns), [f"rank_{c}" for c in columns])
    worst = m.groupBy(F.col("b").alias("f")).agg(F.max(F.abs("corr")).alias("worst")).select(F.expr("substring(f, 6)").alias("feature"), "worst")
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return every.join(worst, "feature", "left").select("feature", F.coalesce(F.col("worst") > threshold, F.lit(False)).alias("dropped"))


def constant_features(df: DataFrame, columns: list[str], share: float = 0.9) -> DataFrame:
    """feature, top_share and constant: the most frequent value's share, and whether it is above `share`."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "feature", "v")
    counts = long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("feature").agg((F.max("n") / F.sum("n")).alias("top_share")).withColumn("constant", F.col("top_share") > share)


def inverse_scaled(df: DataFrame, stats: DataFrame, columns: list[str], kind: str = "minmax") -> DataFrame:
    """Scaled columns back in their own units; stats: feature, lo, hi (`scale_stats`), a row for each column."""
    of = {r.feature: (r.lo, r.hi) for r in stats.collect()}
    back = {c: F.col(c) * (of[c][1] - of[c][0]) + of[c][0] if kind == "minmax" else F.col(c) * max(abs(of[c][0]), abs(of[c][1])) for c in columns}
    return df.withColumns(back)


def scale_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, lo, hi: what a scaler keeps, as a table that can be saved."""
    row = df.agg(F.array(*[F.struct(F.lit(c).alias("feature"), F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")) for c in columns]).alias("s"))
    return row.select(F.inline("s"))


def apply_scale(df: DataFrame, stats: DataFrame, columns: list[str], kind: str = "minmax") -> DataFrame:
    """Columns scaled by saved statistics (not by their own)."""
    of = {r.feature: (r.lo, r.hi) for r in stats.collect()}
    one = lambda c: F.try_divide(F.col(c) - of[c][0], F.lit(of[c][1] - of[c][0])) if kind == "minmax" else F.try_divide(F.col(c), F.lit(max(abs(of[c][0]), abs(of[c][1]))))
    return df.withColumns({c: one(c) for c in columns})


def complete_columns(df: DataFrame) -> list[str]:
    """Names of the columns without a null, counted in one pass."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).collect()[0]
    return [c for c in df.columns if not row[c]]

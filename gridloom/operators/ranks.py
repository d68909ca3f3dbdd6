"""Ranks without a task that holds everything: values fall into ranges, ranges are counted, and rows are numbered within theirs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that values are cut into; a task numbers the rows of one range.
RANGES = 200


def bounds_of(df: DataFrame, value: str, ranges: int = RANGES) -> list:
    """Approximate quantiles of a numeric column, ascending and distinct: a bounded list, from one aggregate."""
    row = df.agg(F.percentile_approx(F.col(value).cast("double"), [n / ranges for n in range(1, ranges)], 1000).alias("p")).collect()[0]
    return sorted(set(row.p or []))


def range_of(value: Column, bounds: list) -> Column:
    """How many bounds are below the value, by a search in a constant array."""
    if not bounds:
        return F.lit(0)
    low = F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b < value)
    return F.when(value.isNull(), -1).otherwise(F.size(low))


def before(counts: DataFrame, keys: list[str], part: str, n: str) -> DataFrame:
    """keys, part, base: the sum of n over the parts before; a row for each key and part, so few rows."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    w = w.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*keys, part, F.coalesce(F.sum(n).over(w), F.lit(0)).alias("base"))


def numbered(df: DataFrame, keys: list[str], part: Column, order: list[Column | str], name: str = "rank") -> DataFrame:
    """df with the row number (from 1) within `keys` by (part, *order); `part` is ascending in the order wanted."""
    cut = df.withColumn("__part", part)
    base = before(cut.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("n")), keys, "__part", "n")
    w = Window.partitionBy(*keys, "__part").orderBy(*order)
    same = [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in (*keys, "__part")]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return cut.withColumn("__r", F.row_number().over(w)).alias("x").join(F.broadcast(base).alias("y"), on).select(*[F.col(f"x.{c}") for c in df.columns], (F.col("x.__r") + F.col("y.base")).alias(name))


def by_value(df: DataFrame, keys: list[str], value: str, order: list[Column | str], name: str = "rank") -> DataFrame:
    """`numbered` by a numeric column, ascending (nulls first), ties by `order`."""
    return numbered(df, keys, range_of(F.col(value).cast("double"), bounds_of(df, value)), [F.col(value), *order], name)


def by_share(df: DataFrame, keys: list[str], share: Column, order: list[Column | str], name: str = "rank", ranges: int = 1024) -> DataFrame:
    """`numbered` by a number from 0 to 1 that is spread evenly, such as a hash."""
    return numbered(df.withColumn("__u", share), keys, F.floor(F.col("__u") * ranges), ["__u", *order], name).select(*df.columns, name)

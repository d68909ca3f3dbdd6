"""Windows by position whose tasks hold a stretch of a series, not a whole one.

Rows are numbered within their keys by ranges of time and then dealt to blocks of about BLOCK rows; a block also gets
the rows that are within reach of its own (its halo), so any frame of that reach is whole within a block. A key's
series, however long, is many tasks, and a row is in two blocks at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import before, bounds_of, range_of

BLOCK = 4096
R, N, SLOT = "__gl_r", "__gl_n", "__gl_slot"


def _same(a: str, b: str, columns: list[str]) -> Column:
    """Whether two sides' columns are equal, nulls included."""
    out = F.lit(True)
    for c in columns:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def numbered(df: DataFrame, time: str, keys: tuple[str, ...] = (), total: bool = False) -> DataFrame:
    """df with the row number (from 1) within its keys in order of `time`, a number; with `total`, also the number of rows. Rows of equal times are numbered in any order."""
    placed = df.withColumn("__part", range_of(F.col(time).cast("double"), bounds_of(df, time)))
    counts = placed.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias(N))  # a row for each key and range
    base = before(counts, list(keys), "__part", N)
    if total:
        sums = counts.groupBy(*keys).agg(F.sum(N).alias(N)) if keys else counts.agg(F.sum(N).alias(N))
        base = base.alias("b").join(sums.alias("s"), _same("b", "s", list(keys))).select("b.*", f"s.{N}")
    w = Window.partitionBy(*keys, "__part").orderBy(time)
    own = placed.withColumn("__own", F.row_number().over(w)).alias("x").join(base.alias("y"), _same("x", "y", [*keys, "__part"]))
    return own.select(*[F.col(f"x.{c}") for c in df.columns], (F.col("x.__own") + F.col("y.base")).alias(R), *([F.col(f"y.{N}")] if total else []))


def dealt(rows: DataFrame, reach: int, block: int = BLOCK) -> tuple[DataFrame, int]:
    """Rows of `numbered` with their block; those within `reach` of the next or the last one's stand there too. Also the blocks' size."""
    size = max(block, 2 * reach, 1)
    at = lambda r: F.floor((r - 1) / size)
    first, last = at(F.greatest(F.col(R) - reach, F.lit(1))), at(F.col(R) + reach)
    return rows.withColumn(SLOT, F.explode(F.sequence(first, last))), size


def home(size: int) -> Column:
    """Whether a row is in its own block, not in another's halo."""
    return F.col(SLOT) == F.floor((F.col(R) - 1) / size)


def over(keys: tuple[str, ...] = ()):
    """The window of a block in order of position."""
    return Window.partitionBy(*keys, SLOT).orderBy(R)


def next_known(df: DataFrame, time: str, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """df with `value` as the row's own or else the next known one of its keys: within a range of time by its window, beyond it by the ranges' first known values, of which there are a few a key."""
    part = "__part"
    placed = df.withColumn(part, range_of(F.col(time).cast("double"), bounds_of(df, time)))
    known = F.col(value).isNotNull()
    firsts = placed.groupBy(*keys, part).agg(F.min_by(value, F.when(known, F.col(time))).alias("__first"))
    later = Window.partitionBy(*keys).orderBy(part).rowsBetween(1, Window.unboundedFollowing) if keys else Window.partitionBy(F.lit(0)).orderBy(part).rowsBetween(1, Window.unboundedFollowing)
    firsts = firsts.select(*keys, part, F.first("__first", ignorenulls=True).over(later).alias("__later"))
    w = Window.partitionBy(*keys, part).orderBy(time).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    own = placed.withColumn("__near", F.first(value, ignorenulls=True).over(w)).alias("x").join(firsts.alias("y"), _same("x", "y", [*keys, part]))
    return own.select(*[F.coalesce("x.__near", "y.__later").alias(value) if c == value else F.col(f"x.{c}") for c in df.columns])

"""Frame operators: splits, checks, imputation, scattering, group totals and joins on rounded times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_total(wide: DataFrame, name: str, total: str = "total") -> DataFrame:
    """The column of the group's total under the group's own name."""
    return wide.withColumnRenamed(total, name)


def rated_total(rated: DataFrame, name: str, value: str = "rated") -> DataFrame:
    """The sites' rated power and, as one more site, their sum."""
    return rated.unionByName(rated.agg(F.sum(value).alias(value)).withColumn("project", F.lit(name)).select(*rated.columns))


#: Hours (or days, of gas) before the evaluation that its part still has, as warm-up of its lags.
WARM_UP = {"gas": 372, "lv": 9001, "short_term": 350, "hourly": 9001}


def evaluation_split(df: DataFrame, time: str, at: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """Rows to `at`, and rows after `at` less the kind's warm-up: the overlap feeds the lags of the evaluation."""
    return df.filter(F.col(time) <= at), df.filter(F.col(time) > at - WARM_UP[kind])


def unknown_names(projects: DataFrame, *tables: DataFrame) -> DataFrame:
    """Projects that one of the tables doesn't have; empty if all names agree."""
    out = None
    for t in tables:
        missing = projects.select("project").join(t.select("project"), "project", "left_anti")
        out = missing if out is None else out.union(missing)
    return out.distinct()


def joined_by_hour(left: DataFrame, cells: DataFrame, seconds: str, hour: str = "hour") -> DataFrame:
    """Rows with the weather of their nearest hour (half hours: the even one); rows without weather are passed over."""
    from ..functions.calendar import half_even_hour

    return left.withColumn(hour, half_even_hour(F.col(seconds))).join(cells, hour)


def common_index(x: DataFrame, y: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both at their common keys."""
    return x.join(y, keys)


def imputed(df: DataFrame, columns: list[str], share: float = 1 / 3) -> DataFrame:
    """Nulls become the column's mean; a column with more than a third of nulls is an error (raised when the rows are read). One aggregate, one row joined back."""
    n = F.count(F.lit(1))
    stats = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[(F.count_if(F.col(c).isNull()) > n * share).alias(f"__x_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(stats))  # one row
    for c in columns:
        value = F.coalesce(F.col(c), F.col(f"__m_{c}"))
        out = out.withColumn(c, F.when(F.col(f"__x_{c}"), F.raise_error(F.lit(f"too many gaps in {c}")).cast("double")).otherwise(value))
    return out.select(*df.columns)


def scattered(index: DataFrame, pred: DataFrame, keys: list[str], fill: float | None = None) -> DataFrame:
    """Forecasts on the whole index: null (or `fill`) where there is none."""
    out = index.select(*keys).join(pred, keys, "left")
    return out if fill is None else out.fillna(fill, subset=["y_hat"])


def in_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of projects that belong to a group (groups: project)."""
    return rows.join(groups.select("project").distinct(), "project", "left_semi")


def mean_correlation(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row: the mean over the columns of the correlation of each with its namesake, on common keys."""
    right = b.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    corr = a.join(right, keys).agg(F.array(*[F.corr(c, f"__{c}") for c in columns]).alias("c"))
    there = F.filter("c", lambda x: x.isNotNull() & ~F.isnan(x))
    return corr.select(F.try_divide(F.aggregate(there, F.lit(0.0), lambda s, x: s + x), F.size(there)).alias("corr"))


def objective(validation: Column, test: Column) -> Column:
    """0.4 of the validation error and 0.6 of the test error."""
    return 0.4 * validation + 0.6 * test


def shuffled(df: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """Rows in an order that depends on the keys and the seed alone."""
    return df.orderBy(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))).cast("binary")), *keys)


def sampled_with_replacement(df: DataFrame, key: str, most: int, seed: int = 0) -> DataFrame:
    """`most` draws with replacement from the rows of a table (all rows, once, of a smaller one): draws are numbers of rows, joined, so nothing is collected."""
    from .ranks import by_share
    from .resample import uniform

    n = df.count()
    if n <= most:
        return df
    placed = by_share(df, [], uniform(F.col(key), seed=seed), [key], "__r")
    draws = df.sparkSession.range(most).select((F.floor(uniform(F.col("id"), seed=seed + 1) * n) + 1).alias("__r"))
    return placed.join(draws, "__r").select(*df.columns)


#: Method groups and their members.
METHOD_GROUPS = {"RBF_ALL_CNN": ["RBF_OLS", "GA_RBF_OLS", "RBFNN", "RBF-CNN"], "RBF_ALL": ["RBF_OLS", "GA_RBF_OLS", "RBFNN"]}


def methods(enabled: list[str]) -> list[str]:
    """Enabled methods, groups spelled out, each once, in order."""
    return list(dict.fromkeys(m for e in enabled for m in METHOD_GROUPS.get(e, [e])))


def padded_top(scores: DataFrame, keys: list[str], score: str, tie: str, n: int = 4, within: float = 0.02) -> DataFrame:
    """slot (1 to n) and method: the best methods, kept if within `within` of the best; free slots are filled with the best again."""
    w = Window.partitionBy(*keys).orderBy(score, tie)
    top = scores.withColumn("rank", F.row_number().over(w)).withColumn("best", F.min(score).over(Window.partitionBy(*keys))).filter(F.col("rank") <= n)
    kept = top.filter(F.col(score) - F.col("best") <= within).groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", tie))), lambda s: s[tie]).alias("m"))
    slots = F.concat("m", F.array_repeat(F.col("m")[0], F.greatest(F.lit(n) - F.size("m"), F.lit(0))))
    return kept.select(*keys, F.posexplode(slots).alias("slot", tie)).withColumn("slot", F.col("slot") + 1)

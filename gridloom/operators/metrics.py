"""Error metrics, best trials, method ranking and imbalanced-class reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def errors(pred: DataFrame, keys: list[str], y_hat: str = "y_hat", y: str = "y", scale: str | None = None) -> DataFrame:
    """sse (not normalised), rms, mae and mse (sse / n) by key; errors are relative to `scale`, or to y (a zero gives null)."""
    d = F.col(y_hat) - F.col(y)
    e = F.try_divide(F.abs(d), F.col(scale or y))
    return pred.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(d * d).alias("sse"), F.sqrt(F.avg(e * e)).alias("rms"), F.avg(e).alias("mae"), (F.sum(d * d) / F.count(F.lit(1))).alias("mse"))


def scaled_errors(pred: DataFrame, keys: list[str], rated: bool, y_hat: str = "y_hat", y: str = "y") -> DataFrame:
    """`errors` of values that are already scaled by the rated power (rated: nothing is divided again) or not (they are relative to y)."""
    return errors(pred.withColumn("__one", F.lit(1.0)), keys, y_hat, y, "__one" if rated else None)


def best_trials(trials: DataFrame, keys: list[str], score: str, tie: list[str]) -> DataFrame:
    """The row of the smallest score of each key; ties by `tie`. One pass of min_by, no sort."""
    rest = [c for c in trials.columns if c not in keys]
    order = F.struct(score, *tie)
    return trials.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("b")).select(*keys, "b.*")


def top_methods(scores: DataFrame, keys: list[str], score: str, tie: str, n: int = 4, within: float = 0.02) -> DataFrame:
    """rank, and chosen: the n best whose score is within `within` of the best."""
    w = Window.partitionBy(*keys).orderBy(score, tie)
    ranked = scores.withColumn("rank", F.row_number().over(w)).withColumn("gap", F.col(score) - F.min(score).over(Window.partitionBy(*keys)))
    return ranked.filter(F.col("rank") <= n).withColumn("chosen", F.col("gap") <= within)


def confusion(df: DataFrame, y: str, y_hat: str) -> DataFrame:
    return df.groupBy(y, y_hat).agg(F.count(F.lit(1)).alias("n"))


def class_report(df: DataFrame, y: str, y_hat: str, alpha: float = 0.1) -> DataFrame:
    """By class: support, precision, recall (sensitivity), specificity, f1, g-mean and index balanced accuracy. From the confusion counts alone."""
    c = confusion(df, y, y_hat)
    total = Window.partitionBy()
    marked = c.select(F.col(y).alias("label"), F.col(y_hat).alias("guess"), "n")
    both = marked.select("label", F.col("n").alias("support"), F.lit(0).cast("long").alias("guessed"), F.when(F.col("label") == F.col("guess"), F.col("n")).otherwise(0).alias("hit"))
    both = both.union(marked.select("guess", F.lit(0).cast("long"), F.col("n"), F.lit(0).cast("long")))
    sums = both.groupBy("label").agg(F.sum("support").alias("support"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("tp"))
    sums = sums.withColumn("n", F.sum("support").over(total))  # a row for each class
    fp, fn = F.col("guessed") - F.col("tp"), F.col("support") - F.col("tp")
    tn = F.col("n") - F.col("tp") - fp - fn
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    sums = sums.withColumns({"precision": zero(F.try_divide("tp", F.col("guessed"))), "recall": zero(F.try_divide("tp", F.col("support"))), "specificity": zero(F.try_divide(tn, tn + fp))})
    p, r, s = F.col("precision"), F.col("recall"), F.col("specificity")
    return sums.select("label", "support", "precision", "recall", "specificity", zero(F.try_divide(2 * p * r, p + r)).alias("f1"), F.sqrt(r * s).alias("gmean"), ((1 + alpha * (r - s)) * r * s).alias("iba"))

"""Sources and sinks: Parquet tables, measurement and site CSVs, weather days, requests, history merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hours and days are whole numbers since 1970-01-01, so lags are plain arithmetic in any session time zone.
EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hour_number(ts: str = "ts") -> Column:
    return F.expr(f"timestampdiff(HOUR, {EPOCH}, date_trunc('HOUR', {ts})::timestamp_ntz)")


def day_number(date: str) -> Column:
    return F.datediff(F.col(date).cast("date"), F.lit("1970-01-01").cast("date"))


def hourly_series(events: DataFrame) -> DataFrame:
    """project, hour, y: the hourly sums of each site; hours without rows are absent, not zero."""
    return events.groupBy(F.col("event_type").alias("project"), hour_number("ts").alias("hour")).agg(F.sum("value").alias("y"))


def daily_series(orders: DataFrame) -> DataFrame:
    """day, y: the daily totals."""
    return orders.groupBy(day_number("o_orderdate").cast("long").alias("day")).agg(F.sum("o_totalprice").alias("y"))


def vectors(embeddings: DataFrame) -> DataFrame:
    """id, label, features: labelled vectors in double precision."""
    return embeddings.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("features"))


def measurements_csv(spark: SparkSession, path: str, sites: list[str]) -> DataFrame:
    """project, ts, y from a wide CSV: first column a day-first time, then one number for each site; NaN becomes null."""
    schema = ", ".join(["ts string", *[f"`{s}` double" for s in sites]])
    wide = spark.read.csv(path, header=True, schema=schema, nanValue="NaN")
    formats = ("dd/MM/yyyy HH:mm", "dd/MM/yyyy HH:mm:ss", "dd-MM-yyyy HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm")
    ts = F.coalesce(*[F.try_to_timestamp("ts", F.lit(f)) for f in formats])
    long = wide.select(ts.cast("timestamp_ntz").alias("ts"), *sites).unpivot(["ts"], sites, "project", "y")
    return long.select("project", "ts", F.when(~F.isnan("y"), F.col("y")).alias("y"))


def sites_csv(spark: SparkSession, path: str, values: list[str]) -> DataFrame:
    """A headerless site table: project and one number for each of `values` (lat and lon, a box, or rated power)."""
    return spark.read.csv(path, header=False, schema=", ".join(["project string", *[f"{v} double" for v in values]]))


def first_present(spark: SparkSession, paths: list[str]) -> str | None:
    """The first path that exists, by the file system that holds it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            return p
    return None


def requests(spark: SparkSession, path: str, schema: str = "project string, hour long, y double, correlation_id string"):
    """A stream of JSON requests, one file or more at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)


def write_partitioned(df: DataFrame, path: str, keys: list[str]) -> None:
    """Rows go to the partitions they belong to, a file for each task and key; large keys are split, not sent to one task."""
    df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def merge_history(old: DataFrame, new: DataFrame, digits: int = 4) -> DataFrame:
    """Both, numbers rounded, each distinct row once."""
    both = old.unionByName(new)
    return both.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in both.dtypes]).dropDuplicates()

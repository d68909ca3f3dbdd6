"""Stores on the file system that Spark writes to: day files, rule data, scalers, metrics, models, projects, search results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import versions
from .tables import first_present, write_partitioned


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def save_days(cells: DataFrame, path: str, model: str) -> None:
    """Weather rows by model and run day; a day that is written again is replaced, others stay."""
    rows = cells.withColumns({"model": F.lit(model), "run_day": F.floor(F.col("run_hour") / 24)})
    rows.hint("rebalance", "model", "run_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model", "run_day").parquet(path)


def load_days(spark: SparkSession, path: str, model: str, first: int, last: int) -> DataFrame:
    """Rows of a model's runs from day `first` to `last`: only their folders are read."""
    return spark.read.parquet(path).filter((F.col("model") == model) & F.col("run_day").between(first, last))


def days_to_fetch(needed: DataFrame, landed: DataFrame, least: int = 20) -> DataFrame:
    """run_day of the days that are needed and haven't landed, if they are more than `least`; else none."""
    missing = needed.select("run_day").distinct().join(landed.select("run_day").distinct(), "run_day", "left_anti")
    n = missing.agg(F.count(F.lit(1)).alias("__n"))
    return missing.crossJoin(F.broadcast(n)).filter(F.col("__n") > least).select("run_day")  # one row


#: The providers that weather comes from, and the reader of each.
PROVIDERS = ("skiron", "ecmwf", "gfs", "openweather")


def provider(name: str, readers: dict):
    """The reader of a provider; an error for unknown ones and for known ones that have no reader here."""
    if name not in PROVIDERS:
        raise ValueError(f"no such provider: {name}")
    if name not in readers:
        raise NotImplementedError(f"no reader for {name}")
    return readers[name]


def kept(spark: SparkSession, path: str, make, inputs: list[str] | None = None, params: dict | None = None) -> DataFrame:
    """The table at the path, made by make() and written first if it isn't there; with `inputs` (paths) or `params`, also if these aren't what it was made from."""
    if inputs is not None or params is not None:
        return versions.made_from(spark, path, make, inputs or [], params)
    if first_present(spark, [f"{path}/_SUCCESS"]) is None:
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def save_rule_data(parts: DataFrame, path: str) -> None:
    """Each rule's rows (features, target, activation and split in one row) in its own folder."""
    write_partitioned(parts, path, ["project", "rule"])


def rule_data(spark: SparkSession, path: str, project: str, rule: str) -> DataFrame:
    return spark.read.parquet(path).filter((F.col("project") == project) & (F.col("rule") == rule))


def save_scaler(stats: DataFrame, path: str) -> None:
    """Statistics of a scaler (feature, lo, hi)."""
    stats.coalesce(1).write.mode("overwrite").parquet(path)  # a row for each column


def save_metrics(metrics: DataFrame, path: str, name: str) -> None:
    """A result table as CSV with a header, and as Parquet beside it."""
    metrics.write.mode("overwrite").option("header", True).csv(f"{path}/{name}.csv")
    metrics.write.mode("overwrite").parquet(f"{path}/{name}")


def save_model(model, path: str, params: dict, spark: SparkSession) -> None:
    """A fitted Spark ML model, and its parameters as one row beside it."""
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(params, sort_keys=True),)], "params string").coalesce(1).write.mode("overwrite").json(f"{path}/params")


def load_model(path: str, spark: SparkSession):
    """(model, parameters)."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/model"), json.loads(spark.read.schema("params string").json(f"{path}/params").collect()[0].params)


def save_linear(models: dict, path: str, spark: SparkSession) -> None:
    """Linear models by key as one table: key, intercept, features, weights."""
    rows = [(k, float(m.intercept), m.features, [float(w) for w in m.weights]) for k, m in sorted(models.items())]
    spark.createDataFrame(rows, "key string, intercept double, features array<string>, weights array<double>").write.mode("overwrite").parquet(path)


def put_projects(projects: DataFrame, path: str) -> DataFrame:
    """The project table (one row a project, settings in `static_data`) after a project that is put again has replaced its row. A crash leaves the old rows or the new ones, never none."""
    spark = projects.sparkSession
    if versions.current(spark, path) is None:
        return versions.commit(projects, path)
    old = versions.read(spark, path)
    return versions.commit(old.join(projects.select("project"), "project", "left_anti").unionByName(projects), path)


def projects(spark: SparkSession, path: str) -> DataFrame:
    """The project table as last put."""
    return versions.read(spark, path)


def remove(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.delete(p, True)


def clear_tests(spark: SparkSession, root: str) -> list[str]:
    """Delete the folders under root whose names hold `test`; their names."""
    p, fs = _path(spark, root)
    found = [s.getPath() for s in fs.listStatus(p) if s.isDirectory() and "test" in s.getPath().getName()]
    for x in found:
        fs.delete(x, True)
    return sorted(x.getName() for x in found)


def backup(spark: SparkSession, root: str, target: str, without: tuple[str, ...] = ("data", "nwp")) -> list[str]:
    """Copy the entries of root, but for the data folders; their names."""
    p, fs = _path(spark, root)
    to, _ = _path(spark, target)
    util, conf = spark._jvm.org.apache.hadoop.fs.FileUtil, spark._jsc.hadoopConfiguration()
    found = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in without]
    fs.mkdirs(to)
    for x in found:
        util.copy(fs, x, fs, spark._jvm.org.apache.hadoop.fs.Path(to, x.getName()), False, True, conf)
    return sorted(x.getName() for x in found)


def dump_search(result: dict, path: str, spark: SparkSession) -> None:
    """A search's points, costs and state as one JSON row, so that it can go on."""
    spark.createDataFrame([(json.dumps(result, sort_keys=True),)], "result string").coalesce(1).write.mode("overwrite").text(path)


def load_search(path: str, spark: SparkSession) -> dict:
    return json.loads(spark.read.text(path).collect()[0].value)


def sites_with_rated(spark: SparkSession, folder: str, kind: str, weather_in_data: bool = False) -> str | None:
    """The site table's path: the one found automatically before the given one; needed unless the data hold their weather."""
    found = first_present(spark, [f"{folder}/coord_auto_{kind}.csv", f"{folder}/coord_{kind}.csv"])
    if found is None and not weather_in_data:
        raise FileNotFoundError(f"no coordinates for {kind} in {folder}")
    return found

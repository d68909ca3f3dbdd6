"""Tables between the steps of an iterative operator: written to the folder that driver and executors share, so lineage stays short and outlives executors."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

OWN_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, one of our own, but only with a local master, as executors elsewhere share no local folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.fullmatch(r"local(\[[^\]]*\])?", spark.conf.get("spark.master", "local")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path or OWN_DIR


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df, written as Parquet and read again. The file system deletes the table when the driver ends, `dropped` before that."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gridloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table of `written` that nothing will read again; any other frame is left alone."""
    path = getattr(df, "_gridloom_path", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)

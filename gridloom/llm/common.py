"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import re
import string
import uuid
from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that part words in most operators: 0x20 and 0x09-0x0D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
OWN_CHECKPOINT_DIR = "/tmp/checkpoints"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of an Arrow batch while a table is written: texts are long.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, one of our own, but only with a local master (as in tests): elsewhere executors share no local folder, so that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    master = spark.conf.get("spark.master", "local")
    if not re.fullmatch(r"local(\[[^\]]*\])?", master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return OWN_CHECKPOINT_DIR


def _fewer(spark: SparkSession) -> str:
    rows = int(spark.conf.get(ARROW_ROWS))
    return str(rows if 0 < rows <= BATCH_ROWS else BATCH_ROWS)


def settle(spark: SparkSession) -> None:
    """Ask the executors' JVMs for a collection, one small task a core: heap that a stage has grown and no longer needs goes back to the system before the next stage's Python workers need it."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).selectExpr("java_method('java.lang.System', 'gc') AS done").write.format("noop").mode("overwrite").save()


def cut(df: DataFrame, name: str = "t", batch_rows: int | None = None) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: short lineage that outlives executors. The file system deletes the table when the driver ends; `release` does so before. Arrow batches have batch_rows rows at most meanwhile (None: BATCH_ROWS, or fewer if the session says so)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gridloom-{name}-{uuid.uuid4().hex}"
    rows = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, _fewer(spark) if batch_rows is None else str(batch_rows))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(ARROW_ROWS, rows)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def sliced(batches, rows: int):
    """The same rows in batches of so many at most: for functions whose results ship whole texts, whatever the session's batches are."""
    for batch in batches:
        for a in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(a, rows)


def tidy(run: Callable, rows: int | None = None) -> Callable:
    """A function for `mapInArrow` after which the worker, which lives on, gives the memory that it has freed back to the system; `rows`: of its batches, at most."""

    def inner(batches):
        try:
            yield from run(batches if rows is None else sliced(batches, rows))
        finally:
            import pyarrow as pa

            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # the C library may have no such call
                ctypes.CDLL(None).malloc_trim(0)

    return inner


def release(*tables: DataFrame) -> None:
    """Delete tables that `cut` has written and that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(df._gridloom_path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def lower_az(c: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def words_of(c: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` as an array; null gives an empty array."""
    t = F.btrim(F.coalesce(c, F.lit("")), F.lit(BLANKS))
    return F.when(F.length(t) > 0, F.split(t, BLANK_RUN)).otherwise(F.array().cast("array<string>"))


def row_key(doc_id: Column, text: Column) -> Column:
    """With doc_id, tells rows apart where ids repeat or are null; equal rows share it and share their result."""
    return F.xxhash64(doc_id, text)

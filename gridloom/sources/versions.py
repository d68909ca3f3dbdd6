"""Tables that are replaced as a whole: versions in folders of their own behind one pointer.

A commit writes a new folder `v=<id>`, then a small pointer file beside the old one, and renames it over the old one,
which the file system does at once: before that, readers get the old rows, after it the new ones, whatever crashes in
between. Folders that no pointer names are deleted by the next commit. The pointer keeps a stamp of what the rows were
made from, so a table can be made anew when that has changed.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

POINTER = "_current"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str) -> dict | None:
    """The pointer's content: version and stamp; none if nothing was committed."""
    p, fs = _hadoop(spark, f"{path}/{POINTER}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def read(spark: SparkSession, path: str) -> DataFrame:
    """The committed rows."""
    at = current(spark, path)
    if at is None:
        raise FileNotFoundError(f"nothing was committed to {path}")
    return spark.read.parquet(f"{path}/v={at['version']}")


def commit(df: DataFrame, path: str, stamp: str = "") -> DataFrame:
    """Replace the table by df, which may be made from its own rows; the new rows."""
    spark = df.sparkSession
    version = uuid.uuid4().hex
    df.write.parquet(f"{path}/v={version}")
    point(spark, path, {"version": version, "stamp": stamp})
    sweep(spark, path, version)
    return spark.read.parquet(f"{path}/v={version}")


def point(spark: SparkSession, path: str, content: dict) -> None:
    """Set the pointer, in one step for all readers."""
    new, fs = _hadoop(spark, f"{path}/_next-{content['version']}")
    out = fs.create(new, True)
    try:
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
    finally:
        out.close()
    old, _ = _hadoop(spark, f"{path}/{POINTER}")
    kind = spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
    how = spark._jvm.java.lang.reflect.Array.newInstance(kind, 1)
    how[0] = spark._jvm.java.lang.Enum.valueOf(kind, "OVERWRITE")
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(new, old, how)


def sweep(spark: SparkSession, path: str, version: str) -> None:
    """Delete all versions but one, and pointers that were never set."""
    p, fs = _hadoop(spark, path)
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith(("v=", "_next-")) and name != f"v={version}":
            fs.delete(s.getPath(), True)


def stamp_of(spark: SparkSession, paths: list[str], params: dict | None = None) -> str:
    """A digest of the files under the paths (names, sizes, times of change) and of parameters."""
    found: list = []
    for path in sorted(paths):
        p, fs = _hadoop(spark, path)
        if not fs.exists(p):
            found.append([path, None])
            continue
        files = fs.listFiles(p, True)
        own = []
        while files.hasNext():
            f = files.next()
            own.append([f.getPath().toString(), f.getLen(), f.getModificationTime()])
        found.append([path, sorted(own)])
    return hashlib.sha256(json.dumps([found, params or {}], sort_keys=True).encode()).hexdigest()


def made_from(spark: SparkSession, path: str, make: Callable[[], DataFrame], inputs: list[str], params: dict | None = None) -> DataFrame:
    """The table at the path if it was made from the inputs as they are now, with these parameters; else made by make() and committed."""
    stamp = stamp_of(spark, inputs, params)
    at = current(spark, path)
    return read(spark, path) if at and at["stamp"] == stamp else commit(make(), path, stamp)

"""Rounded numbers against DuckDB's, to the sign of a zero."""

import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridloom.functions import scalars as S

from .duck import connect


def told_apart(rows):
    return sorted(repr(tuple(r)) for r in rows)


def test_a_rounded_zero_keeps_its_sign(spark):
    values = [-1e-7, 1e-7, -0.0, 0.0, -4.9e-7, -5.1e-7, 0.0078125, -0.0078125, -1.2345678, math.inf, -math.inf, math.nan, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").coalesce(1).select(S.rounded(F.col("x"), 6)).collect()]
    assert [repr(v) for v in got] == [repr(duckdb.execute("SELECT round(CAST(? AS DOUBLE), 6)", [v]).fetchone()[0]) for v in values]


@pytest.mark.parametrize("name", ["regression_oversampled", "smote_auto", "smote_nominal"])
def test_samplers_equal_their_sql_to_the_sign_of_a_zero(spark, tmp_path, name):
    n = 60
    rows = {"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.array([[(i * i % 17) / 16 - 0.5, -1e-7, 1e-7, (i * 7 % 23) / 23] for i in range(n)], pa.list_(pa.float32())), "label": pa.array([i % 5 % 4 for i in range(n)], pa.int32())}
    pq.write_table(pa.table(rows), tmp_path / "embeddings.parquet")
    got, sql = entry.queries()[name](spark, str(tmp_path)), connect(str(tmp_path)).sql(entry.oracle_sql()[name])
    assert told_apart(got.collect()) == told_apart(sql.project(", ".join(got.columns)).fetchall())

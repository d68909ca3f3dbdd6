"""Extension points: the engine's functions under SQL names, and user functions beside them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf


def register(spark: SparkSession) -> list[str]:
    """Register gl_wind_speed, gl_wind_direction, gl_gauss (macros in generated code), gl_rmse (an aggregate) and gl_lags (a table function); their names."""
    macros = {
        "gl_wind_speed(u DOUBLE, v DOUBLE)": "sqrt(u * u + v * v)",
        "gl_wind_direction(u DOUBLE, v DOUBLE)": "degrees(atan2(u, v)) + 180",
        "gl_gauss(x DOUBLE, mean DOUBLE, sigma DOUBLE)": "exp(-(x - mean) * (x - mean) / (2 * sigma * sigma))",
    }
    for head, body in macros.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS DOUBLE RETURN {body}")

    @pandas_udf("double")
    def gl_rmse(y: pd.Series, y_hat: pd.Series) -> float:
        return float(np.sqrt(((y - y_hat) ** 2).mean()))

    @udtf(returnType="lag int, at bigint")
    class Lags:
        def eval(self, at: int, lags: list[int]) -> Iterator[tuple[int, int]]:
            for lag in lags or []:
                yield lag, at - lag

    spark.udf.register("gl_rmse", gl_rmse)
    spark.udtf.register("gl_lags", Lags)
    return ["gl_wind_speed", "gl_wind_direction", "gl_gauss", "gl_rmse", "gl_lags"]


def register_batch(spark: SparkSession, name: str, f: Callable[..., pd.Series], kind: str) -> None:
    """A user's function of columns, called with Arrow batches."""
    from pyspark.sql.types import _parse_datatype_string

    first = pandas_udf(lambda *columns: f(*columns), _parse_datatype_string(kind), functionType=200)
    spark.udf.register(name, first)


def named(names: list[str]) -> Callable:
    """A cost function of keywords as one of a point."""
    return lambda f: lambda point: f(**dict(zip(names, point, strict=True)))

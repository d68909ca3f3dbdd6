"""Named queries over the star-schema tables and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cluster, combine, features, grid, linking, metrics, models, resample, rules, series
from ..sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SERIES_SQL = "series AS (SELECT event_type AS project, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, sum(value) AS y FROM events GROUP BY 1, 2)"
DAILY_SQL = "daily AS (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day, sum(o_totalprice) AS y FROM orders GROUP BY 1)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return T.hourly_series(T.read(spark, sf, "events"))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return T.daily_series(T.read(spark, sf, "orders"))


def vec(spark: SparkSession, sf: str) -> DataFrame:
    return T.vectors(T.read(spark, sf, "embeddings"))


def r6(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


@query(f"WITH {SERIES_SQL} SELECT project, hour, round(y, 4) AS y FROM series")
def hourly_series(spark, sf):
    return hourly(spark, sf).select("project", "hour", r6("y", 4))


@query(f"WITH {DAILY_SQL} SELECT day, round(y, 2) AS y FROM daily")
def daily_series(spark, sf):
    return daily(spark, sf).select("day", r6("y", 2))


@query(f"""WITH {DAILY_SQL}, d AS (SELECT day, DATE '1970-01-01' + CAST(day AS INTEGER) AS dt FROM daily)
SELECT day, month(dt) AS month, CAST((day + 3) % 7 AS BIGINT) AS weekday, round(sin(month(dt) * (2 * 3.141592653589793 / 12)), 6) AS month_sin, round(cos(month(dt) * (2 * 3.141592653589793 / 12)), 6) AS month_cos FROM d""")
def calendar_features(spark, sf):
    month = F.month(S.date_of_day(F.col("day")))
    sin, cos = S.turn(month, 12)
    return daily(spark, sf).select("day", month.cast("long").alias("month"), S.weekday_of_day(F.col("day")).cast("long").alias("weekday"), F.round(sin, 6).alias("month_sin"), F.round(cos, 6).alias("month_cos"))


#: Holidays with a fixed date (month, day).
HOLIDAYS = [(1, 1), (1, 6), (3, 25), (5, 1), (8, 15), (10, 28), (12, 25), (12, 26)]


@query(f"""WITH {DAILY_SQL}, d AS (SELECT day, DATE '1970-01-01' + CAST(day AS INTEGER) AS dt FROM daily)
SELECT day, CASE WHEN (month(dt), day(dt)) IN ((1,1),(1,6),(3,25),(5,1),(8,15),(10,28),(12,25),(12,26)) THEN 100 WHEN (day + 3) % 7 = 6 THEN 50 ELSE 0 END AS special FROM d""")
def special_day_index(spark, sf):
    return daily(spark, sf).select("day", S.special_day(F.col("day"), HOLIDAYS).alias("special"))


@query(f"""WITH {SERIES_SQL} SELECT s.project, s.hour, round(s.y, 4) AS y, round(a.y, 4) AS lag_0, round(b.y, 4) AS lag_1, round(c.y, 4) AS lag_2, round(d.y, 4) AS lag_3 FROM series s
JOIN series a ON a.project = s.project AND a.hour = s.hour - 24 JOIN series b ON b.project = s.project AND b.hour = s.hour - 48
JOIN series c ON c.project = s.project AND c.hour = s.hour - 96 JOIN series d ON d.project = s.project AND d.hour = s.hour - 168""")
def lag_vector_hourly(spark, sf):
    out = series.lag_vector(hourly(spark, sf), "hour", [24, 48, 96, 168], keys=("project",))
    return out.select("project", "hour", *[r6(c, 4) for c in ("y", "lag_0", "lag_1", "lag_2", "lag_3")])


def _lags_sql(lags: list[int]) -> str:
    cols = ", ".join(f"round(l{i}.y, 4) AS load_{i}" for i in range(len(lags)))
    joins = " ".join(f"LEFT JOIN series l{i} ON l{i}.project = s.project AND l{i}.hour = s.hour - {lag}" for i, lag in enumerate(lags))
    return f"WITH {SERIES_SQL} SELECT s.project, s.hour, round(s.y, 4) AS y, {cols} FROM series s {joins}"


@query(_lags_sql(series.LOAD_SHORT_TERM))
def load_short_term_lags(spark, sf):
    out = series.lag_vector(hourly(spark, sf), "hour", series.LOAD_SHORT_TERM, keys=("project",), complete=False, prefix="load")
    return out.select("project", "hour", r6("y", 4), *[r6(f"load_{i}", 4) for i in range(len(series.LOAD_SHORT_TERM))])


@query(_lags_sql(series.LOAD_DAY_AHEAD))
def load_day_ahead_lags(spark, sf):
    out = series.lag_vector(hourly(spark, sf), "hour", series.LOAD_DAY_AHEAD, keys=("project",), complete=False, prefix="load")
    return out.select("project", "hour", r6("y", 4), *[r6(f"load_{i}", 4) for i in range(len(series.LOAD_DAY_AHEAD))])


_GAS = [*series.GAS_CURRENT_DAY, *series.GAS_YEAR_BACK]


@query(f"WITH {DAILY_SQL} SELECT s.day, round(s.y, 2) AS y, " + ", ".join(f"round(l{i}.y, 2) AS lag_{i}" for i in range(len(_GAS))) + " FROM daily s " + " ".join(f"JOIN daily l{i} ON l{i}.day = s.day - {lag}" for i, lag in enumerate(_GAS)))
def lag_vector_daily(spark, sf):
    return series.lag_vector(daily(spark, sf), "day", _GAS).select("day", r6("y", 2), *[r6(f"lag_{i}", 2) for i in range(len(_GAS))])


@query(f"WITH {SERIES_SQL} SELECT s.project, s.hour, round(p.y, 4) AS prev, round(n.y, 4) AS next FROM series s LEFT JOIN series p ON p.project = s.project AND p.hour = s.hour - 1 LEFT JOIN series n ON n.project = s.project AND n.hour = s.hour + 1")
def neighbour_hours(spark, sf):
    return series.neighbours(hourly(spark, sf), "hour", keys=("project",)).select("project", "hour", r6("prev", 4), r6("next", 4))


@query(f"WITH {SERIES_SQL} SELECT project, hour, round(lag(y, 1) OVER w, 4) AS shift_1, round(lead(y, 2) OVER w, 4) AS shift_m2 FROM series WINDOW w AS (PARTITION BY project ORDER BY hour)")
def row_shift_lags(spark, sf):
    return series.row_shifts(hourly(spark, sf), "hour", [1, -2], keys=("project",)).select("project", "hour", r6("shift_1", 4), r6("shift_m2", 4))


@query(f"""WITH {SERIES_SQL}, pairs AS (SELECT a.project AS p1, b.project AS p2, a.hour, a.y AS y1, b.y AS y2 FROM series a JOIN series b ON a.hour = b.hour AND a.project < b.project),
s AS (SELECT p1, p2, y1, {", ".join(f"{'lag' if k >= 0 else 'lead'}(y2, {abs(k)}) OVER w AS s{k + 4}" for k in range(-4, 5))} FROM pairs WINDOW w AS (PARTITION BY p1, p2 ORDER BY hour)),
c AS ({" UNION ALL ".join(f"SELECT p1, p2, {k} AS shift, corr(y1, s{k + 4}) AS corr FROM s GROUP BY 1, 2" for k in range(-4, 5))})
SELECT p1, p2, shift AS lag, round(corr, 6) AS corr FROM c WHERE corr IS NOT NULL AND NOT isnan(corr) QUALIFY row_number() OVER (PARTITION BY p1, p2 ORDER BY round(corr, 9) DESC, abs(shift), shift) = 1""")
def best_lag_corr(spark, sf):
    return linking.best_lags(hourly(spark, sf)).select("p1", "p2", "lag", r6("corr"))


@query(f"WITH {SERIES_SQL}, g AS (SELECT project, hour, CASE WHEN hour % 3 <> 0 THEN NULL ELSE y END AS y FROM series) SELECT project, hour, round(first_value(y IGNORE NULLS) OVER (PARTITION BY project ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS y FROM g")
def backfill(spark, sf):
    holes = hourly(spark, sf).withColumn("y", F.when(F.col("hour") % 3 == 0, F.col("y")))
    return series.backfill(holes, "hour", "y", ("project",)).select("project", "hour", r6("y", 4))


@query(f"WITH {SERIES_SQL}, m AS (SELECT hour, avg(y) AS mean FROM series GROUP BY 1) SELECT hour, round(mean, 4) AS mean, round(max(mean) OVER (PARTITION BY hour // 24), 4) AS day_max, round(min(mean) OVER (PARTITION BY hour // 24), 4) AS day_min FROM m")
def day_extrema(spark, sf):
    return series.day_extrema(hourly(spark, sf)).select("hour", r6("mean", 4), r6("day_max", 4), r6("day_min", 4))


@query(f"""WITH {SERIES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY project) AS n, row_number() OVER (PARTITION BY project ORDER BY hour) - 1 AS r FROM series),
c AS (SELECT min(hour) AS cut FROM n WHERE r = least(round_even(n * 0.75, 0) + 1, n - 1)) SELECT project, hour, CASE WHEN hour > cut THEN 'test' ELSE 'train' END AS split FROM series, c""")
def chrono_split(spark, sf):
    return series.chronological_split(hourly(spark, sf), "hour", 0.25, ("project",)).select("project", "hour", "split")


@query(f"WITH {SERIES_SQL}, n AS (SELECT *, count(*) OVER (PARTITION BY project) AS n, row_number() OVER (PARTITION BY project ORDER BY hour) - 1 AS r FROM series) SELECT project, hour, r >= floor(n * 0.3) AND r <= floor(n * 0.3) + floor(n * 0.2) AS test FROM n")
def contiguous_holdout(spark, sf):
    return series.contiguous_holdout(hourly(spark, sf), "hour", 0.2, 0.3, ("project",)).select("project", "hour", "test")


@query("""WITH a AS (SELECT o_orderkey, round(o_totalprice, 4) AS p FROM orders WHERE o_orderkey % 3 <> 0), b AS (SELECT o_orderkey, round(o_totalprice, 4) AS p FROM orders WHERE o_orderkey % 3 <> 1)
SELECT o_orderkey, p AS o_totalprice FROM a UNION SELECT o_orderkey, p FROM b""")
def dedupe_merge(spark, sf):
    """Two overlapping histories, each row once."""
    orders = T.read(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return T.merge_history(orders.filter("o_orderkey % 3 <> 0"), orders.filter("o_orderkey % 3 <> 1"))


GRID_SQL = f"grid AS (SELECT hour, i, j, 30.0 + i * 0.5 AS lat, 20.0 + j * 0.5 AS lon, 3 + CAST(0.1 AS DOUBLE) * i + ((hour * 7 + i * 3 + j * 5) % 24) * CAST(0.01 AS DOUBLE) AS u, 2 - CAST(0.2 AS DOUBLE) * j + ((hour * 5 + i + j * 2) % 24) * CAST(0.02 AS DOUBLE) AS v FROM (SELECT DISTINCT hour FROM series), range(5) a(i), range(5) b(j))"


def cells(spark, sf):
    """A closed-form weather grid: 25 cells for each hour of the series."""
    hours = hourly(spark, sf).select("hour").distinct()
    ij = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(5) for j in range(5)])
    g = hours.withColumn("c", F.explode(ij)).select("hour", F.col("c.i").alias("i"), F.col("c.j").alias("j"))
    h, i, j = F.col("hour"), F.col("i"), F.col("j")
    return g.select("hour", "i", "j", (30 + i * 0.5).alias("lat"), (20 + j * 0.5).alias("lon"), (3 + i * 0.1 + (h * 7 + i * 3 + j * 5) % 24 * 0.01).alias("u"), (2 - j * 0.2 + (h * 5 + i + j * 2) % 24 * 0.02).alias("v"))


@query(f"WITH {SERIES_SQL}, {GRID_SQL} SELECT hour, i, j, round(sqrt(u * u + v * v), 5) AS ws, round(degrees(atan2(u, v)) + 180, 4) AS wd FROM grid")
def wind_vector(spark, sf):
    u, v = F.col("u"), F.col("v")
    return cells(spark, sf).select("hour", F.col("i").cast("long"), F.col("j").cast("long"), F.round(S.wind_speed(u, v), 5).alias("ws"), F.round(S.wind_direction(u, v), 4).alias("wd"))


@query(f"""WITH {SERIES_SQL}, {GRID_SQL}, r AS (SELECT hour, u, CASE WHEN (i, j) = (2, 2) THEN 'centre' WHEN (i, j) IN ((1,1),(1,2),(1,3),(2,1),(3,1)) THEN 'l1' WHEN (i, j) IN ((2,3),(3,2),(3,3)) THEN 'l2'
WHEN (i, j) IN ((0,0),(0,1),(0,2),(0,3),(0,4),(1,0),(2,0),(3,0),(4,0)) THEN 'l3d' WHEN (i, j) IN ((4,1),(4,2),(4,3),(4,4),(1,4),(2,4),(3,4)) THEN 'l3u' END AS ring FROM grid)
SELECT hour, ring, round(quantile_cont(u, 0.05), 5) AS p5, round(quantile_cont(u, 0.5), 5) AS p50, round(quantile_cont(u, 0.95), 5) AS p95, round(avg(u), 5) AS mean FROM r WHERE ring IS NOT NULL GROUP BY 1, 2""")
def grid_ring_percentiles(spark, sf):
    return grid.ring_features(cells(spark, sf), ["hour"], "u").select("hour", "ring", *[r6(c, 5) for c in ("p5", "p50", "p95", "mean")])


@query(f"WITH {SERIES_SQL}, {GRID_SQL} SELECT hour, CAST(i // 2 AS INTEGER) AS bi, CAST(j // 2 AS INTEGER) AS bj, round(avg(u), 5) AS mean FROM grid GROUP BY 1, 2, 3")
def block_mean_downsample(spark, sf):
    return grid.block_means(cells(spark, sf), ["hour"], "u").select("hour", "bi", "bj", r6("mean", 5))


@query(f"WITH {SERIES_SQL}, {GRID_SQL} SELECT hour, round(avg(u), 5) AS mean, round(quantile_cont(u, 0.1), 5) AS p10, round(quantile_cont(u, 0.9), 5) AS p90 FROM grid WHERE lat BETWEEN 30.5 AND 31.5 AND lon BETWEEN 20.5 AND 21.5 GROUP BY 1")
def area_filter(spark, sf):
    return grid.area_percentiles(grid.in_area(cells(spark, sf), (30.5, 31.5), (20.5, 21.5)), ["hour"], "u").select("hour", *[r6(c, 5) for c in ("mean", "p10", "p90")])


@query("SELECT c_custkey, round(round(30 + c_acctbal / 1000, 1) - 20 + ceil((30 + c_acctbal / 1000 - (round(30 + c_acctbal / 1000, 1) - 20)) / 0.25 - 0.5) * 0.25, 4) AS line FROM customer")
def nearest_grid_line(spark, sf):
    x = 30 + F.col("c_acctbal") / 1000
    return T.read(spark, sf, "customer").select("c_custkey", F.round(S.nearest_grid_line(x, 0.25), 4).alias("line"))


@query(f"WITH {SERIES_SQL}, {GRID_SQL}, t AS (SELECT hour, avg(y) AS y FROM series GROUP BY 1) SELECT i, j, round(corr(u, y), 6) AS corr FROM grid JOIN t USING (hour) GROUP BY 1, 2")
def cell_correlation_map(spark, sf):
    target = hourly(spark, sf).groupBy("hour").agg(F.avg("y").alias("y"))
    return cells(spark, sf).join(target, "hour").groupBy(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j")).agg(F.corr("u", "y").alias("corr")).select("i", "j", r6("corr"))


_GAUSS = rules.initial_memberships("x", 3)
_TRAP = rules.initial_memberships("x", 3, "trap")


def _gauss_sql(m) -> str:
    return f"exp(-((x - ({m.params[0]!r})) * (x - ({m.params[0]!r}))) / (2 * {m.params[1]!r} * {m.params[1]!r}))"


def _trap_sql(m) -> str:
    a, b, c, d = (repr(p) for p in sorted(m.params))
    return f"CASE WHEN x < {a} OR x > {d} THEN 0.0 WHEN x >= {b} AND x <= {c} THEN 1.0 WHEN x < {b} THEN (x - ({a})) / ({b} - ({a})) ELSE ({d} - x) / ({d} - ({c})) END"


XS_SQL = f"{SERIES_SQL}, xs AS (SELECT project, hour, y, (hour % 24) / 23.0 AS x FROM series)"


def xs(spark, sf):
    return hourly(spark, sf).withColumn("x", F.col("hour") % 24 / 23.0)


@query(f"WITH {XS_SQL} SELECT project, hour, " + ", ".join(f"round(pow({_gauss_sql(m)}, 0.5), 6) AS act_{n}" for n, m in enumerate(_GAUSS)) + " FROM xs")
def mf_activation_gauss(spark, sf):
    a = rules.with_activations(xs(spark, sf), rules.rule_base({"x": _GAUSS}))
    return a.select("project", "hour", *[F.round(F.col("activations")[n]["act"], 6).alias(f"act_{n}") for n in range(3)])


@query(f"WITH {XS_SQL} SELECT project, hour, " + ", ".join(f"round(pow(CAST({_trap_sql(m)} AS DOUBLE), 0.5), 6) AS act_{n}" for n, m in enumerate(_TRAP)) + " FROM xs")
def mf_activation_trap(spark, sf):
    a = rules.with_activations(xs(spark, sf), rules.rule_base({"x": _TRAP}))
    return a.select("project", "hour", *[F.round(F.col("activations")[n]["act"], 6).alias(f"act_{n}") for n in range(3)])


ACT_SQL = "act AS (" + " UNION ALL ".join(f"SELECT project, hour, y, 'rule.{n}' AS rule, pow({_gauss_sql(m)}, 0.5) AS act FROM xs" for n, m in enumerate(_GAUSS)) + ")"


@query(f"WITH {XS_SQL}, {ACT_SQL} SELECT project, rule, count(*) AS n FROM act WHERE act >= 0.4 GROUP BY 1, 2")
def rule_partition_counts(spark, sf):
    return rules.partitioned(xs(spark, sf), rules.rule_base({"x": _GAUSS}), 0.4).groupBy("project", "rule").agg(F.count(F.lit(1)).alias("n"))


LAGGED_SQL = f"{XS_SQL}, {ACT_SQL}, bounds AS (SELECT min(hour) + 504 AS cut FROM series), lagged AS (SELECT a.project, a.hour, a.rule, a.y, s.y AS lag24, a.hour <= b.cut AS train FROM act a JOIN series s ON s.project = a.project AND s.hour = a.hour - 24, bounds b WHERE a.act >= 0.01), fits AS (SELECT project, rule, regr_slope(y, lag24) AS slope, regr_intercept(y, lag24) AS intercept, count(*) AS n_train FROM lagged WHERE train GROUP BY 1, 2)"


def lagged(spark, sf):
    """Rows with their lag of a day, one for each active rule; train: the first 504 hours."""
    s = series.lag_vector(hourly(spark, sf), "hour", [24], keys=("project",)).withColumnRenamed("lag_0", "lag24")
    s = s.withColumn("x", F.col("hour") % 24 / 23.0)
    first = T.read(spark, sf, "events").agg(F.min(T.hour_number("ts")).alias("h0"))
    return rules.partitioned(s, rules.rule_base({"x": _GAUSS})).crossJoin(F.broadcast(first)).withColumn("train", F.col("hour") <= F.col("h0") + 504)  # one row


@query(f"WITH {LAGGED_SQL} SELECT project, rule, round(slope, 6) AS slope, round(intercept, 4) AS intercept, n_train FROM fits")
def rule_regression(spark, sf):
    return rules.regressions(lagged(spark, sf).filter("train"), ["project", "rule"], "y", "lag24").select("project", "rule", r6("slope"), r6("intercept", 4), "n_train")


def forecast(spark, sf):
    rows = lagged(spark, sf)
    fits = rules.regressions(rows.filter("train"), ["project", "rule"], "y", "lag24")
    return rules.rule_forecast(rows.filter("NOT train"), fits, ["project", "hour"], ["project", "rule"], "lag24")


FORECAST_SQL = f"{LAGGED_SQL}, pred AS (SELECT l.project, l.hour, avg(greatest(0, f.intercept + f.slope * l.lag24)) AS y_hat, any_value(l.y) AS y FROM lagged l JOIN fits f USING (project, rule) WHERE NOT train GROUP BY 1, 2)"


@query(f"WITH {FORECAST_SQL} SELECT project, hour, round(y_hat, 4) AS y_hat, round(y, 4) AS y FROM pred")
def rule_forecast_avg(spark, sf):
    return forecast(spark, sf).select("project", "hour", r6("y_hat", 4), r6("y", 4))


@query(f"WITH {FORECAST_SQL}, rated AS (SELECT project, max(y) AS rated FROM series GROUP BY 1) SELECT project, count(*) AS n, round(sqrt(avg(pow((y_hat - y) / rated, 2))), 6) AS rms, round(avg(abs(y_hat - y) / rated), 6) AS mae FROM pred JOIN rated USING (project) GROUP BY 1")
def forecast_error_by_site(spark, sf):
    """The flagship: error of the day-ahead forecast of each site."""
    rated = hourly(spark, sf).groupBy("project").agg(F.max("y").alias("rated"))
    return metrics.errors(forecast(spark, sf).join(rated, "project"), ["project"], scale="rated").select("project", "n", r6("rms"), r6("mae"))


PRED_SQL = f"{SERIES_SQL}, pred AS (" + " UNION ALL ".join(f"SELECT s.project, s.hour, 'lag{k}' AS method, l.y AS y_hat, s.y FROM series s JOIN series l ON l.project = s.project AND l.hour = s.hour - {k}" for k in (24, 48, 168)) + ")"


def predictions(spark, sf):
    """Lags of 24, 48 and 168 hours as methods, in long form."""
    wide = series.lag_vector(hourly(spark, sf), "hour", [24, 48, 168], keys=("project",), complete=False)
    made = F.explode(F.array(*[F.struct(F.lit(f"lag{k}").alias("method"), F.col(f"lag_{i}").alias("y_hat")) for i, k in enumerate((24, 48, 168))]))
    return wide.select("project", "hour", "y", made.alias("m")).select("project", "hour", "m.method", "m.y_hat", "y").filter("y_hat IS NOT NULL")


@query(f"WITH {PRED_SQL} SELECT project, method, count(*) AS n, round(sum(pow(y_hat - y, 2)), 2) AS sse, round(sqrt(avg(pow(abs(y_hat - y) / y, 2))), 5) AS rms, round(avg(abs(y_hat - y) / y), 5) AS mae, round(sum(pow(y_hat - y, 2)) / count(*), 3) AS mse FROM pred GROUP BY 1, 2")
def metrics_by_method(spark, sf):
    return metrics.errors(predictions(spark, sf), ["project", "method"]).select("project", "method", "n", r6("sse", 2), r6("rms", 5), r6("mae", 5), r6("mse", 3))


SCORES_SQL = f"{PRED_SQL}, scores AS (SELECT project, method, round(avg(abs(y_hat - y)), 4) AS mae FROM pred GROUP BY 1, 2)"


def scores(spark, sf):
    return predictions(spark, sf).groupBy("project", "method").agg(F.round(F.avg(F.abs(F.col("y_hat") - F.col("y"))), 4).alias("mae"))


@query(f"WITH {SCORES_SQL} SELECT project, method, mae FROM scores QUALIFY row_number() OVER (PARTITION BY project ORDER BY mae, method) = 1")
def best_trial(spark, sf):
    return metrics.best_trials(scores(spark, sf), ["project"], "mae", ["method"])


@query(f"WITH {SCORES_SQL} SELECT project, method, mae, row_number() OVER (PARTITION BY project ORDER BY mae, method) AS rank, round(mae - min(mae) OVER (PARTITION BY project), 4) AS gap, mae - min(mae) OVER (PARTITION BY project) <= 1.0 AS chosen FROM scores QUALIFY rank <= 2")
def top_methods(spark, sf):
    return metrics.top_methods(scores(spark, sf), ["project"], "mae", "method", 2, 1.0).select("project", "method", "mae", F.col("rank").cast("long").alias("rank"), r6("gap", 4), "chosen")


@query(f"WITH {PRED_SQL} SELECT project, hour, round(avg(y_hat), 4) AS y_hat FROM pred GROUP BY 1, 2")
def combine_average(spark, sf):
    return combine.average(predictions(spark, sf), ["project", "hour"]).select("project", "hour", r6("y_hat", 4))


BCP_SQL = f"{PRED_SQL}, s AS (SELECT project, method, sum(pow(y - y_hat, 2)) AS s, stddev_pop(y - y_hat) AS sd FROM pred GROUP BY 1, 2), l AS (SELECT project, method, -s / nullif(2 * pi() * sd * sd, 0) AS l FROM s), e AS (SELECT project, method, coalesce(exp(l - max(l) OVER (PARTITION BY project)), 0) AS e FROM l), w AS (SELECT project, method, e / nullif(sum(e) OVER (PARTITION BY project), 0) AS weight FROM e)"


@query(f"WITH {BCP_SQL} SELECT project, method, round(weight, 6) AS weight FROM w")
def bcp_weights(spark, sf):
    return combine.bcp_weights(predictions(spark, sf), ["project"]).select("project", "method", r6("weight"))


@query(f"WITH {BCP_SQL} SELECT project, hour, round(greatest(0, sum(y_hat * weight) / sum(weight)), 3) AS y_hat FROM pred JOIN w USING (project, method) GROUP BY 1, 2 HAVING sum(weight) > 0.000001")
def combine_weighted(spark, sf):
    p = predictions(spark, sf)
    w = combine.bcp_weights(p, ["project"])
    enough = p.join(w, ["project", "method"]).groupBy("project", "hour").agg(F.sum("weight").alias("s")).filter("s > 0.000001").select("project", "hour")
    return combine.weighted(p, w, ["project", "hour"], ["project", "method"]).join(enough, ["project", "hour"], "left_semi").select("project", "hour", r6("y_hat", 3))


@query(f"WITH {SERIES_SQL}, m AS (SELECT project, min(y) AS lo, max(y) AS hi FROM series GROUP BY 1) SELECT project, hour, round((y - lo) / (hi - lo), 6) AS y FROM series JOIN m USING (project)")
def minmax_scale(spark, sf):
    return features.scaled(hourly(spark, sf), ["y"], ("project",)).select("project", "hour", r6("y"))


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / (SELECT max(abs(l_quantity)) FROM lineitem), 6) AS l_quantity FROM lineitem")
def maxabs_scale(spark, sf):
    rows = T.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return features.scaled(rows, ["l_quantity"], kind="maxabs").select("l_orderkey", "l_linenumber", r6("l_quantity"))


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM lineitem" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :]))
def corr_matrix(spark, sf):
    return features.correlation_matrix(T.read(spark, sf, "lineitem"), _COLS).select("a", "b", r6("corr"))


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS feature, corr({a}, l_extendedprice) AS corr FROM lineitem" for a in ("l_quantity", "l_discount", "l_tax")) + ") SELECT feature, round(corr, 6) AS corr, CAST(row_number() OVER (ORDER BY abs(corr) DESC NULLS LAST, feature) AS INTEGER) AS rank FROM c")
def column_order_by_correlation(spark, sf):
    return features.correlations(T.read(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice").select("feature", r6("corr"), "rank")


@query("WITH r AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _COLS) + ") FROM lineitem), ".replace(") FROM", " FROM") + "x AS (SELECT greatest(abs(corr(l_quantity, l_extendedprice))) AS b, greatest(abs(corr(l_quantity, l_discount)), abs(corr(l_extendedprice, l_discount))) AS c, greatest(abs(corr(l_quantity, l_tax)), abs(corr(l_extendedprice, l_tax)), abs(corr(l_discount, l_tax))) AS d FROM r) SELECT 'l_quantity' AS feature, false AS dropped FROM x UNION ALL SELECT 'l_extendedprice', b > 0.5 FROM x UNION ALL SELECT 'l_discount', c > 0.5 FROM x UNION ALL SELECT 'l_tax', d > 0.5 FROM x")
def spearman_filter(spark, sf):
    return features.spearman_drops(T.read(spark, sf, "lineitem"), _COLS, 0.5)


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, round(max(n) / sum(n), 6) AS top_share, max(n) / sum(n) > 0.05 AS constant FROM (SELECT {c}, count(*) AS n FROM lineitem GROUP BY 1)" for c in _COLS))
def constant_filter(spark, sf):
    return features.constant_features(T.read(spark, sf, "lineitem"), _COLS, 0.05).select("feature", r6("top_share"), "constant")


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) SELECT CAST(label AS INTEGER) AS label, n, CASE WHEN row_number() OVER (ORDER BY n DESC, label) = 1 THEN n ELSE max(n) OVER () END AS target FROM c")
def strategy_counts(spark, sf):
    return resample.strategy(vec(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n")), "over")


NEAR_SQL = "v AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS f FROM embeddings), near AS MATERIALIZED (SELECT a.id, a.label, b.id AS other, b.label AS other_label, list_distance(a.f, b.f) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f), b.id) AS rank FROM v a JOIN v b ON a.id <> b.id)"


@query(f"WITH {NEAR_SQL} SELECT id, other, round(dist, 5) AS dist, CAST(rank AS INTEGER) AS rank FROM near WHERE rank <= 3")
def knn_self_join(spark, sf):
    v = vec(spark, sf)
    return resample.nearest(v, v, 3).select("id", "other", r6("dist", 5), "rank")


@query(f"WITH {NEAR_SQL} SELECT least(id, other) AS a, greatest(id, other) AS b FROM near WHERE rank = 1 AND label <> other_label GROUP BY 1, 2 HAVING count(*) = 2")
def tomek_links(spark, sf):
    return resample.tomek_links(vec(spark, sf))


@query(f"WITH {NEAR_SQL}, votes AS (SELECT id, label, other_label, count(*) AS n FROM near WHERE rank <= 3 GROUP BY 1, 2, 3) SELECT id FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, other_label) = 1 AND other_label = label")
def enn_mode(spark, sf):
    return resample.edited(vec(spark, sf)).select("id")


@query(f"WITH {NEAR_SQL} SELECT id FROM near WHERE rank <= 3 GROUP BY id HAVING count(*) FILTER (other_label <> label) = 0")
def enn_all(spark, sf):
    return resample.edited(vec(spark, sf), kind="all").select("id")


@query("""WITH v AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS f FROM embeddings), d AS (SELECT a.id, a.label, list_distance(a.f, b.f) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f), b.id) AS r FROM v a JOIN v b ON a.label <> 0 AND b.label = 0),
s AS (SELECT id, label, avg(dist) AS d FROM d WHERE r <= 3 GROUP BY 1, 2) SELECT id FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY d, id) <= (SELECT count(*) FROM v WHERE label = 0) UNION ALL SELECT id FROM v WHERE label = 0""")
def nearmiss1(spark, sf):
    return resample.near_miss(vec(spark, sf), 0).select("id")


@query(f"""WITH {NEAR_SQL}, k AS (SELECT * FROM near WHERE rank <= 3), votes AS (SELECT id, label, other_label, count(*) AS n FROM k GROUP BY 1, 2, 3), won AS (SELECT id, label, other_label AS won FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, other_label) = 1), wrong AS (SELECT id, label FROM won WHERE won <> label),
c AS (SELECT label, count(*) AS n FROM v GROUP BY 1), large AS (SELECT label FROM c WHERE label <> 0 AND n > 0.5 * (SELECT n FROM c WHERE label = 0)),
gone AS (SELECT id FROM wrong WHERE label <> 0 UNION SELECT other FROM k WHERE id IN (SELECT id FROM wrong WHERE label = 0) AND other_label IN (SELECT label FROM large)) SELECT id FROM v WHERE id NOT IN (SELECT id FROM gone)""")
def ncr(spark, sf):
    return resample.neighbourhood_cleaning(vec(spark, sf), 0).select("id")


@query(f"WITH {NEAR_SQL}, n AS (SELECT id, count(*) FILTER (other_label <> 1) AS f, count(*) AS m FROM near WHERE label = 1 AND rank <= 10 GROUP BY 1) SELECT id, f AS foreign FROM n WHERE 2 * f >= m AND f < m".replace("AS foreign", 'AS "foreign"'))
def borderline_danger(spark, sf):
    return resample.borderline(vec(spark, sf), 1)


@query(f"WITH {NEAR_SQL}, r AS (SELECT id, avg(CASE WHEN other_label <> 1 THEN 1.0 ELSE 0.0 END) AS q FROM near WHERE label = 1 AND rank <= 5 GROUP BY 1), s AS (SELECT id, CASE WHEN q = 0 THEN 0.01 ELSE q END AS q FROM r), n AS (SELECT id, q, CAST(round_even(q / sum(q) OVER () * 200, 0) AS INTEGER) AS n FROM s) SELECT id, round(q, 6) AS ratio, CASE WHEN n = 0 THEN 2 ELSE n END + 1 AS n FROM n")
def adasyn_counts(spark, sf):
    return resample.adasyn_counts(vec(spark, sf), 1, 200).select("id", r6("ratio"), "n")


V_SQL = "v AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS f FROM embeddings)"


def _draw(*parts: str, seed: int) -> str:
    """SQL of `resample.uniform`."""
    return f"(CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)}, '{seed}')), 1, 13) AS BIGINT) / 4503599627370496.0)"


def _smote_sql(targets: str, step: str = _draw("id", "copy", seed=1), asked: str | None = None) -> str:
    """CTEs up to `made` (id, copy, label, features): synthetic rows of each class by `targets` (label, target)."""
    asked = asked or f"asked AS (SELECT o.id, o.label, o.f, (target - n) // n + CASE WHEN r <= (target - n) % n THEN 1 ELSE 0 END AS m FROM (SELECT *, count(*) OVER (PARTITION BY label) AS n, row_number() OVER (PARTITION BY label ORDER BY {_draw('id', seed=0)}, id) AS r FROM v) o JOIN ({targets}) t ON t.label = o.label AND target > n)"
    return f"""{asked}, nn AS MATERIALIZED (SELECT a.id, b.id AS other, b.f AS g, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f), b.id) AS rank, count(*) OVER (PARTITION BY a.id) AS others FROM asked a JOIN v b ON a.label = b.label AND a.id <> b.id),
copies AS (SELECT id, label, f, unnest(range(1, CAST(m AS BIGINT) + 1)) AS copy FROM asked),
drawn AS (SELECT c.id, c.label, c.copy, c.f, n.g FROM copies c JOIN nn n ON n.id = c.id AND n.rank = 1 + floor({_draw('c.id', 'c.copy', seed=0)} * least(5, n.others))),
made AS (SELECT id, CAST(copy AS INTEGER) AS copy, label, list_transform(range(1, len(f) + 1), lambda i: f[i] + {step} * (g[i] - f[i])) AS features FROM drawn)"""


_MADE = "SELECT id, copy, label, list_transform(features, lambda x: round(x, 6)) AS features FROM made"
_OVER = "SELECT label, max(count(*)) OVER () AS target FROM v GROUP BY label"


@query(f"WITH {V_SQL}, {_smote_sql('SELECT 1 AS label, count(*) + 100 AS target FROM v WHERE label = 1')} {_MADE}")
def smote(spark, sf):
    """A hundred rows of one class."""
    return _rounded(resample.smote(vec(spark, sf), 1, 100))


@query(f"WITH {V_SQL}, {_smote_sql(_OVER)} {_MADE}")
def smote_auto(spark, sf):
    """Every class but the largest up to the largest."""
    return _rounded(resample.smote_to(vec(spark, sf), resample.strategy(_targets(spark, sf), "over")))


_ADASYN = f"""lack AS (SELECT label, max(count(*)) OVER () - count(*) AS lack FROM v GROUP BY label), nall AS MATERIALIZED (SELECT a.id, a.label, b.label AS other_label, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f), b.id) AS rank FROM v a JOIN v b ON a.id <> b.id WHERE a.label IN (SELECT label FROM lack WHERE lack > 0)),
ratios AS (SELECT id, label, CASE WHEN q = 0 THEN 0.01 ELSE q END AS q FROM (SELECT id, label, avg(CASE WHEN other_label <> label THEN 1.0 ELSE 0.0 END) AS q FROM nall WHERE rank <= 5 GROUP BY 1, 2)),
n AS (SELECT id, label, CAST(round_even(q / sum(q) OVER (PARTITION BY label) * lack, 0) AS INTEGER) AS n FROM ratios JOIN lack USING (label)), asked AS (SELECT v.id, v.label, v.f, CASE WHEN n = 0 THEN 2 ELSE n END + 1 AS m FROM n JOIN v USING (id))"""


@query(f"WITH {V_SQL}, {_smote_sql('', _draw('id', 'copy', 'i - 1', seed=1), _ADASYN)} {_MADE}")
def adasyn(spark, sf):
    """Every class but the largest, by the share of other classes near each row."""
    return _rounded(resample.adasyn_to(vec(spark, sf), resample.strategy(_targets(spark, sf), "over")))


def _rounded(made):
    return made.select("id", "copy", "label", F.transform("features", lambda x: S.rounded(x, 6)).alias("features"))


@query(f"""WITH RECURSIVE {V_SQL}, far AS (SELECT a.id, min(list_distance(a.f, b.f)) AS far FROM v a JOIN v b ON b.label = 0 WHERE a.label <> 0 GROUP BY 1),
rest AS MATERIALIZED (SELECT a.id, a.label, row_number() OVER (PARTITION BY a.label ORDER BY a.id) AS k, list(b.id) FILTER (list_distance(a.f, b.f) <= far) AS near FROM v a JOIN far USING (id) LEFT JOIN v b ON b.label = a.label AND b.id < a.id GROUP BY a.id, a.label),
grown AS (SELECT DISTINCT label, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS store FROM rest UNION ALL SELECT g.label, r.k, CASE WHEN list_has_any(store, coalesce(r.near, [])) THEN store ELSE list_append(store, r.id) END FROM grown g JOIN rest r ON r.label = g.label AND r.k = g.k + 1)
SELECT id, label FROM v WHERE label = 0 UNION ALL SELECT unnest(store) AS id, label FROM (SELECT label, store FROM grown QUALIFY row_number() OVER (PARTITION BY label ORDER BY k DESC) = 1)""")
def condensed_nn(spark, sf):
    return resample.condensed(vec(spark, sf), 0).select("id", "label")


def _edited_sql(k: int, rows: str, out: str) -> str:
    """CTEs of one pass of edited nearest neighbours over `rows` (id, label, f)."""
    return f"""near_{out} AS MATERIALIZED (SELECT a.id, a.label, b.label AS other_label, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f), b.id) AS rank FROM {rows} a JOIN {rows} b ON a.id <> b.id),
won_{out} AS (SELECT id FROM (SELECT id, label, other_label, count(*) AS n FROM near_{out} WHERE rank <= {k} GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, other_label) = 1 AND other_label = label),
{out} AS MATERIALIZED (SELECT * FROM {rows} WHERE id IN (SELECT id FROM won_{out}))"""


@query(f"WITH {V_SQL}, {_edited_sql(1, 'v', 'k1')}, {_edited_sql(2, 'k1', 'k2')}, {_edited_sql(3, 'k2', 'k3')} SELECT id, label FROM k3")
def all_knn(spark, sf):
    return resample.all_knn(vec(spark, sf), 3).select("id", "label")


_REPEATED = f"""q0 AS MATERIALIZED (SELECT id, CAST(label % 2 AS INTEGER) AS label, f FROM v), few AS MATERIALIZED (SELECT label FROM q0 GROUP BY 1 ORDER BY count(*), label LIMIT 1),
q AS (SELECT 0 AS round, false AS over, id, label FROM q0 UNION ALL (WITH was AS MATERIALIZED (SELECT round, q0.* FROM q JOIN q0 USING (id) WHERE NOT over), {_edited_sql(3, "was", "t")}, n AS MATERIALIZED (SELECT label, count(*) AS n FROM t GROUP BY 1)
SELECT round + 1, (SELECT min(n) FROM n) < (SELECT n FROM n JOIN few USING (label)), id, label FROM t WHERE (SELECT count(*) FROM t) < (SELECT count(*) FROM was) AND (SELECT count(*) FROM n) = (SELECT count(DISTINCT label) FROM q0)))"""


@query(f"WITH RECURSIVE {V_SQL}, {_REPEATED} SELECT id, label FROM q WHERE round = (SELECT max(round) FROM q)")
def repeated_enn(spark, sf):
    """Edited nearest neighbours of two classes until nothing goes."""
    return resample.repeated_edited(vec(spark, sf).withColumn("label", (F.col("label") % 2).cast("int")), 3).select("id", "label")


def _targets(spark, sf):
    return vec(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {V_SQL} SELECT id, label FROM v QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_draw('id', seed=0)}, id) <= (SELECT min(n) FROM (SELECT count(*) AS n FROM v GROUP BY label))")
def random_under_sampler(spark, sf):
    return resample.random_under(vec(spark, sf), resample.strategy(_targets(spark, sf), "under")).select("id", "label")


@query(f"WITH {V_SQL}, c AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS top FROM v GROUP BY label), r AS (SELECT id, label, n, top - n AS lack, row_number() OVER (PARTITION BY label ORDER BY {_draw('id', seed=0)}, id) AS r FROM v JOIN c USING (label)) SELECT id, label, unnest(range(0, CAST(lack // n + CASE WHEN r <= lack % n THEN 1 ELSE 0 END + 1 AS BIGINT))) AS copy FROM r")
def random_over_sampler(spark, sf):
    return resample.random_over(vec(spark, sf), resample.strategy(_targets(spark, sf), "over")).select("id", "label", "copy")


@query("SELECT doc_id AS id, toxic AS label FROM labels QUALIFY row_number() OVER (PARTITION BY toxic ORDER BY doc_id) <= CASE WHEN toxic = 1 THEN 20 ELSE 100 END")
def make_imbalance(spark, sf):
    """At most 100 rows of class 0 and 20 of class 1, by id."""
    rows = T.read(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    w = Window.partitionBy("label").orderBy("id")
    return rows.withColumn("r", F.row_number().over(w)).filter("r <= CASE WHEN label = 1 THEN 20 ELSE 100 END").select("id", "label")


CENTRES_SQL = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f FROM embeddings), cs AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS c, f AS centre FROM v WHERE id IN (0, 1, 2)), d AS (SELECT v.id, v.f, cs.c, pow(list_distance(v.f, cs.centre), 2) AS d2 FROM v, cs), u AS (SELECT id, f, c, d2, (1 / greatest(d2, 1e-12)) / sum(1 / greatest(d2, 1e-12)) OVER (PARTITION BY id) AS u FROM d)"


def first_centres(spark, sf):
    rows = vec(spark, sf).filter("id IN (0, 1, 2)").orderBy("id").collect()
    return spark.createDataFrame([(n, r.features) for n, r in enumerate(rows)], "c int, centre array<double>")


def member(spark, sf):
    return cluster.memberships(vec(spark, sf).select("id", "features"), first_centres(spark, sf))


@query(f"WITH {CENTRES_SQL}, e AS (SELECT c, u * u AS w, unnest(f) AS x, generate_subscripts(f, 1) - 1 AS dim FROM u) SELECT c, CAST(dim AS INTEGER) AS dim, round(sum(w * x) / sum(w), 5) AS value FROM e GROUP BY 1, 2")
def fcm_step(spark, sf):
    return cluster.next_centres(member(spark, sf)).select("c", "dim", r6("value", 5))


@query(f"WITH {CENTRES_SQL} SELECT round(sum(u * u) / count(DISTINCT id), 6) AS partition_coefficient FROM u")
def partition_coefficient(spark, sf):
    return cluster.partition_coefficient(member(spark, sf)).select(r6("partition_coefficient"))


@query(f"WITH {CENTRES_SQL}, g AS (SELECT min(pow(list_distance(a.centre, b.centre), 2)) AS gap FROM cs a JOIN cs b ON a.c < b.c) SELECT round(sum(u * u * d2) / (count(DISTINCT id) * any_value(gap)), 5) AS xie_beni FROM u, g")
def xie_beni(spark, sf):
    return cluster.xie_beni(member(spark, sf), first_centres(spark, sf)).select(r6("xie_beni", 5))


@query(f"WITH {CENTRES_SQL}, h AS (SELECT id, c, sqrt(d2) AS d FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, c) = 1), s AS (SELECT c, avg(d) AS s FROM h GROUP BY 1), r AS (SELECT a.c, max((sa.s + sb.s) / list_distance(a.centre, b.centre)) AS r FROM cs a JOIN cs b ON a.c <> b.c JOIN s sa ON sa.c = a.c JOIN s sb ON sb.c = b.c GROUP BY 1) SELECT round(avg(r), 5) AS davies_bouldin FROM r")
def davies_bouldin(spark, sf):
    return cluster.davies_bouldin(member(spark, sf), first_centres(spark, sf)).select(r6("davies_bouldin", 5))


@query("""WITH x AS (SELECT quality AS y, 1 - toxic AS g FROM labels), l AS (SELECT DISTINCT y AS label FROM x UNION SELECT DISTINCT g FROM x),
s AS (SELECT label, count(*) FILTER (y = label AND g = label) AS tp, count(*) FILTER (y <> label AND g = label) AS fp, count(*) FILTER (y = label AND g <> label) AS fn, count(*) FILTER (y <> label AND g <> label) AS tn FROM l, x GROUP BY 1),
m AS (SELECT label, tp + fn AS support, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(tn / nullif(tn + fp, 0), 0) AS s FROM s)
SELECT label, support, round(p, 6) AS precision, round(r, 6) AS recall, round(s, 6) AS specificity, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, round(sqrt(r * s), 6) AS gmean, round((1 + 0.1 * (r - s)) * r * s, 6) AS iba FROM m""")
def sens_spec_gmean(spark, sf):
    rows = T.read(spark, sf, "labels").select(F.col("quality").alias("y"), (1 - F.col("toxic")).alias("g"))
    return metrics.class_report(rows, "y", "g").select("label", "support", *[r6(c) for c in ("precision", "recall", "specificity", "f1", "gmean", "iba")])


@query(f"WITH {PRED_SQL} SELECT project, CAST(q AS DOUBLE) AS q, round(v, 4) AS value FROM (SELECT project, unnest([0.1, 0.5, 0.9]) AS q, unnest(quantile_cont(y - y_hat, [0.1, 0.5, 0.9])) AS v FROM pred WHERE method = 'lag24' GROUP BY project)")
def residual_quantiles(spark, sf):
    p = predictions(spark, sf).filter("method = 'lag24'").withColumn("e", F.col("y") - F.col("y_hat"))
    return models.quantiles(p, ["project"], "e", [0.1, 0.5, 0.9]).select("project", F.col("q").cast("double").alias("q"), r6("value", 4))


@query()
def rls_weights(spark, sf):
    wide = series.lag_vector(hourly(spark, sf), "hour", [24, 48, 168], keys=("project",))
    return combine.rls_weights(wide, "project", "hour", ["lag_0", "lag_1", "lag_2"]).select("project", "method", r6("weight"))


@query()
def rbf_ols(spark, sf):
    wide = features.scaled(series.lag_vector(hourly(spark, sf), "hour", [24, 48], keys=("project",)), ["y", "lag_0", "lag_1"], ("project",))
    return models.rbf_ols(wide, "project", ["lag_0", "lag_1"], "y", 2.0)


@query()
def forest_regressor(spark, sf):
    """Forecasts of the last quarter by a forest that was fitted on the rest."""
    wide = series.lag_vector(hourly(spark, sf), "hour", [24, 48], keys=("project",)).withColumn("of_day", F.col("hour") % 24)
    split = series.chronological_split(wide, "hour", 0.25, ("project",))
    model = models.forest(split.filter("split = 'train'"), ["lag_0", "lag_1", "of_day"], "y")
    return model.transform(split.filter("split = 'test'")).select("project", "hour", F.round("prediction", 4).alias("y_hat"))


@query(f"""WITH RECURSIVE {SERIES_SQL}, h AS (SELECT max(hour) AS h FROM series), pairs AS (SELECT s.project, s.y, l.y AS x FROM series s JOIN series l ON l.project = s.project AND l.hour = s.hour - 1), f AS (SELECT project, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM pairs GROUP BY 1),
r AS (SELECT s.project, 0 AS step, s.y AS v, h FROM series s JOIN h ON s.hour = h.h UNION ALL SELECT r.project, step + 1, f.a + f.b * r.v, h FROM r JOIN f USING (project) WHERE step < 4) SELECT project, h + step AS hour, step, round(v, 4) AS y_hat FROM r WHERE step > 0""")
def recursive_short_term(spark, sf):
    from ..streaming import online

    s = hourly(spark, sf)
    fits = rules.regressions(series.lag_vector(s, "hour", [1], keys=("project",)), ["project"], "y", "lag_0")
    last = T.read(spark, sf, "events").agg(F.max(T.hour_number("ts"))).collect()[0][0]
    return online.recursive(s, fits, last, 4, ["project"]).select("project", "hour", "step", r6("y_hat", 4))


@query(f"WITH {CENTRES_SQL}, h AS (SELECT id, min(d2) AS d2 FROM d GROUP BY 1), g AS (SELECT min(list_distance(a.centre, b.centre)) AS gap FROM cs a JOIN cs b ON a.c < b.c) SELECT round(any_value(gap) / (2 * max(sqrt(d2))), 5) AS dunn FROM h, g")
def dunn_index(spark, sf):
    return cluster.dunn(member(spark, sf), first_centres(spark, sf)).select(r6("dunn", 5))


@query(f"WITH {CENTRES_SQL}, e AS (SELECT unnest(f) AS x, generate_subscripts(f, 1) AS dim FROM v), m AS (SELECT list(x ORDER BY dim) AS mean FROM (SELECT dim, avg(x) AS x FROM e GROUP BY 1)), e1 AS (SELECT sum(list_distance(f, mean)) AS e1 FROM v, m), g AS (SELECT max(list_distance(a.centre, b.centre)) AS gap FROM cs a JOIN cs b ON a.c < b.c), j AS (SELECT sum(u * u * sqrt(d2)) AS jm FROM u) SELECT round(pow(e1 / (3 * jm) * gap, 2), 5) AS pbmf FROM e1, j, g")
def pbmf_index(spark, sf):
    return cluster.pbmf(member(spark, sf), first_centres(spark, sf)).select(r6("pbmf", 5))


@query(f"WITH {SERIES_SQL}, s AS (SELECT min(y) AS lo, stddev_pop(y) AS sd FROM series), b AS (SELECT CAST(greatest(ceil((y - lo) / sd), 0) AS INTEGER) AS bin FROM series, s), c AS (SELECT bin, count(*) AS n FROM b GROUP BY 1), k AS (SELECT bin, n, last_value(CASE WHEN n >= 2 THEN bin END IGNORE NULLS) OVER (ORDER BY bin ROWS UNBOUNDED PRECEDING) AS j FROM c) SELECT coalesce(j, bin) AS bin, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1")
def deviation_bins(spark, sf):
    return resample.bins_by_deviation(hourly(spark, sf), "y")


@query("WITH c AS (SELECT p_partkey, p_retailprice AS a, p_size AS b FROM part) SELECT p_partkey FROM c x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.a <= x.a AND y.b <= x.b AND (y.a < x.a OR y.b < x.b))")
def pareto_front(spark, sf):
    from ..operators import search

    parts = T.read(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("a"), F.col("p_size").alias("b"))
    return search.pareto_front(parts, "a", "b").select("p_partkey")


@query(f"WITH {SERIES_SQL}, c AS (SELECT project, unnest(range(min(hour), max(hour) + 1)) AS hour FROM series GROUP BY 1) SELECT c.project, c.hour FROM c LEFT JOIN series s ON s.project = c.project AND s.hour = c.hour WHERE s.hour IS NULL")
def missing_hours(spark, sf):
    """Calendar hours between a site's first and last that it has no value for."""
    have = hourly(spark, sf).select("project", "hour")
    ends = have.groupBy("project").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    return ends.select("project", F.explode(F.sequence("a", "b")).alias("hour")).join(have, ["project", "hour"], "left_anti")


@query(f"WITH {SERIES_SQL} SELECT project, hour // 24 AS run_day, hour, round(y, 4) AS y FROM series WHERE hour // 24 IN (SELECT DISTINCT hour // 24 + 1 FROM series)")
def run_selection(spark, sf):
    """Hours that the day-ahead run of the day before covers: runs become hours first, then an equi-join."""
    runs = hourly(spark, sf).select(F.floor(F.col("hour") / 24).alias("run_day")).distinct()
    valid = series.days_of(runs).select("hour")
    return hourly(spark, sf).join(valid, "hour").select("project", F.floor(F.col("hour") / 24).alias("run_day"), "hour", r6("y", 4))


@query(f"WITH {XS_SQL}, {ACT_SQL}, h AS (SELECT max(hour) - 24 AS h FROM series) SELECT DISTINCT project, rule FROM act, h WHERE act >= 0.6 AND hour > h")
def rules_to_retrain(spark, sf):
    """Rules that the last day's rows activate."""
    last = T.read(spark, sf, "events").agg((F.max(T.hour_number("ts")) - 24).alias("h"))
    rows = xs(spark, sf).crossJoin(F.broadcast(last)).filter("hour > h").drop("h")  # one row
    return rules.partitioned(rows, rules.rule_base({"x": _GAUSS}), 0.6).select("project", "rule").distinct()


def _tomek_sql(rows: str) -> str:
    """CTE `ends`: ids of both members of the Tomek links of `rows` (id, label, f)."""
    return f"""t1 AS MATERIALIZED (SELECT a.id, a.label, b.id AS other, b.label AS other_label FROM {rows} a JOIN {rows} b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f), b.id) = 1),
ends AS (SELECT x.id FROM t1 x JOIN t1 y ON x.other = y.id AND y.other = x.id WHERE x.label <> x.other_label)"""


@query(f"""WITH {V_SQL}, s AS (SELECT * FROM v WHERE label = 0 OR id IN (1, 2, 3)), w AS (SELECT a.id, a.label, b.label AS got FROM v a JOIN s b ON a.id <> b.id WHERE a.label <> 0 AND a.id NOT IN (1, 2, 3) QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f), b.id) = 1),
l AS MATERIALIZED (SELECT * FROM s UNION ALL SELECT * FROM v WHERE id IN (SELECT id FROM w WHERE got <> label)), {_tomek_sql('l')} SELECT id, label FROM l WHERE label = 0 OR id NOT IN (SELECT id FROM ends)""")
def one_sided_selection(spark, sf):
    return resample.one_sided(vec(spark, sf), 0, [1, 2, 3]).select("id", "label")


_BOTH = "every AS MATERIALIZED (SELECT id, label, f FROM v UNION ALL SELECT (SELECT max(id) FROM v) + row_number() OVER (ORDER BY id, copy), label, features FROM made)"
_THIRTY = _smote_sql("SELECT 1 AS label, count(*) + 30 AS target FROM v WHERE label = 1")


@query(f"WITH {V_SQL}, {_THIRTY}, {_BOTH}, {_tomek_sql('every')} SELECT id, label FROM every WHERE id NOT IN (SELECT id FROM ends)")
def smote_tomek(spark, sf):
    return resample.smote_tomek(vec(spark, sf), 1, 30).select("id", "label")


@query(f"""WITH {V_SQL}, {_THIRTY}, {_BOTH}, n3 AS (SELECT a.id, a.label, b.label AS other_label, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f), b.id) AS rank FROM every a JOIN every b ON a.id <> b.id)
SELECT id, label FROM n3 WHERE rank <= 3 GROUP BY 1, 2 HAVING count(*) FILTER (other_label <> label) = 0""")
def smote_enn(spark, sf):
    return resample.smote_enn(vec(spark, sf), 1, 30).select("id", "label")


from . import extended  # noqa: E402, F401  adds its queries

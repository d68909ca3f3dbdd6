"""Further named queries: frames, weather, calendars, encodings, rules, clustering steps and samplers, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import calendar as C
from ..functions import scalars as S
from ..operators import alternating, cluster, combine, evolve, features, frames, grid, machines, metrics, networks, oversample, rbf, recursive, resample, rulebase, rules, series, weather
from ..sources import tables as T
from ..streaming import stateful
from .catalog import _GAUSS, ACT_SQL, BCP_SQL, DAILY_SQL, GRID_SQL, LAGGED_SQL, NEAR_SQL, PRED_SQL, SCORES_SQL, SERIES_SQL, V_SQL, XS_SQL, _draw, _lags_sql, _MADE, _rounded, _smote_sql, cells, daily, first_centres, hourly, lagged, predictions, query, r6, scores, vec, xs

RATED_SQL = f"{SERIES_SQL}, rated AS (SELECT project, max(y) AS rated FROM series GROUP BY 1)"
WIDE_SQL = f"{SERIES_SQL}, wide AS (SELECT s.project, s.hour, s.y, a.y AS lag24, b.y AS lag48, c.y AS lag168 FROM series s LEFT JOIN series a ON a.project = s.project AND a.hour = s.hour - 24 LEFT JOIN series b ON b.project = s.project AND b.hour = s.hour - 48 LEFT JOIN series c ON c.project = s.project AND c.hour = s.hour - 168)"


def rated(spark, sf):
    return hourly(spark, sf).groupBy("project").agg(F.max("y").alias("rated"))


def wide(spark, sf):
    out = series.lag_vector(hourly(spark, sf), "hour", [24, 48, 168], keys=("project",), complete=False)
    return out.withColumnsRenamed({"lag_0": "lag24", "lag_1": "lag48", "lag_2": "lag168"})


@query(f"WITH {RATED_SQL} SELECT project, round(rated, 4) AS rated FROM rated UNION ALL SELECT 'all_sites', round(sum(rated), 4) FROM rated")
def rated_total(spark, sf):
    return frames.rated_total(rated(spark, sf), "all_sites").select("project", r6("rated", 4))


@query(f"WITH {DAILY_SQL}, m AS (SELECT min(day) + 1500 AS last FROM daily) SELECT 'train' AS part, day FROM daily, m WHERE day <= last UNION ALL SELECT 'evaluation' AS part, day FROM daily, m WHERE day > last - 372")
def evaluation_split(spark, sf):
    d = daily(spark, sf).select("day")
    at = d.agg(F.min("day")).collect()[0][0] + 1500
    train, rest = frames.evaluation_split(d, "day", at, "gas")
    return train.select(F.lit("train").alias("part"), "day").union(rest.select(F.lit("evaluation").alias("part"), "day"))


_LINE = "(round(x, 0) - 20 + ceil((x - (round(x, 0) - 20)) / 0.25 - 0.5) * 0.25)"


@query(f"WITH c AS (SELECT c_custkey, 30 + c_acctbal / 1000 AS x FROM customer) SELECT c_custkey, round({_LINE} - 0.5, 4) AS lat1, round({_LINE} + 0.5, 4) AS lat2 FROM c")
def area_box(spark, sf):
    x = 30 + F.col("c_acctbal") / 1000
    lo, hi, _, _ = weather.area_box(x, x, 0.25)
    return T.read(spark, sf, "customer").select("c_custkey", F.round(lo, 4).alias("lat1"), F.round(hi, 4).alias("lat2"))


@query(f"WITH {WIDE_SQL} SELECT project, hour, round(CASE WHEN (hour % 24) BETWEEN 6 AND 18 THEN lag24 ELSE 0 END, 4) AS y_hat FROM wide WHERE lag24 IS NOT NULL")
def daylight_forecast(spark, sf):
    """Forecasts of the hours with light, 0 at night."""
    w = wide(spark, sf).filter("lag24 IS NOT NULL").withColumn("flux", F.when((F.col("hour") % 24).between(6, 18), 1.0).otherwise(0.0))
    pred = weather.in_daylight(w, "flux").select("project", "hour", F.col("lag24").alias("y_hat"))
    return weather.night_as_zero(w, pred, ["project", "hour"]).select("project", "hour", r6("y_hat", 4))


@query("SELECT l_orderkey, l_linenumber, round((l_discount + l_tax) / 2, 6) AS rate FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem)")
def matching_mean(spark, sf):
    """The mean of all columns whose names hold a part, whatever the case."""
    rows = T.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("Rate_discount"), F.col("l_tax").alias("rate_tax"))
    return weather.mean_of_matching(rows, "RATE", "mean").select("l_orderkey", "l_linenumber", F.round("mean", 6).alias("rate"))


@query(f"WITH {RATED_SQL}, c AS (SELECT project FROM series GROUP BY 1 HAVING count(*) >= (SELECT max(n) FROM (SELECT count(*) AS n FROM series GROUP BY project))) SELECT project FROM rated WHERE project NOT IN (SELECT project FROM c)")
def unknown_names(spark, sf):
    """Sites that have a rated power, but not as many hours as the longest series."""
    n = hourly(spark, sf).groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    full = n.join(n.agg(F.max("n").alias("n")), "n").select("project")
    return frames.unknown_names(rated(spark, sf), rated(spark, sf), full)


@query(f"WITH {SERIES_SQL}, {GRID_SQL}, m AS (SELECT hour, avg(u) AS u FROM grid GROUP BY 1), e AS (SELECT event_id, CAST(round_even(epoch(ts) / 3600.0, 0) AS BIGINT) AS hour FROM events) SELECT event_id, hour, round(u, 5) AS u FROM e JOIN m USING (hour)")
def events_with_weather(spark, sf):
    """Every event with the weather of its nearest hour."""
    means = cells(spark, sf).groupBy("hour").agg(F.avg("u").alias("u"))
    events = T.read(spark, sf, "events").select("event_id", (F.expr(f"timestampdiff(MICROSECOND, {T.EPOCH}, ts)") / 1e6).alias("seconds"))
    return frames.joined_by_hour(events, means, "seconds").select("event_id", "hour", r6("u", 5))


@query(f"WITH {SERIES_SQL} SELECT DISTINCT hour, (hour - 1) // 24 AS run_day FROM series")
def short_run_selection(spark, sf):
    return weather.runs_for(hourly(spark, sf), day_ahead=False)


@query("WITH m AS (SELECT avg(nullif(l_discount, 0)) AS a FROM lineitem) SELECT l_orderkey, l_linenumber, round(coalesce(nullif(l_discount, 0), a), 6) AS l_discount FROM lineitem, m")
def imputed(spark, sf):
    """Discounts that aren't given become the mean of those that are."""
    rows = T.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"))
    return frames.imputed(rows, ["l_discount"]).select("l_orderkey", "l_linenumber", r6("l_discount"))


@query(f"WITH {XS_SQL}, {ACT_SQL} SELECT s.project, s.hour, round(a.act, 6) AS y_hat FROM series s LEFT JOIN act a ON a.project = s.project AND a.hour = s.hour AND a.rule = 'rule.1' AND a.act >= 0.6")
def scattered(spark, sf):
    """One rule's activation on the whole index, null where it isn't active."""
    active = rules.partitioned(xs(spark, sf), rules.rule_base({"x": _GAUSS}), 0.6).filter("rule = 'rule.1'").select("project", "hour", F.col("act").alias("y_hat"))
    return frames.scattered(hourly(spark, sf), active, ["project", "hour"]).select("project", "hour", r6("y_hat"))


@query(f"WITH {WIDE_SQL} SELECT round((corr(a.lag24, b.lag48) + corr(a.lag48, b.lag168)) / 2, 6) AS corr FROM wide a JOIN (SELECT project, hour, lag48, lag168 FROM wide) b USING (project, hour)".replace("corr(a.lag24, b.lag48)", "corr(a.lag24, b.lag48)"))
def mean_correlation(spark, sf):
    """The mean correlation of two frames' columns of one name."""
    w = wide(spark, sf)
    a = w.select("project", "hour", F.col("lag24").alias("one"), F.col("lag48").alias("two"))
    b = w.select("project", "hour", F.col("lag48").alias("one"), F.col("lag168").alias("two"))
    return frames.mean_correlation(a, b, ["project", "hour"], ["one", "two"]).select(r6("corr"))


@query(f"WITH {SERIES_SQL}, {GRID_SQL}, m AS (SELECT hour, avg(u) AS mean, quantile_cont(u, 0.1) AS p10, quantile_cont(u, 0.9) AS p90 FROM grid GROUP BY 1) SELECT m.hour, round(m.mean, 5) AS mean, round(m.p10, 5) AS p10, round(m.p90, 5) AS p90, round(p.mean, 5) AS prev, round(n.mean, 5) AS next FROM m LEFT JOIN m p ON p.hour = m.hour - 1 LEFT JOIN m n ON n.hour = m.hour + 1")
def area_steps(spark, sf):
    g = cells(spark, sf).withColumn("area", F.lit("all"))
    return weather.step_means(g, ["area"], "hour", "u").select("hour", *[r6(c, 5) for c in ("mean", "p10", "p90", "prev", "next")])


@query(f"WITH {SERIES_SQL}, {GRID_SQL} SELECT hour // 24 + 1 AS day, round(avg(u), 7) AS u, round(avg(v), 7) AS v, round(max(u), 7) AS temp_max, round(min(u), 7) AS temp_min FROM grid GROUP BY 1")
def daily_weather(spark, sf):
    return weather.daily(cells(spark, sf), "hour", ["u", "v"], "u").select("day", *[r6(c, 7) for c in ("u", "v", "temp_max", "temp_min")])


@query(f"WITH {PRED_SQL} SELECT project, method, round(sqrt(avg(pow(y_hat - y, 2))), 6) AS rms, round(avg(abs(y_hat - y)), 6) AS mae FROM pred GROUP BY 1, 2")
def metrics_of_scaled(spark, sf):
    return metrics.scaled_errors(predictions(spark, sf), ["project", "method"], rated=True).select("project", "method", r6("rms"), r6("mae"))


@query(f"WITH {WIDE_SQL} SELECT project, hour, round(list_avg(list_filter([lag24, lag48], lambda x: x IS NOT NULL)), 4) AS wind, round(lag168, 4) AS p_wind FROM wide")
def rolled_up(spark, sf):
    """Means over areas; earlier hours keep their own column."""
    w = wide(spark, sf).withColumnsRenamed({"lag24": "wind_a.0", "lag48": "wind_b.0", "lag168": "p_wind_a.0"}).toDF("project", "hour", "y", "wind_a0", "wind_b0", "p_wind_a0")
    return weather.rolled_up(w, {"wind": ["wind_a0", "wind_b0"], "p_wind": ["p_wind_a0"]}).select("project", "hour", r6("wind", 4), r6("p_wind", 4))


@query(f"WITH {V_SQL}, p AS (SELECT a.label, avg(list_distance(a.f, b.f)) AS mean FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id GROUP BY 1), n AS (SELECT label, count(*) AS n FROM v GROUP BY 1) SELECT label AS cell, n, round(pow(mean, 0.16 * pow(ln(n) / ln(1.6), 1.8)) / n, 4) AS sparsity FROM p JOIN n USING (label)")
def cluster_sparsity(spark, sf):
    return oversample.sparsity(vec(spark, sf).select(F.col("label").alias("cell"), "id", "features")).select("cell", "n", r6("sparsity", 4))


@query(f"WITH {DAILY_SQL}, l AS (SELECT DISTINCT CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS day FROM lineitem) SELECT day FROM daily INTERSECT SELECT day FROM l")
def common_days(spark, sf):
    """Days that both tables have."""
    ship = T.read(spark, sf, "lineitem").select(T.day_number("l_shipdate").cast("long").alias("day"))
    return daily(spark, sf).select("day").intersect(ship)


@query(f"""WITH {DAILY_SQL}, r AS (SELECT day, y, row_number() OVER (ORDER BY day) AS r, count(*) OVER () AS n FROM daily), k AS (SELECT unnest([-2, -1, 0, 1, 2]) AS k),
p AS (SELECT r.day, k, CASE WHEN r + k < 1 THEN 2 - (r + k) WHEN r + k > n THEN 2 * n - (r + k) ELSE r + k END AS at FROM r, k) SELECT p.day, round(sum(q.y * (0.5 + 0.5 * cos(pi() * k / 3))) / sum(0.5 + 0.5 * cos(pi() * k / 3)), 4) AS smooth FROM p JOIN r q ON q.r = p.at GROUP BY 1""")
def smoothed(spark, sf):
    return series.smooth(daily(spark, sf), "day", "y", 2).select("day", r6("smooth", 4))


@query(f"""WITH {SCORES_SQL}, t AS (SELECT project, method, mae, row_number() OVER w AS rank, min(mae) OVER (PARTITION BY project) AS best FROM scores WINDOW w AS (PARTITION BY project ORDER BY mae, method)),
k AS (SELECT project, list(method ORDER BY rank) AS m FROM t WHERE rank <= 4 AND mae - best <= 1.0 GROUP BY 1) SELECT project, unnest([1, 2, 3, 4]) AS slot, unnest([coalesce(m[i], m[1]) FOR i IN [1, 2, 3, 4]]) AS method FROM k""")
def padded_methods(spark, sf):
    return frames.padded_top(scores(spark, sf), ["project"], "mae", "method", 4, 1.0).select("project", "slot", "method")


@query(f"""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY {_draw('o_orderkey', seed=0)}, o_orderkey) AS r, count(*) OVER () AS n FROM orders), d AS (SELECT floor({_draw('i', seed=1)} * (SELECT count(*) FROM orders)) + 1 AS r FROM range(500) t(i)) SELECT o_orderkey FROM d JOIN o USING (r)""")
def drawn_with_replacement(spark, sf):
    """500 draws, the operator's own number."""
    return frames.sampled_with_replacement(T.read(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 500)


@query(f"""WITH {SERIES_SQL}, {GRID_SQL}, n AS (SELECT DISTINCT hour FROM grid), t AS (SELECT hour, i, j, i * 4.0 / 2 AS y, j * 4.0 / 2 AS x FROM n, range(3) a(i), range(3) b(j)), c AS (SELECT *, least(floor(y), 3) AS y0, least(floor(x), 3) AS x0 FROM t),
w AS (SELECT hour, i, j, y0 + dy AS i0, x0 + dx AS j0, (CASE WHEN dy = 0 THEN 1 - (y - y0) ELSE y - y0 END) * (CASE WHEN dx = 0 THEN 1 - (x - x0) ELSE x - x0 END) AS w FROM c, range(2) p(dy), range(2) q(dx)) SELECT w.hour, w.i, w.j, round(sum(w * u), 5) AS u FROM w JOIN grid g ON g.hour = w.hour AND g.i = i0 AND g.j = j0 GROUP BY 1, 2, 3""")
def resized_grid(spark, sf):
    return weather.resized(cells(spark, sf), ["hour"], "u", 3, 3).select("hour", F.col("i").cast("long"), F.col("j").cast("long"), r6("u", 5))


def _easter_sql() -> str:
    """CTE `e` (y, west, east) of Easter Sundays of the years of the daily series."""
    return """ys AS (SELECT DISTINCT CAST(year(DATE '1970-01-01' + CAST(day AS INTEGER)) AS BIGINT) AS y FROM daily),
s1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM ys), s2 AS (SELECT *, (19 * a + b - b // 4 - (8 * b + 13) // 25 + 15) % 30 AS h FROM s1), s3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS r FROM s2), s4 AS (SELECT *, (a + 11 * h + 19 * r) // 433 AS m FROM s3), s5 AS (SELECT *, (h + r - 7 * m + 90) // 25 AS mon FROM s4),
j1 AS (SELECT y, (19 * (y % 19) + 15) % 30 AS d FROM ys), j2 AS (SELECT y, d, (2 * (y % 4) + 4 * (y % 7) - d + 34) % 7 AS f FROM j1),
e AS (SELECT s5.y, make_date(s5.y, mon, (h + r - 7 * m + 33 * mon + 19) % 32) AS west, make_date(j2.y, (d + f + 114) // 31, (d + f + 114) % 31 + 1) + 13 AS east FROM s5 JOIN j2 ON j2.y = s5.y)"""


def _holiday_sql(region: str) -> str:
    r = C.REGIONS[region]
    away = f"date_diff('day', CAST({'east' if r['orthodox'] else 'west'} AS DATE), dt)"
    out = f"{away} IN ({', '.join(map(str, r['easter']))}) OR (month(dt), day(dt)) IN ({', '.join(map(str, r['fixed']))})"
    return out + (f" OR ({away} IN {C.ISLAND_MORE} AND year(dt) NOT IN {C.ISLAND_NOT_IN})" if region == "island" else "")


@query(f"""WITH {DAILY_SQL}, {_easter_sql()}, d AS (SELECT day, DATE '1970-01-01' + CAST(day AS INTEGER) AS dt FROM daily)
SELECT d.day, CASE WHEN {_holiday_sql('island')} THEN 100 WHEN (d.day + 3) % 7 = 6 THEN 50 ELSE 0 END AS island, CASE WHEN {_holiday_sql('mainland')} THEN 100 WHEN (d.day + 3) % 7 = 6 THEN 50 ELSE 0 END AS mainland FROM d JOIN e ON e.y = year(dt)""".replace(", day(dt)) IN", ", day(dt)) IN"))
def holiday_calendars(spark, sf):
    date = S.date_of_day(F.col("day"))
    return daily(spark, sf).select("day", C.special_index(date, "island").alias("island"), C.special_index(date, "mainland").alias("mainland"))


@query(f"WITH {SERIES_SQL}, h AS (SELECT DISTINCT hour FROM series) SELECT hour, strftime(TIMESTAMP '1970-01-01' + to_hours(hour), '%d%m%y%H%M') AS key FROM h")
def hour_keys(spark, sf):
    """Hours as the keys of weather files, by way of a timestamp without zone."""
    ts = F.expr(f"timestampadd(HOUR, hour, {T.EPOCH})")
    return hourly(spark, sf).select("hour").distinct().select("hour", C.hour_key(ts).alias("key"))


_SUN = "radians(357.529 + 0.98560028 * d)"


@query(f"""WITH {SERIES_SQL}, h AS (SELECT DISTINCT hour, hour / 24.0 - 10957.5 AS d FROM series), a AS (SELECT hour, CAST(d AS DOUBLE) AS d FROM h), b AS (SELECT hour, radians(280.459 + 0.98564736 * d + 1.915 * sin({_SUN}) + 0.020 * sin(2 * {_SUN})) AS l, radians(23.439 - 0.00000036 * d) AS t, (18.697374558 + 24.06570982441908 * d) AS g FROM a),
c AS (SELECT hour, atan2(cos(t) * sin(l), cos(l)) AS ra, asin(sin(t) * sin(l)) AS up, g - floor(g / 24) * 24 AS s FROM b) SELECT hour, round(degrees(acos(sin(radians(38.0)) * sin(up) + cos(radians(38.0)) * cos(up) * cos(radians(s * 15 + 23.7) - ra))), 3) AS zenith FROM c""")
def solar_zenith(spark, sf):
    return hourly(spark, sf).select("hour").distinct().select("hour", F.round(C.solar_zenith(F.col("hour"), F.lit(38.0), F.lit(23.7)), 3).alias("zenith"))


@query(f"""WITH {DAILY_SQL}, d AS (SELECT day, y / 10000000 AS t, month(DATE '1970-01-01' + CAST(day AS INTEGER)) AS m, CASE WHEN (day + 3) % 7 = 6 THEN 50 ELSE 0 END AS sp FROM daily) SELECT day, round(pow(m * t / 12, 3), 6) AS month_temp, round(pow(sp * t / 100, 3), 6) AS special_temp FROM d""")
def temperature_terms(spark, sf):
    date = S.date_of_day(F.col("day"))
    a, b = S.temperature_interactions(F.month(date), F.when(S.weekday_of_day(F.col("day")) == 6, 50).otherwise(0), F.col("y") / 10000000)
    return daily(spark, sf).select("day", F.round(a, 6).alias("month_temp"), F.round(b, 6).alias("special_temp"))


@query(f"WITH {V_SQL} SELECT id, round(exp(-pow(list_distance(f[1:3], [0.1, -0.1, 0.0]) * 0.5, 2)), 6) AS whole, round(exp(-pow((f[1] - 0.1) * 0.5, 2)), 6) AS first FROM v")
def rbf_values(spark, sf):
    x = F.slice("features", 1, 3)
    return vec(spark, sf).select("id", F.round(S.rbf(x, [0.1, -0.1, 0.0], 0.5), 6).alias("whole"), F.round(S.rbf_map(x, [0.1, -0.1, 0.0], [0.5, 0.5, 0.5])[0], 6).alias("first"))


@query(f"WITH {PRED_SQL} SELECT project, method, round(avg(greatest(0.9 * (y - y_hat), -0.1 * (y - y_hat))), 4) AS pinball, round(avg((CASE WHEN y >= y_hat THEN 0.9 ELSE 0.1 END) * (sqrt(1 + pow(y - y_hat, 2)) - 1)), 4) AS smooth FROM pred GROUP BY 1, 2")
def quantile_losses(spark, sf):
    y, e = F.col("y"), F.col("y_hat")
    return predictions(spark, sf).groupBy("project", "method").agg(F.round(F.avg(S.pinball(y, e, 0.9)), 4).alias("pinball"), F.round(F.avg(S.quantile_loss(y, e, 0.9)), 4).alias("smooth"))


@query("WITH m AS (SELECT min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem) SELECT l_orderkey, l_linenumber, round((l_quantity - lo) / (hi - lo), 6) AS scaled, round(l_quantity, 6) AS back FROM lineitem, m")
def scale_and_back(spark, sf):
    """Scaled by saved statistics, and back."""
    rows = T.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    stats = features.scale_stats(rows, ["l_quantity"])
    scaled = features.apply_scale(rows, stats, ["l_quantity"]).withColumn("scaled", F.col("l_quantity"))
    return features.inverse_scaled(scaled, stats, ["l_quantity"]).select("l_orderkey", "l_linenumber", r6("scaled"), F.round("l_quantity", 6).alias("back"))


@query("SELECT o_orderkey, round(ln(o_totalprice) / ln(10), 6) AS log, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS category, round((o_totalprice - 100) / 900, 6) AS unit FROM orders")
def encodings(spark, sf):
    p = F.col("o_totalprice")
    return T.read(spark, sf, "orders").select("o_orderkey", F.round(S.encoded(p, "log", base=10), 6).alias("log"), S.encoded(F.col("o_orderstatus"), "category", values=["F", "O", "P"]).cast("int").alias("category"), F.round(S.encoded(p, "unit", low=100, high=1000), 6).alias("unit"))


@query("SELECT n_nationkey, (SELECT n FROM (SELECT unnest(['ARGENTINA', 'FRANCE', 'INDIA', 'JAPAN']) AS n) ORDER BY levenshtein(lower(n_name), lower(n)), n LIMIT 1) AS closest FROM nation")
def closest_names(spark, sf):
    return T.read(spark, sf, "nation").select("n_nationkey", S.closest_name(F.col("n_name"), ["ARGENTINA", "FRANCE", "INDIA", "JAPAN"]).alias("closest"))


@query(f"WITH {SERIES_SQL}, d AS (SELECT project, hour, y, {_draw('project', 'hour', seed=0)} AS u, {_draw('project', 'hour', seed=1)} AS v FROM series) SELECT project, hour, round(y + 0.05 * (sqrt(-2 * ln(1 - u)) * cos(2 * 3.141592653589793 * v)) * y, 4) AS y FROM d")
def noisy_lags(spark, sf):
    """Relative normal noise, drawn from the keys."""
    return hourly(spark, sf).select("project", "hour", F.round(S.noisy(F.col("y"), F.col("project"), F.col("hour")), 4).alias("y"))


@query(f"WITH {PRED_SQL}, s AS (SELECT project, method, avg(pow(y - y_hat, 2)) AS s, stddev_pop(y - y_hat) AS sd, count(*) AS c FROM pred GROUP BY 1, 2), l AS (SELECT project, method, -s * max(c) OVER (PARTITION BY project) / nullif(2 * pi() * sd * sd, 0) AS l FROM s), e AS (SELECT project, method, coalesce(exp(l - max(l) OVER (PARTITION BY project)), 0) AS e FROM l) SELECT project, method, round(e / nullif(sum(e) OVER (PARTITION BY project), 0), 6) AS weight FROM e")
def bcp_masked(spark, sf):
    return combine.bcp_masked(predictions(spark, sf), ["project"]).select("project", "method", r6("weight"))


@query(f"WITH {BCP_SQL} SELECT project, hour, round(greatest(0, avg(y_hat)), 4) AS average, round(greatest(0, sum(y_hat * weight) / nullif(sum(weight), 0)), 3) AS bcp FROM pred JOIN w USING (project, method) GROUP BY 1, 2")
def project_forecasts(spark, sf):
    p = predictions(spark, sf)
    return combine.project_forecasts(p, combine.bcp_weights(p, ["project"]), ["project", "hour"], ["project", "method"]).select("project", "hour", r6("average", 4), r6("bcp", 3))


@query(f"WITH {XS_SQL}, {ACT_SQL}, a AS (SELECT project, hour, rule, count(*) OVER (PARTITION BY project, hour) AS n FROM act WHERE act >= 0.6) SELECT rule, CAST(count(*) FILTER (n = 1) AS BIGINT) AS alone, count(*) AS rows, count(*) FILTER (n = 1) = 0 AS removable FROM a GROUP BY 1")
def covering_rules(spark, sf):
    parts = rules.partitioned(xs(spark, sf), rules.rule_base({"x": _GAUSS}), 0.6).withColumn("key", F.struct("project", "hour"))
    return rules.covering(parts, "key", "rule")


@query(f"WITH {XS_SQL}, {ACT_SQL}, m AS (SELECT project, hour, max(act) AS top FROM act GROUP BY 1, 2) SELECT project, hour, rule, round(CASE WHEN top >= 0.9 THEN act ELSE 0.1 END, 6) AS act FROM act JOIN m USING (project, hour) WHERE act >= 0.9 OR (top < 0.9 AND act = top) QUALIFY top >= 0.9 OR row_number() OVER (PARTITION BY project, hour ORDER BY act DESC, rule DESC) = 1")
def rescued_rows(spark, sf):
    """Rows without an active rule go to their nearest one."""
    return rules.rescued(xs(spark, sf), rules.rule_base({"x": _GAUSS}), threshold=0.9).select("project", "hour", "rule", r6("act"))


def _horizon_sql() -> str:
    acts = []
    for k, p in enumerate(evolve.HORIZONS):
        a, b, c, d = p
        trap = f"CASE WHEN h < {a} OR h > {d} THEN 0 WHEN h >= {b} AND h <= {c} THEN 1 WHEN h < {b} THEN (h - {a}) / ({b} - {a}) ELSE ({d} - h) / ({d} - {c}) END"
        acts.append(f"SELECT {k} AS k, h, CAST({trap} AS DOUBLE) AS m FROM hs")
    return " UNION ALL ".join(acts)


@query(f"WITH {SERIES_SQL}, hs AS (SELECT project, hour, CAST(hour - start AS DOUBLE) AS h FROM series, (SELECT max(hour) - 48 AS start FROM series) WHERE hour > start), k AS (SELECT DISTINCT h FROM hs), m AS ({_horizon_sql().replace('FROM hs', 'FROM k')}) SELECT project, hour, 'rule.' || k AS rule, round(pow(m, 0.5), 6) AS act FROM hs JOIN m USING (h) WHERE pow(m, 0.5) >= 0.01")
def horizon_rules(spark, sf):
    """Which horizon rules each of the sites' last 48 hours activates, as hours of a forecast."""
    s = hourly(spark, sf)
    start = s.agg(F.max("hour")).collect()[0][0] - 48
    hours = s.filter(F.col("hour") > start).select("project", "hour", (F.col("hour") - start).cast("double").alias("horizon"))
    return rules.partitioned(hours, evolve.with_horizons({"rule.0": []})).select("project", "hour", "rule", r6("act"))


@query(f"WITH {LAGGED_SQL}, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT project, hour FROM lagged WHERE train)), a AS (SELECT rule, count(*) AS c, regr_slope(y, lag24) AS s, regr_intercept(y, lag24) AS i FROM lagged WHERE train GROUP BY 1), g AS (SELECT a.* FROM a, n WHERE c > 20 AND c < 1.1 * n), p AS (SELECT l.project, l.hour, any_value(l.y) AS y, avg(g.i + g.s * l.lag24) AS p FROM lagged l LEFT JOIN g USING (rule) WHERE NOT train GROUP BY 1, 2) SELECT round(sum(pow((coalesce(p, 1e15) - y) / 1000, 2)), 4) AS squares, round(avg(abs((coalesce(p, 1e15) - y) / 1000)), 6) AS mean FROM p")
def rule_objectives(spark, sf):
    """Both costs of a rule base whose rules need more than 20 rows; none has too many here."""
    return _base_problem(spark, sf, 20, 1.1).costs([rulebase.start_of(rules.rule_base({"x": _GAUSS}))]).select(F.round("squares", 4).alias("squares"), F.round("mean", 6).alias("mean"))


def _base_problem(spark, sf, least, share):
    rows = lagged(spark, sf).select("project", "hour", "y", "lag24", "x", "train").distinct()
    return rulebase.Problem(rows.filter("train"), rows.filter("NOT train"), rules.rule_base({"x": _GAUSS}), ["lag24"], "y", 1000.0, least, share)


#: A generation: functions of which two reach far, narrow ones, and ones of which one is active nowhere.
_POPULATION = [[0.0, 0.1, 0.5, 0.14, 1.0, 0.2], [0.1, 0.12, 0.5, -0.1, 0.9, 0.12], [0.2, 0.1, 0.8, 0.15, 9.0, 0.01]]
_POPULATION_SQL = ", ".join(f"({i}, 'rule.{k}', {p[2 * k]}, {abs(p[2 * k + 1])})" for i, p in enumerate(_POPULATION) for k in range(3))


@query(f"WITH {LAGGED_SQL}, r AS (SELECT DISTINCT project, hour, y, lag24, x, train FROM lagged JOIN xs USING (project, hour, y)), n AS (SELECT count(*) AS n FROM r WHERE train), pop(individual, rule, m, s) AS (VALUES {_POPULATION_SQL}), active AS (SELECT * FROM r, pop WHERE sqrt(exp(-pow(x - m, 2) / (2 * s * s))) >= 0.01), a AS (SELECT individual, rule, count(*) AS c, regr_slope(y, lag24) AS b, regr_intercept(y, lag24) AS i FROM active WHERE train GROUP BY 1, 2), g AS (SELECT a.* FROM a, n WHERE c > 20 AND c < 0.9 * n), k AS (SELECT t.individual, count(g.rule) AS rules FROM (SELECT DISTINCT individual FROM pop) t LEFT JOIN g USING (individual) GROUP BY 1), p AS (SELECT k.individual, k.rules, r.project, r.hour, any_value(r.y) AS y, avg(g.i + g.b * r.lag24) AS p FROM r CROSS JOIN k LEFT JOIN active v ON v.individual = k.individual AND v.project = r.project AND v.hour = r.hour LEFT JOIN g ON g.individual = v.individual AND g.rule = v.rule WHERE NOT r.train GROUP BY 1, 2, 3, 4) SELECT individual, rules, round(sum(pow((coalesce(p, 1e15) - y) / 1000, 2)), 4) AS squares, round(avg(abs((coalesce(p, 1e15) - y) / 1000)), 6) AS mean FROM p GROUP BY 1, 2")
def generation_costs(spark, sf):
    """Both costs of every individual of a generation of rule bases, by one pass over the training and one over the test rows."""
    return _base_problem(spark, sf, 20, 0.9).costs(_POPULATION).select("individual", F.col("rules").cast("long").alias("rules"), F.round("squares", 4).alias("squares"), F.round("mean", 6).alias("mean"))


_PAIR = f"{V_SQL}, p AS (SELECT a.id, a.f AS x, b.f AS y FROM v a JOIN v b ON b.id = 0 WHERE a.id <> 0)"


@query(f"WITH {_PAIR} SELECT id, round(list_sum(list_transform(range(1, 65), lambda i: abs(x[i] - y[i]) / (abs(x[i]) + abs(y[i])))), 5) AS canberra, round(1 - list_cosine_similarity(x, y), 5) AS cosine, round(1 - list_cosine_similarity(list_transform(x, lambda q: q - list_avg(x)), list_transform(y, lambda q: q - list_avg(y))), 5) AS correlation FROM p")
def distances(spark, sf):
    """Three distances of every vector to one of them."""
    v = vec(spark, sf)
    one = v.filter("id = 0").select(F.col("features").alias("y"))
    x, y = F.col("features"), F.col("y")
    rows = v.filter("id <> 0").crossJoin(F.broadcast(one))  # one row
    return rows.select("id", F.round(cluster.canberra(x, y), 5).alias("canberra"), F.round(cluster.cosine_distance(x, y), 5).alias("cosine"), F.round(cluster.correlation_distance(x, y), 5).alias("correlation"))


_THREE = f"{V_SQL}, cs AS (SELECT CAST(row_number() OVER (ORDER BY id) - 1 AS INTEGER) AS c, f AS centre FROM v WHERE id IN (0, 1, 2)), d AS (SELECT v.id, v.f, cs.c, greatest(pow(list_distance(v.f, cs.centre), 2), 1e-12) AS d2 FROM v, cs)"


def _step(spark, sf, kind):
    centres = [r.centre for r in first_centres(spark, sf).orderBy("c").collect()]
    return alternating.step(vec(spark, sf).select("id", "features"), alternating.State(kind, np.array(centres)))


def _listed(spark, state):
    rows = [(c, d, float(x)) for c, centre in enumerate(state.centres) for d, x in enumerate(centre)]
    return spark.createDataFrame(rows, "c int, dim int, value double").select("c", "dim", r6("value", 5))


@query(f"WITH {_THREE}, h AS (SELECT id, f, c FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d2, c) = 1), e AS (SELECT c, unnest(f) AS x, generate_subscripts(f, 1) - 1 AS dim FROM h) SELECT c, CAST(dim AS INTEGER) AS dim, round(avg(x), 5) AS value FROM e GROUP BY 1, 2")
def hard_step(spark, sf):
    """Centres after one round of hard clustering."""
    return _listed(spark, _step(spark, sf, "hard"))


@query(f"WITH {_THREE}, u AS (SELECT id, f, c, (1 / d2) / sum(1 / d2) OVER (PARTITION BY id) AS u FROM d), e AS (SELECT c, u * u AS w, unnest(f) AS x, generate_subscripts(f, 1) - 1 AS dim FROM u) SELECT c, CAST(dim AS INTEGER) AS dim, round(sum(w * x) / sum(w), 5) AS value FROM e GROUP BY 1, 2")
def probabilistic_step(spark, sf):
    return _listed(spark, _step(spark, sf, "probabilistic"))


@query(f"WITH {NEAR_SQL}, q AS (SELECT id, count(*) FILTER (other_label <> 1) AS f, count(*) AS m FROM near WHERE label = 1 AND rank <= 10 GROUP BY 1), w AS (SELECT v.* FROM v JOIN q USING (id) WHERE 2 * q.f >= m AND q.f < m), " + _smote_sql("SELECT 1 AS label, count(*) + 40 AS target FROM w").replace("FROM v) o", "FROM w) o").replace("JOIN v b ON a.label = b.label", "JOIN v b ON a.label = b.label") + f" {_MADE}")
def borderline_smote(spark, sf):
    """Forty rows of one class from its rows in danger."""
    return _rounded(resample.borderline_smote(vec(spark, sf), 1, 40))


@query("""WITH v AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS f FROM embeddings), d AS (SELECT a.id, a.label, list_distance(a.f, b.f) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f) DESC, b.id DESC) AS r FROM v a JOIN v b ON a.label <> 0 AND b.label = 0),
s AS (SELECT id, label, avg(dist) AS d FROM d WHERE r <= 3 GROUP BY 1, 2) SELECT id FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY d, id) <= (SELECT count(*) FROM v WHERE label = 0) UNION ALL SELECT id FROM v WHERE label = 0""")
def nearmiss2(spark, sf):
    return resample.near_miss(vec(spark, sf), 0, version=2).select("id")


@query("""WITH v AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS label, CAST(embedding AS DOUBLE[]) AS f FROM embeddings), c AS (SELECT DISTINCT other FROM (SELECT b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f), b.id) AS r FROM v a JOIN v b ON a.label = 0 AND b.label <> 0) WHERE r <= 3),
d AS (SELECT a.id, a.label, list_distance(a.f, b.f) AS dist, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f), b.id) AS r FROM v a JOIN v b ON a.label <> 0 AND b.label = 0 WHERE a.id IN (SELECT other FROM c)),
s AS (SELECT id, label, avg(dist) AS d FROM d WHERE r <= 3 GROUP BY 1, 2) SELECT id FROM s QUALIFY row_number() OVER (PARTITION BY label ORDER BY d DESC, id) <= (SELECT count(*) FROM v WHERE label = 0) UNION ALL SELECT id FROM v WHERE label = 0""")
def nearmiss3(spark, sf):
    return resample.near_miss(vec(spark, sf), 0, version=3).select("id")


@query(f"WITH {SERIES_SQL}, {GRID_SQL} SELECT hour, i, j, round(greatest(0, least(1, u / 4)), 5) AS rbf, round(greatest(0, u - 3.2), 5) AS other FROM grid")
def clamped(spark, sf):
    """Radial-basis forecasts stay between 0 and 1, others above 0."""
    u = F.col("u")
    return cells(spark, sf).select("hour", F.col("i").cast("long"), F.col("j").cast("long"), F.round(S.clamped(u / 4, "RBF_OLS"), 5).alias("rbf"), F.round(S.clamped(u - 3.2, "MLP"), 5).alias("other"))


@query(f"WITH {SERIES_SQL}, {GRID_SQL}, g AS (SELECT hour, CASE WHEN hour % 5 = 0 THEN NULL ELSE u END AS u, v FROM grid), h AS (SELECT DISTINCT hour FROM g WHERE u IS NOT NULL) SELECT hour, count(*) AS n FROM g WHERE hour IN (SELECT hour FROM h) OR hour - 1 IN (SELECT hour FROM h) OR hour + 1 IN (SELECT hour FROM h) GROUP BY 1")
def hours_with_weather(spark, sf):
    """Hours of which the one before, the one itself or the one after has all variables."""
    g = cells(spark, sf).withColumn("u", F.when(F.col("hour") % 5 != 0, F.col("u")))
    return weather.with_all_steps(g, "hour", ["u", "v"]).groupBy("hour").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SERIES_SQL}, {GRID_SQL} SELECT hour, i, j, round(40 + i * 0.5, 4) AS lat, round(20 + j * 0.5, 4) AS lon, round(sqrt(u * u + v * v), 5) AS ws FROM grid")
def repaired_weather(spark, sf):
    """Cells without coordinates and speeds get both."""
    g = cells(spark, sf).select("hour", "i", "j", F.col("u").alias("Uwind"), F.col("v").alias("Vwind"))
    return weather.repaired(g, (40.0, 20.0), 0.5).select("hour", F.col("i").cast("long"), F.col("j").cast("long"), F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), F.round("WS", 5).alias("ws"))


@query(f"WITH {SERIES_SQL}, t AS (SELECT project FROM series GROUP BY 1 HAVING avg(y) > (SELECT avg(y) FROM series)) SELECT s.project, s.hour FROM series s WHERE s.project IN (SELECT project FROM t)")
def in_groups(spark, sf):
    """Rows of the sites of one group: those above the mean."""
    s = hourly(spark, sf)
    over = s.groupBy("project").agg(F.avg("y").alias("m")).crossJoin(F.broadcast(s.agg(F.avg("y").alias("all")))).filter("m > `all`")  # one row
    return frames.in_groups(s, over).select("project", "hour")


@query(f"WITH {PRED_SQL}, e AS (SELECT project, method, avg(abs(y - y_hat)) FILTER (hour % 2 = 0) AS a, avg(abs(y - y_hat)) FILTER (hour % 2 = 1) AS b FROM pred GROUP BY 1, 2) SELECT project, method, round(0.4 * a + 0.6 * b, 4) AS cost FROM e")
def weighted_objective(spark, sf):
    """0.4 of the error on even hours (validation) and 0.6 of that on odd ones (test)."""
    e = F.abs(F.col("y") - F.col("y_hat"))
    parts = predictions(spark, sf).groupBy("project", "method").agg(F.avg(F.when(F.col("hour") % 2 == 0, e)).alias("a"), F.avg(F.when(F.col("hour") % 2 == 1, e)).alias("b"))
    return parts.select("project", "method", F.round(frames.objective(F.col("a"), F.col("b")), 4).alias("cost"))


@query(f"WITH {SERIES_SQL}, {GRID_SQL}, t AS (SELECT hour, avg(y) AS y FROM series GROUP BY 1), c AS (SELECT i, j, corr(u, y) AS corr FROM grid JOIN t USING (hour) GROUP BY 1, 2) SELECT i, j, round(corr, 6) AS corr FROM c ORDER BY round(corr, 9) DESC, i, j LIMIT 1")
def best_grid_cell(spark, sf):
    """The cell whose wind goes best with the sites' mean: a report of one row."""
    target = hourly(spark, sf).groupBy("hour").agg(F.avg("y").alias("y"))
    return grid.best_cell(cells(spark, sf), target, "hour", "u", "y").select(F.col("i").cast("long"), F.col("j").cast("long"), r6("corr"))


@query(f"WITH {PRED_SQL}, a AS (SELECT project, hour, avg(y_hat) AS y_hat FROM pred GROUP BY 1, 2), b AS (SELECT project, hour, y_hat FROM pred WHERE method = 'lag24') SELECT project, hour, round(avg(y_hat), 4) AS y_hat FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2")
def blended(spark, sf):
    """Two combinations' mean."""
    p = predictions(spark, sf)
    return combine.blended([combine.average(p, ["project", "hour"]), p.filter("method = 'lag24'")], ["project", "hour"]).select("project", "hour", r6("y_hat", 4))


def _hourly_lags(name: str, lags: list[int]) -> None:
    def run(spark, sf):
        out = series.lag_vector(hourly(spark, sf), "hour", lags, keys=("project",), complete=False, prefix="load")
        return out.select("project", "hour", r6("y", 4), *[r6(f"load_{i}", 4) for i in range(len(lags))])

    run.__name__ = name
    query(_lags_sql(lags))(run)


def _daily_lags(name: str, lags: list[int]) -> None:
    cols = ", ".join(f"round(l{i}.y, 2) AS lag_{i}" for i in range(len(lags)))
    joins = " ".join(f"LEFT JOIN daily l{i} ON l{i}.day = s.day - {lag}" for i, lag in enumerate(lags))

    def run(spark, sf):
        out = series.lag_vector(daily(spark, sf), "day", lags, complete=False)
        return out.select("day", r6("y", 2), *[r6(f"lag_{i}", 2) for i in range(len(lags))])

    run.__name__ = name
    query(f"WITH {DAILY_SQL} SELECT s.day, round(s.y, 2) AS y, {cols} FROM daily s {joins}")(run)


_hourly_lags("load_year_back_lags", series.LOAD_YEAR_BACK)
_hourly_lags("lv_load_lags", series.LV_LOAD)
_hourly_lags("scada_load_lags", series.SCADA_LOAD)
_daily_lags("gas_weather_lags", series.GAS_WEATHER)
_daily_lags("gas_day_ahead_lags", [*series.GAS_DAY_AHEAD, *series.GAS_YEAR_BACK])


@query(f"WITH RECURSIVE {SERIES_SQL}, cut AS (SELECT max(hour) - 240 AS start FROM series), w AS (SELECT project, list(y ORDER BY hour) AS h FROM (SELECT p.project, t.hour, s.y FROM (SELECT DISTINCT project FROM series, cut WHERE hour <= start AND hour > start - 24) p CROSS JOIN (SELECT unnest(range(start - 23, start + 1)) AS hour FROM cut) t LEFT JOIN series s ON s.project = p.project AND s.hour = t.hour) GROUP BY 1), r AS (SELECT project, 0 AS step, h FROM w UNION ALL SELECT project, step + 1, list_append(h, 5 + 0.6 * h[-1] + 0.3 * h[-24]) FROM r WHERE step < 240) SELECT project, start + step AS hour, round(h[-1], 4) AS y_hat FROM r, cut WHERE step > 0")
def recursive_horizon(spark, sf):
    """Forecasts of 240 hours from lags of 1 and 24 hours, each fed back as later ones' lags, in one projection."""
    s = hourly(spark, sf)
    start = s.agg(F.max("hour")).collect()[0][0] - 240
    return stateful.feedback(s, ["project"], "hour", "y", [1, 24], 240, "5 + 0.6 * lag_0 + 0.3 * lag_1", start).select("project", "hour", r6("y_hat", 4))


#: The recursion of two methods, a row a step: errors, their tail probability, the factor, gain, weights and covariance.
_RLS_STEPS = """SELECT *, y - a * w1 - b * w2 AS e, a * p11 + b * p12 AS pa, a * p12 + b * p22 AS pb, CASE WHEN n > 0 THEN sq / n ELSE 1.0 END AS var FROM (SELECT s.*, t.y, t.a, t.b FROM s JOIN t ON t.project = s.project AND t.r = s.r + 1)"""
_RLS_SQL = f"""t AS MATERIALIZED (SELECT project, row_number() OVER (PARTITION BY project ORDER BY pass, hour) AS r, y, lag24 AS a, lag168 AS b FROM wide, (SELECT unnest([1, 2, 3]) AS pass) WHERE lag24 IS NOT NULL AND lag168 IS NOT NULL),
s AS (SELECT DISTINCT project, CAST(0 AS BIGINT) AS r, 0.5::DOUBLE AS w1, 0.5::DOUBLE AS w2, 1e-4::DOUBLE AS p11, 0.0::DOUBLE AS p12, 1e-4::DOUBLE AS p22, CAST(0 AS BIGINT) AS n, 0.0::DOUBLE AS mean, 0.0::DOUBLE AS sq, 0.0::DOUBLE AS tails FROM t UNION ALL
SELECT project, r + 1, CASE WHEN v1 + v2 > 0 THEN v1 / (v1 + v2) ELSE 0.5 END, CASE WHEN v1 + v2 > 0 THEN v2 / (v1 + v2) ELSE 0.5 END, (p11 - g1 * pa) / f, (p12 - g1 * pb) / f, (p22 - g2 * pb) / f, n + 1, mean + (e - mean) / (n + 1), sq + (e - mean) * (e - mean - (e - mean) / (n + 1)), tails2
FROM (SELECT *, greatest(w1 + g1 * e, 0) AS v1, greatest(w2 + g2 * e, 0) AS v2 FROM (SELECT *, pa / (f + spread) AS g1, pb / (f + spread) AS g2 FROM (SELECT *, 0.75 + 0.249 * tails2 / (n + 1) AS f FROM (SELECT *, a * pa + b * pb AS spread, tails + CASE WHEN var > 0 THEN exp(-e * e * (a * pa + b * pb) / (var * (1 + a * pa + b * pb)) / 2) ELSE 0 END AS tails2 FROM ({_RLS_STEPS}))))))"""


@query(f"WITH RECURSIVE {WIDE_SQL}, {_RLS_SQL}, l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY project ORDER BY r DESC) = 1) SELECT project, 'lag24' AS method, round(w1, 4) AS weight FROM l UNION ALL SELECT project, 'lag168', round(w2, 4) FROM l")
def recursive_weights(spark, sf):
    """Weights of two methods by least squares with adaptive forgetting, three passes over all rows of each site."""
    rows = wide(spark, sf).select("project", "hour", "y", "lag24", "lag168")
    return recursive.weights(rows, "project", "hour", ["lag24", "lag168"]).select("project", "method", r6("weight", 4))


def _scaled_wide(spark, sf):
    """Each site's series and two lags, scaled to its range."""
    return features.scaled(wide(spark, sf).select("project", "hour", "y", "lag24", "lag168").dropna(), ["y", "lag24", "lag168"], ("project",))


@query()
def rbf_width_sweep(spark, sf):
    """Radial-basis models of every width, for each site, on a part of its rows, and their errors on the rest."""
    out = rbf.swept(_scaled_wide(spark, sf), "project", ["lag24", "lag168"], "y", [0.5, 1.0, 2.0, 4.0, 8.0], candidates=128)
    return out.select("project", "width", "centres", r6("sse", 4), r6("mae", 4), "best")


@query()
def rbf_feature_widths(spark, sf):
    """Widths by feature that an evolutionary search finds for each site: two short generations."""
    found = rbf.searched(_scaled_wide(spark, sf), "project", ["lag24", "lag168"], "y", settings=evolve.Settings(parents=6, children=6, generations=2), candidates=64)
    return found.select("project", "width", F.size("centres").alias("centres"), r6("sse", 4), r6("mae", 4))


@query()
def quantile_network(spark, sf):
    """Each row's forecast and nine quantiles, by a network for each site that all its rows train."""
    rows = _scaled_wide(spark, sf)
    models = networks.fit(rows, "project", ["lag24", "lag168"], "y", hidden=8, rounds=4)
    out = networks.forecast(rows, "project", ["lag24", "lag168"], models)
    return out.select("project", "hour", r6("y_hat", 3), F.transform("q", lambda x: F.round(x, 3)).alias("q"))


@query()
def landmark_components(spark, sf):
    """Two kernel principal components of each site's rows, by landmarks, by size (a component has no sign of its own)."""
    out = machines.components(_scaled_wide(spark, sf).withColumn("id", F.col("hour")), "project", ["lag24", "lag168"], 2.0, most=64)
    return out.select("project", F.col("id").alias("hour"), F.transform("components", lambda x: F.round(F.abs(x), 4)).alias("components"))


@query()
def support_vector_forecasts(spark, sf):
    """Forecasts by support-vector regression on landmark features of all sites' rows."""
    rows = _scaled_wide(spark, sf)
    phi, names = machines.landmark_features(rows, ["lag24", "lag168"], machines.landmarks(rows, ["lag24", "lag168"], 24), 2.0)
    model, _ = machines.support_regression(phi, names, "y", penalty=1.0, epsilon=0.05, rounds=20)
    return phi.select("project", "hour", F.round(model.column(), 3).alias("y_hat"))


_IMAGE = "list_sum(list_transform(range(1, 65), lambda i: (x[i] - y[i]) * list_sum(list_transform(range(1, 65), lambda j: (x[j] - y[j]) * exp(-(pow((i - 1) // 8 - (j - 1) // 8, 2) + pow((i - 1) % 8 - (j - 1) % 8, 2)) / 2)))))"


@query(f"WITH {_PAIR} SELECT id, round({_IMAGE}, 4) AS image FROM p")
def image_distances(spark, sf):
    """Every vector, as an image of 8 by 8, to one of them: near pixels count for one another."""
    v = vec(spark, sf)
    one = v.filter("id = 0").select(F.col("features").alias("y"))
    return v.filter("id <> 0").crossJoin(F.broadcast(one)).select("id", F.round(cluster.image_distance(F.col("features"), F.col("y"), 8, 8), 4).alias("image"))  # one row


_ANY = _smote_sql("SELECT 1 AS label, count(*) + 40 AS target FROM w").replace("FROM v) o", "FROM w) o").replace("JOIN v b ON a.label = b.label AND a.id <> b.id", "JOIN v b ON a.id <> b.id").replace("b.f AS g,", "b.f AS g, b.label AS gl,").replace("c.f, n.g FROM", "c.f, n.g, n.gl FROM").replace("f[i] + ", "f[i] + CASE WHEN gl <> label THEN 0.5 ELSE 1.0 END * ")


@query(f"WITH {NEAR_SQL}, q AS (SELECT id, count(*) FILTER (other_label <> 1) AS f, count(*) AS m FROM near WHERE label = 1 AND rank <= 10 GROUP BY 1), w AS (SELECT v.* FROM v JOIN q USING (id) WHERE 2 * q.f >= m AND q.f < m), {_ANY} {_MADE}")
def borderline_smote_any(spark, sf):
    """Forty rows of one class from its rows in danger, towards neighbours of any class."""
    return _rounded(resample.borderline_smote(vec(spark, sf), 1, 40, kind=2))


_NOMINAL = _smote_sql("SELECT 1 AS label, count(*) + 50 AS target FROM v WHERE label = 1").replace("ORDER BY list_distance(a.f, b.f), b.id", "ORDER BY pow(list_distance(a.f, b.f), 2) + CASE WHEN a.id % 3 <> b.id % 3 THEN (SELECT m * m / 2 FROM med) ELSE 0 END, b.id")


@query(f"WITH {V_SQL}, med AS (SELECT median(sd) AS m FROM (SELECT stddev_pop(x) AS sd FROM (SELECT unnest(f) AS x, generate_subscripts(f, 1) AS i FROM v WHERE label = 1) GROUP BY i)), {_NOMINAL}, k AS (SELECT id, chr(CAST(97 + other % 3 AS INTEGER)) AS kind FROM nn WHERE rank <= 5 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY id ORDER BY count(*) DESC, kind) = 1) SELECT id, copy, label, kind, list_transform(features, lambda x: round(x, 6)) AS features FROM made JOIN k USING (id)")
def smote_nominal(spark, sf):
    """Fifty rows of one class whose rows have a category, too."""
    rows = vec(spark, sf).withColumn("kind", F.char(F.lit(97) + F.col("id") % 3))
    made = oversample.with_categories(rows, 1, 50, ["kind"])
    return made.select("id", "copy", "label", "kind", F.transform("features", lambda x: S.rounded(x, 6)).alias("features"))


@query(f"WITH w AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS f, CAST(embedding[1] AS DOUBLE) AS y FROM embeddings), v AS (SELECT id, CAST(greatest(ceil((y - (SELECT min(y) FROM w)) / (SELECT stddev_pop(y) FROM w)), 0) AS INTEGER) AS label, f, y FROM w), {_smote_sql('SELECT label, max(count(*)) OVER () AS target FROM v GROUP BY label HAVING count(*) > 1')} SELECT made.id, copy, round(y, 6) AS y, list_transform(features, lambda x: round(x, 6)) AS features FROM made JOIN w USING (id)")
def regression_oversampled(spark, sf):
    """Rows for the rarer values of a number, by bins a deviation wide, each filled up to the largest."""
    rows = vec(spark, sf).select("id", "features", F.col("features")[0].alias("y"))
    made = oversample.regression_adasyn(rows, "y")
    return made.select("id", "copy", S.rounded(F.col("y"), 6).alias("y"), F.transform("features", lambda x: S.rounded(x, 6)).alias("features"))


@query(f"WITH {V_SQL}, c AS (SELECT label, list(m ORDER BY i) AS g FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(f) AS x, generate_subscripts(f, 1) AS i FROM v) GROUP BY 1, 2) GROUP BY 1) SELECT id, label FROM v JOIN c USING (label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY list_distance(f, g), id) = 1")
def class_representatives(spark, sf):
    """Of each class, the row nearest to its mean."""
    rows = vec(spark, sf)
    means = rows.select("label", F.posexplode("features").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("features"))
    return oversample.nearest_representatives(rows, centres).select("id", "label")

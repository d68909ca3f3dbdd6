"""Operators beyond the catalog: goldens, sources, plans, streaming."""

import json
import re

from pyspark.sql import functions as F

from gridloom.functions import scalars
from gridloom.operators import cluster, linking, metrics, resample, rules, series
from gridloom.plans import catalog
from gridloom.sources import tables
from gridloom.streaming import online

from . import duck


def test_lag_vector_is_one_shuffle(spark):
    s = spark.range(2000).select((F.col("id") % 3).cast("string").alias("project"), F.col("id").alias("hour"), F.rand(1).alias("y"))
    plan = series.lag_vector(s, "hour", series.LOAD_DAY_AHEAD, keys=("project",))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_no_cartesian_products(spark):
    for name in ("rule_forecast_avg", "tomek_links", "fcm_step", "best_lag_corr"):
        assert "CartesianProduct" not in catalog.QUERIES[name](spark, duck.SF)._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.maxabs_scale(spark, duck.SF)._jdf.queryExecution().executedPlan().toString()
    read = [{c.split(":")[0] for c in x.split(",")} for x in re.findall(r"ReadSchema: struct<([^>]*)>", plan)]
    assert read and all(x <= {"l_orderkey", "l_linenumber", "l_quantity"} for x in read)
    plan = catalog.T.read(spark, duck.SF, "lineitem").filter("l_quantity > 10").select("l_tax")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,10.0)" in plan and "l_comment" not in plan


def test_gmean_of_the_documented_example(spark):
    y, g = [0, 1, 2, 0, 1, 2], [0, 2, 1, 0, 0, 1]
    rows = spark.createDataFrame(list(zip(y, g, strict=True)), "y int, g int")
    recall = [r.recall for r in metrics.class_report(rows, "y", "g").orderBy("label").collect()]
    assert recall == [1.0, 0.0, 0.0]


def test_rule_base_covers_and_rescues(spark):
    base = rules.rule_base({"x": rules.initial_memberships("x", 2, "trap"), "z": rules.initial_memberships("z", 3)})
    assert len(base) == 6
    df = spark.createDataFrame([(1, 0.5, 0.5), (2, 9.0, 9.0)], "id int, x double, z double")
    got = rules.rescued(df, base).groupBy("id").agg(F.count("*").alias("n"), F.max("act").alias("a")).collect()
    assert {r.id for r in got} == {1, 2} and {r.id: r.a for r in got}[2] == 0.1


def test_trapezoid_edges(spark):
    x = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.0, 2.0, 2.5, 3.0, 4.0)], "x double")
    got = [r.m for r in x.select(scalars.trapezoid(F.col("x"), 0, 1, 2, 3).alias("m")).collect()]
    assert got == [0, 0, 0.5, 1, 1, 0.5, 0, 0]


def test_nearest_by_blocks_equals_one_block(spark):
    v = catalog.vec(spark, duck.SF)
    key = lambda df: sorted((r.id, r.rank, r.other) for r in df.collect())
    assert key(resample.nearest(v, v, 3)) == key(resample.nearest(v, v, 3, block_rows=60))


def test_repeated_edited_loses_the_stray_rows(spark):
    """Two groups, and three rows of the one among the other's."""
    rows = [(i, i % 2, [i % 2 * 10.0 + i * 0.01, 0.0]) for i in range(40)] + [(40 + i, 0, [10.0 + 0.05 * i, 0.1]) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, label int, features array<double>")
    assert sorted(r.id for r in resample.repeated_edited(df, 5).collect()) == list(range(40))


def test_forest_forecasts_beat_the_mean(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    got = catalog.forest_regressor(spark, sf).join(catalog.hourly(spark, sf), ["project", "hour"])
    r = got.agg(F.avg((F.col("y") - F.col("y_hat")) ** 2).alias("e"), F.var_pop("y").alias("v"), F.count("*").alias("n")).collect()[0]
    assert r.n > 100 and r.e < 1.1 * r.v


def test_fuzzy_c_means_finds_two_groups(spark):
    rows = spark.createDataFrame([(i, [float(i % 2 * 10) + i * 0.01]) for i in range(40)], "id long, features array<double>")
    got = cluster.fuzzy_c_means(rows, spark.createDataFrame([(0, [1.0]), (1, [6.0])], "c int, centre array<double>"), 8).orderBy("c").collect()
    assert abs(got[0].centre[0] - 0.2) < 0.3 and abs(got[1].centre[0] - 10.2) < 0.3


def test_transfer_groups(spark):
    links = spark.createDataFrame([("a", "b", 0.95), ("b", "c", 0.9), ("d", "e", 0.5)], "p1 string, p2 string, corr double")
    assert linking.transfer_groups(links, 0.85) == [{"a", "b", "c"}]


def test_csv_sources(spark, tmp_path):
    (tmp_path / "m.csv").write_text("ts,a,b\n01/02/2024 03:00,1.5,NaN\n01/02/2024 04:00,,2\n")
    got = {(r.project, str(r.ts), r.y) for r in tables.measurements_csv(spark, str(tmp_path / "m.csv"), ["a", "b"]).collect()}
    assert ("a", "2024-02-01 03:00:00", 1.5) in got and ("b", "2024-02-01 03:00:00", None) in got and len(got) == 4
    (tmp_path / "r.csv").write_text("a,3.5\nb,4\n")
    assert tables.sites_csv(spark, str(tmp_path / "r.csv"), ["rated"]).count() == 2
    assert tables.first_present(spark, [str(tmp_path / "none"), str(tmp_path / "r.csv")]).endswith("r.csv")


def test_partitioned_sink(spark, tmp_path):
    df = spark.range(20).selectExpr("id", "id % 2 AS k")
    tables.write_partitioned(df, str(tmp_path / "out"), ["k"])
    assert spark.read.parquet(str(tmp_path / "out")).filter("k = 1").count() == 10


def test_requests_are_scored_once(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"project": p, "hour": 1, "y": 2.0, "correlation_id": p}) for p in "ab"))
    fits = spark.createDataFrame([("a", 2.0, 1.0), ("b", 0.0, -5.0)], "project string, slope double, intercept double")
    for _ in range(2):  # the second run finds nothing new
        online.answer(online.scored(tables.requests(spark, str(src)), fits, ["project"], "y"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.project: r.y_hat for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {"a": 5.0, "b": 0.0} and spark.read.json(str(tmp_path / "out")).count() == 2


def test_windowed_stream(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 05:00:00", "a", 4.0)], "ts string, k string, v double").selectExpr("timestamp(ts) AS ts", "k", "v").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "s"))
    q = online.windowed(stream, "ts", "k", "v").writeStream.format("memory").queryName("win").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.y for r in spark.sql("SELECT * FROM win").collect()) == [3.0, 4.0]


def test_search_finds_the_branin_minimum(spark):
    from gridloom.operators import search

    assert abs(search.branin(3.141592653589793, 2.275) - 0.397887) < 1e-5
    at, cost = search.minimise(spark, search.branin, [(-5.0, 10.0), (0.0, 15.0)], calls=48, rounds=5)
    assert len(at) == 2 and cost < 0.45


def test_acquisition_values(spark):
    from gridloom.operators import search

    row = spark.createDataFrame([(0.0, 1.0), (5.0, 0.0)], "m double, s double").select(*[search.acquisition(k, F.col("m"), F.col("s"), 0.0, 0.0).alias(k) for k in ("lcb", "pi", "ei")]).collect()
    assert abs(row[0].lcb + 1.96) < 1e-9 and abs(row[0].pi - 0.5) < 1e-6 and abs(row[0].ei - 0.398942) < 1e-6 and row[1].ei == 0
    assert search.task_grid(spark, ["a", "b"], ["rule.0"], {"lr": [1, 2], "width": [3, 4, 5]}).count() == 12

"""Weather files, stores, calendars, resamplers, models, searches and stateful streams."""

import io
import json
import struct
import tarfile
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import calendar as C
from gridloom.functions import scalars as S
from gridloom.operators import alternating, evolve, features, frames, oversample, ranks, regress, resample, rules, series, weather
from gridloom.plans import catalog
from gridloom.sources import grib, stores
from gridloom.streaming import stateful

from . import duck


def signed(n, size):
    return (abs(n) | (1 << (8 * size - 1) if n < 0 else 0)).to_bytes(size, "big")


def packed(x, bits, low, scale):
    n = np.round((x - low) / 2.0**scale).astype(np.int64)
    flags = (n[:, None] >> np.arange(bits - 1, -1, -1)) & 1
    return np.packbits(flags.astype(np.uint8).ravel()).tobytes()


def ibm(x):
    for e in range(-64, 64):
        m = abs(x) / 16.0**e
        if m < 1:
            return ((x < 0) << 31 | (e + 64) << 24 | int(m * (1 << 24))).to_bytes(4, "big")


def grib1(x, parameter, step, nodata=None):
    """An edition 1 message of a 3 x 4 grid from (40, 20) southwards, half a degree apart, of 2024-05-01 00:00."""
    pds = bytearray(28)
    pds[0:3], pds[3], pds[7], pds[8], pds[9], pds[10:12] = (28).to_bytes(3, "big"), 128, 0x80 | (0x40 if nodata is not None else 0), parameter, 105, (100).to_bytes(2, "big")
    pds[12:17], pds[17], pds[18], pds[24], pds[26:28] = bytes([24, 5, 1, 0, 0]), 1, step, 21, signed(0, 2)
    gds = bytearray(32)
    gds[0:3], gds[6:8], gds[8:10], gds[10:13], gds[13:16], gds[17:20], gds[20:23] = (32).to_bytes(3, "big"), (4).to_bytes(2, "big"), (3).to_bytes(2, "big"), signed(40000, 3), signed(20000, 3), signed(39000, 3), signed(21500, 3)
    bms = b""
    if nodata is not None:
        flags = np.packbits((~nodata).astype(np.uint8)).tobytes()
        bms = (6 + len(flags)).to_bytes(3, "big") + bytes([(-len(nodata)) % 8]) + b"\0\0" + flags
        x = x[~nodata]
    data = packed(x, 12, -16.0, -6)
    bds = (11 + len(data)).to_bytes(3, "big") + b"\0" + signed(-6, 2) + ibm(-16.0) + bytes([12]) + data
    body = bytes(pds) + bytes(gds) + bms + bds + b"7777"
    return b"GRIB" + (8 + len(body)).to_bytes(3, "big") + b"\1" + body


def grib2(x, category, number, step):
    section = lambda k, body: struct.pack(">IB", 5 + len(body), k) + body
    ident = b"\0" * 7 + struct.pack(">HBBBBB", 2024, 5, 1, 6, 0, 0) + b"\0\0"
    grid = b"\0" + struct.pack(">IBBH", 12, 0, 0, 0) + b"\0" * 16 + struct.pack(">II", 4, 3) + b"\0" * 8 + signed(40_000_000, 4) + signed(20_000_000, 4) + b"\0" + signed(39_000_000, 4) + signed(21_500_000, 4) + b"\0" * 8 + b"\0"
    product = b"\0\0" + struct.pack(">H", 0) + bytes([category, number]) + b"\0" * 6 + bytes([1]) + struct.pack(">I", step) + bytes([103, 0]) + struct.pack(">I", 100) + b"\0" * 6
    packing = struct.pack(">IH", 12, 0) + struct.pack(">f", -16.0) + signed(-6, 2) + signed(0, 2) + bytes([12, 0])
    body = section(1, ident) + section(3, grid) + section(4, product) + section(5, packing) + section(6, b"\xff") + section(7, packed(x, 12, -16.0, -6)) + b"7777"
    return b"GRIB\0\0\0\2" + struct.pack(">Q", 16 + len(body)) + body


X = np.arange(12) * 0.5 - 2


def test_weather_files(spark, tmp_path):
    gaps = np.zeros(12, bool)
    gaps[5] = True
    (tmp_path / "010524.grib").write_bytes(b"junk" + grib1(X, 246, 3) + grib1(X + 1, 247, 3) + grib1(X, 167, 3, gaps))
    rows = grib.read(spark, str(tmp_path / "010524.grib")).orderBy("message", "j", "i").collect()
    assert len(rows) == 36 and [r.value for r in rows[:12]] == X.tolist() and rows[24 + 5].value is None
    hour = 19844 * 24
    assert (rows[0].run_hour, rows[0].valid_hour, rows[0].parameter, rows[0].lat, rows[3].lon, rows[11].lat) == (hour, hour + 3, "128.246", 40.0, 21.5, 39.0)
    box = grib.read(spark, str(tmp_path / "010524.grib"), (39.4, 40.1, 20.4, 21.1))
    assert box.count() == 3 * 4 and grib.at_point(box, 39.5, 21.0).count() == 3
    wide = grib.fields(grib.read(spark, str(tmp_path / "010524.grib"))).filter("i = 0 AND j = 0").collect()[0]
    assert (wide.Uwind, wide.Vwind, wide.Flux) == (-2.0, -1.0, None) and abs(wide.WS - 5**0.5) < 1e-9
    with io.BytesIO() as out:
        with tarfile.open(fileobj=out, mode="w:gz") as tar:
            for k in range(2):
                raw = grib2(X, 2, 2, k)
                info = tarfile.TarInfo(f"h{k}.grib2")
                info.size = len(raw)
                tar.addfile(info, io.BytesIO(raw))
        (tmp_path / "020524.tgz").write_bytes(out.getvalue())
    (tmp_path / "030524").mkdir()
    (tmp_path / "030524" / "a.grib2").write_bytes(grib2(X, 0, 0, 7))
    got = grib.days(spark, str(tmp_path), ["010524", "020524", "030524", "040524"])
    assert {(r.edition, r["count"]) for r in got.groupBy("edition").count().collect()} == {(1, 36), (2, 36)}
    assert grib.day(spark, str(tmp_path), "040524") is None and grib.days(spark, str(tmp_path), ["040524"]).count() == 0
    assert grib.day(spark, str(tmp_path), "020524").select("member", "valid_hour").distinct().count() == 2
    bad = bytearray(grib1(X, 246, 3))
    bad[8 + 28 + 5] = 4
    (tmp_path / "bad.grib").write_bytes(bytes(bad))
    with pytest.raises(Exception, match=r"bad\.grib"):
        grib.read(spark, str(tmp_path / "bad.grib")).count()


def test_hourly_runs_by_place(spark, tmp_path):
    for k in (1, 2):
        (tmp_path / f"run_{k:03d}.grib").write_bytes(b"".join(grib1(X + m, 1, 0) for m in range(8)))
    got = grib.hourly_runs(spark, str(tmp_path / "run_*.grib"), 0.1, (39.9, 40.1, 19.9, 20.1)).orderBy("valid_hour").collect()
    assert [r.valid_hour - r.run_hour for r in got] == [1, 2]
    assert (got[0].Uwind, got[0].Vwind, got[0].Temperature, got[0].Cloud, got[0].Precipitation, got[0].Flux) == (-2, -1, 0, 2, 4, 5)


def test_stores(spark, tmp_path):
    at = lambda x: str(tmp_path / x)
    day = spark.createDataFrame([(0, 1.0), (30, 2.0)], "run_hour long, value double")
    stores.save_days(day, at("days"), "m")
    stores.save_days(spark.createDataFrame([(25, 3.0)], "run_hour long, value double"), at("days"), "m")
    assert sorted(r.value for r in stores.load_days(spark, at("days"), "m", 0, 9).collect()) == [1.0, 3.0]
    need = spark.range(30).select(F.col("id").alias("run_day"))
    assert stores.days_to_fetch(need, need.limit(5)).count() == 25 and stores.days_to_fetch(need, need.limit(15)).count() == 0
    made = []
    make = lambda: made.append(1) or spark.range(3).toDF("x")
    assert stores.kept(spark, at("kept"), make).count() == stores.kept(spark, at("kept"), make).count() == 3 and made == [1]
    with pytest.raises(ValueError, match="no such provider"):
        stores.provider("x", {})
    parts = spark.createDataFrame([("a", "rule.0", 1.0), ("a", "rule.1", 2.0)], "project string, rule string, y double")
    stores.save_rule_data(parts, at("rules"))
    assert [r.y for r in stores.rule_data(spark, at("rules"), "a", "rule.1").collect()] == [2.0]
    stats = features.scale_stats(parts, ["y"])
    stores.save_scaler(stats, at("scaler"))
    assert [r.y for r in features.apply_scale(parts, spark.read.parquet(at("scaler")), ["y"]).orderBy("rule").collect()] == [0.0, 1.0]
    stores.save_metrics(parts, at("out"), "result_final")
    assert spark.read.option("header", True).csv(at("out/result_final.csv")).count() == 2
    model = regress.regressor("tree", ["x"], "y").fit(spark.createDataFrame([(float(i), float(i > 3)) for i in range(8)], "x double, y double"))
    stores.save_model(model, at("model"), {"depth": 3}, spark)
    loaded, params = stores.load_model(at("model"), spark)
    assert params == {"depth": 3} and loaded.transform(spark.createDataFrame([(7.0,)], "x double")).collect()[0].prediction == 1.0
    one = spark.createDataFrame([("a", "1"), ("b", "2")], "project string, static_data string")
    stores.put_projects(one, at("projects"))
    stores.put_projects(spark.createDataFrame([("b", "3")], "project string, static_data string"), at("projects"))
    assert {(r.project, r.static_data) for r in spark.read.parquet(at("projects")).collect()} == {("a", "1"), ("b", "3")}
    stores.dump_search({"best": [1, 2]}, at("search"), spark)
    assert stores.load_search(at("search"), spark) == {"best": [1, 2]}
    for name in ("root/my_test", "root/data", "root/models"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "f").write_text("x")
    assert stores.backup(spark, at("root"), at("copy")) == ["models", "my_test"]
    assert stores.clear_tests(spark, at("root")) == ["my_test"] and not (tmp_path / "root/my_test").exists() and (tmp_path / "copy/my_test/f").exists()
    with pytest.raises(FileNotFoundError):
        stores.sites_with_rated(spark, at("none"), "wind")
    assert stores.sites_with_rated(spark, at("none"), "wind", weather_in_data=True) is None


def test_easter_and_clock(spark):
    years = [(2000, "2000-04-23", "2000-04-30"), (2014, "2014-04-20", "2014-04-20"), (2021, "2021-04-04", "2021-05-02"), (2024, "2024-03-31", "2024-05-05"), (2025, "2025-04-20", "2025-04-20")]
    got = spark.createDataFrame([(y,) for y, *_ in years], "y int").select("y", C.easter(F.col("y")).alias("w"), C.orthodox_easter(F.col("y")).alias("e")).collect()
    assert [(r.y, str(r.w), str(r.e)) for r in got] == years
    days = [date(2024, 3, 31) + timedelta(d) for d in (36, 50, 64, 1)] + [date(2014, 4, 20) + timedelta(36)]
    got = spark.createDataFrame([(d,) for d in days], "d date").select(C.is_holiday(F.col("d"), "island").alias("h")).collect()
    assert [r.h for r in got] == [True, True, True, False, False]
    half = spark.createDataFrame([(1800,), (5400,), (9000,), (1801,)], "s long").select(C.half_even_hour(F.col("s")).alias("h")).collect()
    assert [r.h for r in half] == [0, 2, 2, 1]
    local = spark.sql("SELECT timestamp'2024-03-31 03:30:00' AS a, timestamp'2024-07-01 12:00:00' AS b")
    r = local.select(C.local_to_utc(F.col("a"), "Europe/Athens").alias("a"), C.local_to_utc(F.col("b"), "Europe/Athens").cast("string").alias("b"), C.day_key(F.col("b")).alias("k"), C.of_hour_key(F.lit("010724")).alias("bad"), C.of_day_key(F.lit("010724")).cast("string").alias("d")).collect()[0]
    assert (r.a, r.b, r.k, r.bad, r.d) == (None, "2024-07-01 09:00:00", "010724", None, "2024-07-01")


def test_scalars_invert(spark):
    df = spark.createDataFrame([(10.0, "b"), (1000.0, "c")], "x double, c string")
    e = df.select(S.encoded(F.col("x"), "log").alias("l"), S.encoded(F.col("c"), "category", values=["a", "b", "c"]).alias("k"), S.encoded(F.col("x"), "unit", low=10.0, high=1010.0).alias("u"), S.as_json("x", "c").alias("j"))
    back = e.select(S.decoded(F.col("l"), "log").alias("x"), S.decoded(F.col("k"), "category", values=["a", "b", "c"]).alias("c"), S.decoded(F.col("u"), "unit", low=10.0, high=1010.0).alias("u"), S.from_json(F.col("j"), "x double, c string").alias("j")).collect()
    assert [(round(r.x, 6), r.c, r.u, r.j.x) for r in back] == [(10.0, "b", 10.0, 10.0), (1000.0, "c", 1000.0, 1000.0)]
    with pytest.raises(ValueError):
        S.encoded(F.col("x"), "none")


def test_ranks_equal_row_numbers(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("k"), (F.col("id") * 37 % 101).cast("double").alias("v"))
    got = {r.id: r["rank"] for r in ranks.by_value(df, ["k"], "v", ["id"]).collect()}
    rows = sorted((r.k, r.v, r.id) for r in df.collect())
    want, last, n = {}, None, 0
    for k, _, i in rows:
        n = n + 1 if k == last else 1
        last = k
        want[i] = n
    assert got == want


def test_strategies(spark):
    counts = spark.createDataFrame([(0, 10), (1, 40), (2, 25)], "label int, n long")
    of = lambda kind, mode: {r.label: r.target for r in resample.strategy(counts, kind, mode).collect()}
    assert of("over", "auto") == {0: 40, 1: 40, 2: 40} and of("over", "minority") == {0: 40, 1: 40, 2: 25}
    assert of("under", "majority") == {0: 10, 1: 10, 2: 25} and of("clean", "not majority") == {0: 0, 1: 40, 2: 0}
    assert of("over", {0: 12}) == {0: 12, 1: 40, 2: 25} and of("clean", [2]) == {0: 10, 1: 40, 2: 0}
    assert of("under", lambda n: {1: n[0] + 1}) == {0: 10, 1: 11, 2: 25}
    two = counts.filter("label < 2")
    assert {r.label: r.target for r in resample.strategy(two, "over", 0.5).collect()} == {0: 20, 1: 40}
    for kind, mode in (("over", {0: 5}), ("under", {0: 50}), ("over", {9: 1}), ("over", 0.5)):
        with pytest.raises(ValueError):
            of(kind, mode)


def brute_condensed(rows, minority):
    few = [f for _, l, f in rows if l == minority]
    kept = {i for i, l, _ in rows if l == minority}
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for c in {l for _, l, _ in rows} - {minority}:
        own = sorted((i, f) for i, l, f in rows if l == c)
        store = [own[0][1]]
        kept.add(own[0][0])
        for i, f in own[1:]:
            if min(dist(f, x) for x in few) < min(dist(f, s) for s in store):
                store.append(f)
                kept.add(i)
    return kept


def test_condensed_equals_the_sequential_store(spark):
    v = catalog.vec(spark, duck.SF)
    rows = [(r.id, r.label, r.features) for r in v.collect()]
    assert {r.id for r in resample.condensed(v, 0).collect()} == brute_condensed(rows, 0)


def test_repeated_edited_stops_where_nothing_goes(spark):
    rows = spark.createDataFrame([(i, int(i % 5 == 0), [float(i // 5), float(i % 3)]) for i in range(60)], "id long, label int, features array<double>")
    left = resample.repeated_edited(rows, 3, targets=[0])
    once = resample.edited(left, 3, targets=[0])
    counts = {r.label: r["count"] for r in left.groupBy("label").count().collect()}
    assert counts[1] == 12 and (once.count() == left.count() or counts[0] <= counts[1])


BLOBS = [(i, int(i % 6 == 0), [float((i % 6 == 0) * 3 + (i * 7 % 11) / 11), float((i * 5 % 13) / 13)]) for i in range(120)]


@pytest.fixture(scope="module")
def blobs(spark):
    return spark.createDataFrame(BLOBS, "id long, label int, features array<double>")


def inside(made, slack=0.0):
    return all(3 - slack <= r.features[0] <= 4 + slack and -slack <= r.features[1] <= 1 + slack for r in made)


def test_more_oversamplers(spark, blobs):
    made = oversample.kmeans_smote(blobs, 1, 30, clusters=3, k=2).collect()
    assert 30 <= len(made) <= 33 and inside(made) and {r.label for r in made} == {1}
    made = oversample.svm_smote(blobs, 1, 20, k=3, m=5).collect()
    assert len(made) in (20, 10) and inside(made, 1.0)
    named = blobs.withColumn("kind", F.when(F.col("id") % 4 == 0, "a").otherwise("b"))
    made = oversample.with_categories(named, 1, 25, ["kind"], k=3).collect()
    assert len(made) == 25 and inside(made) and {r.kind for r in made} <= {"a", "b"}
    with pytest.raises(ValueError, match="no cluster"):
        oversample.kmeans_smote(blobs.filter("label = 0 OR id < 7"), 1, 5, clusters=3)
    tensors = blobs.select("id", "features", F.array(F.col("features")[0] * 10, F.col("features")[1] * 10).alias("tensor"), F.col("features")[0].alias("y"))
    made = oversample.regression_adasyn(tensors, "y", k=3).collect()
    assert made and all(abs(r.tensor[0] - 10 * r.features[0]) < 1e-9 and len(r.features) == 2 for r in made)


def test_instance_hardness_and_centroids(spark, blobs):
    targets = resample.strategy(blobs.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "under")
    left = {r.label: r["count"] for r in oversample.instance_hardness(blobs, targets, folds=3).groupBy("label").count().collect()}
    assert left[1] == 20 and 20 <= left[0] <= 100
    soft = resample.cluster_centroids(blobs, {0: 6})
    assert soft.filter("label = 0").count() == 6 and soft.filter("label = 1").count() == 20
    hard = oversample.nearest_representatives(blobs.filter("label = 0"), soft.filter("label = 0"))
    assert 1 <= hard.count() <= 6


def test_ensembles_and_pipelines(spark, blobs):
    models = oversample.balanced_ensemble(blobs, "tree", 3)
    got = oversample.votes(models, blobs).collect()
    assert sum(r.label == r.guess for r in got) >= 118
    models, says = oversample.under_boosted(blobs, 2)
    assert len(models) == len(says) >= 1
    flat = blobs.select("id", "label", "features", F.col("features")[0].alias("x"))
    seen = []
    step = oversample.function_sampler(lambda df, n: seen.append(n) or df.filter(F.col("id") < n), n=60)
    model = oversample.ResamplingPipeline(step, regress.regressor("tree", ["x"], "label")).fit(flat.drop("features"))
    assert seen == [60] and model.transform(flat.drop("features")).count() == 120
    batches = oversample.balanced_batches(blobs, 10).groupBy("batch", "label").count().collect()
    assert {r["count"] for r in batches} == {5} and len(batches) == 8


@pytest.mark.parametrize("kind", alternating.KINDS)
def test_clustering_kinds_part_two_groups(spark, kind):
    apart, along = (lambda i: float(i % 2 * 10) + (i * 7 % 10) * 0.1), (lambda i: (i * 3 % 10) * (3.0 if kind == "varieties" else 0.1))  # varieties are long
    rows = spark.createDataFrame([(i, [apart(i), along(i)]) for i in range(60)], "id long, features array<double>")
    state = alternating.fit(rows, [[1.0, 0.5], [8.0, 0.5]], kind, rounds=15)
    got = {r.id: r.c for r in alternating.assigned(rows, state).collect()}
    assert len({got[i] for i in range(0, 60, 2)}) == 1 and got[0] != got[1] and len({got[i] for i in range(1, 60, 2)}) == 1


def test_linear_models(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4))
    y = 2 + x @ [1.5, -2, 0, 0.5] + rng.normal(0, 0.1, 400)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, a double, b double, c double, d double, y double")
    names = ["a", "b", "c", "d"]
    m = regress.moments(df, names, "y")
    want = np.linalg.lstsq(np.c_[np.ones(400), x], y, rcond=None)[0]
    got = regress.ridge(m)
    assert np.allclose([got.intercept, *got.weights], want, atol=1e-8)
    assert np.allclose(regress.bayesian_ridge(m).weights, want[1:], atol=1e-2)
    sparse = regress.elastic_net(m, 0.2, 1.0)
    assert sparse.weights[2] == 0 and abs(sparse.weights[1] + 1.8) < 0.1
    assert abs(regress.mean_squared_error(m, got) - np.mean((np.c_[np.ones(400), x] @ want - y) ** 2)) < 1e-9
    pairs = regress.fold_moments(df, names, "y", "id")
    assert set(regress.forward(pairs)) >= {"a", "b", "d"} and set(regress.backward(pairs)) >= {"a", "b", "d"}
    penalty, mix = regress.elastic_net_cv(pairs)
    assert penalty < 0.1 and 0 < mix <= 1
    pca = regress.principal_components(m, 0.5)
    assert 1 <= len(pca[1]) <= 4 and regress.projected(df, m, pca).agg(F.abs(F.avg("pc_0")).alias("m")).collect()[0].m < 1e-9
    pred, model = regress.stacked(df.select("id", "a", "b", "d", "y"), ["id"], ["a", "b", "d"], "bayesian")
    assert pred.count() == 400 and pred.agg(F.min("y_hat")).collect()[0][0] >= 0 and len(model.weights) == 3
    kept = regress.boruta(df, names, "y", "id", n_folds=2, rounds=2, trees=8)
    assert "b" in kept and "c" not in kept
    assert "b" in regress.recursive_elimination(df, ["a", "b", "c"], "y", "id", n_folds=2, trees=5)
    nets = regress.per_group_network(df.withColumn("k", F.lit("s")), "k", names, "y", steps=800, rate=0.02)
    e = regress.network_forecast(df.withColumn("k", F.lit("s")), nets, "k", names).agg(F.avg((F.col("y_hat") - F.col("y")) ** 2)).collect()[0][0]
    assert e < 0.3 * np.var(y)


def test_evolution(spark):
    score = evolve.scored_on(spark, lambda x, y: (x * x + y * y, (x - 1) ** 2 + y * y))
    points, costs = evolve.search(score, [-2, -2], [2, 2], evolve.Settings(parents=20, children=30, generations=8))
    assert points and all(abs(p[1]) < 0.5 and -0.4 < p[0] < 1.4 for p in points) and min(c[0] for c in costs) < 0.3
    assert (evolve.dominated(np.array([[1, 2], [2, 1], [2, 2]])) == [0, 0, 2]).all()


def test_rule_bases(spark):
    df = spark.range(400).select("id", (F.col("id") % 100 / 99.0).alias("x")).withColumn("y", F.col("x") * 3 + 1)
    base = rules.rule_base({"x": rules.initial_memberships("x", 2)})
    a, b = evolve.rule_objectives(df, df, base, ["x"], "y", ["id"], 1.0, least=10, share=1.1)
    assert a < 1e-9 and b < 1e-6
    assert evolve.rule_objectives(df, df, base, ["x"], "y", ["id"], 1.0, least=1000)[1] > 1e14
    tuned = evolve.optimised_rules(df, df, base, ["x"], "y", ["id"], 1.0, evolve.Settings(parents=4, children=4, generations=1), least=10, share=1.1)
    assert set(tuned) == set(base)
    three = rules.rule_base({"x": rules.initial_memberships("x", 3)})
    narrow = {**three, "rule.3": [rules.Membership("x", "gauss", (0.5, 0.001))]}
    assert set(evolve.pruned(df, narrow, ["id"], least=10, share=1.1)) == set(three)
    with pytest.raises(ValueError, match="can't be removed"):
        evolve.pruned(df, {"rule.0": three["rule.1"]}, ["id"], least=1000)
    assert rules.rescue_count(df, base) == 0
    with pytest.raises(ValueError, match="no active rule"):
        rules.rescue_count(df.withColumn("x", F.lit(50.0)), base)
    assert len(evolve.with_horizons(base)) == 24


def test_frames(spark):
    s = spark.createDataFrame([("a", t, float(t)) for t in range(40)] + [("b", t, float(t)) for t in range(20)], "project string, hour long, y double")
    out = series.shrinking_split(s, "hour", ("project",))
    assert out.filter("split = 'test'").count() / 60 <= 0.5 and out.count() == 60
    assert frames.methods(["RBF_ALL", "MLP", "RBF_OLS"]) == ["RBF_OLS", "GA_RBF_OLS", "RBFNN", "MLP"]
    assert frames.group_total(s.withColumnRenamed("y", "total"), "all_wind").columns == ["project", "hour", "all_wind"]
    assert features.reordered(s, ["y"]).columns == ["y", "project", "hour"]
    assert features.column_order(s.withColumn("z", -F.col("y")), ["z", "hour"], "y") == ["hour", "z"]
    assert [r.hour for r in frames.shuffled(s.filter("project = 'b'"), ["hour"]).collect()] == [r.hour for r in frames.shuffled(s.filter("project = 'b'").repartition(3), ["hour"]).collect()]
    with pytest.raises(Exception, match="too many gaps"):
        frames.imputed(s.withColumn("y", F.when(F.col("hour") < 5, F.col("y"))), ["y"]).collect()
    assert frames.common_index(s.filter("hour < 5").select("project", "hour"), s, ["project", "hour"]).count() == 10
    assert weather.columns_with(s, "PROJ") == ["project"]


def test_online_weights_go_on_between_batches(spark, tmp_path):
    rows = [("s", i, 0.7 * (i % 7 + 1) + 0.3 * (i % 5 + 1), float(i % 7 + 1), float(i % 5 + 1)) for i in range(40)]
    kind = "project string, hour long, y double, a double, b double"
    for k in range(2):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], kind).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = stateful.online_weights(stream, "project", "hour", ["a", "b"]).writeStream.format("memory").queryName("weights").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.n, r.weights) for r in spark.sql("SELECT * FROM weights").collect())
    assert [n for n, _ in got] == [20, 40] and abs(sum(got[1][1]) - 1) < 1e-9
    x, y = np.array([r[3:] for r in rows]), np.array([r[2] for r in rows])
    assert np.allclose(got[1][1], stateful.updated(None, x, y)[0])


def test_requests_are_dispatched(spark, tmp_path):
    asked = [("fit", "1", "q", 100), ("other", "2", "q", 100), ("fit", "3", "q", 10)]
    batch = spark.createDataFrame([(*a, json.dumps({"n": a[3]})) for a in asked], "consumer_name string, correlation_id string, reply_to string, sent long, static_data string")
    f = lambda df: df.withColumn("body", F.get_json_object("static_data", "$.n"))
    got = {r.correlation_id: (r.status, r.body) for r in stateful.dispatched(batch, {"fit": f}, late=50, now=120).collect()}
    assert got == {"1": ("done", "100"), "2": ("unknown consumer", None), "3": ("too late", None)}
    batch.write.json(str(tmp_path / "in"))
    for _ in range(2):
        stateful.serve(spark.readStream.schema(batch.schema).json(str(tmp_path / "in")), {"fit": f}, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_feedback_equals_the_loop(spark):
    s = spark.createDataFrame([("a", t, float(t % 4)) for t in range(10)], "project string, hour long, y double")
    got = stateful.feedback(s, ["project"], "hour", "y", [1, 4], 6, lambda w: 0.5 * F.col("lag_0") + 0.25 * F.col("lag_1") + 1, 9)
    y = [float(t % 4) for t in range(10)]
    for _ in range(6):
        y.append(0.5 * y[-1] + 0.25 * y[-4] + 1)
    assert [r.y_hat for r in got.orderBy("hour").collect()] == y[10:]

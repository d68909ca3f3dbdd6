"""More resamplers: at support vectors, with categories, within clusters, of regression targets, by hardness; ensembles and pipelines around them."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import by_share, by_value
from .resample import interpolated, nearest, random_under, shared_out, strategy, uniform

#: Categories of one column, which are listed on the driver.
MAX_CATEGORIES = 10_000


def _asked(own: DataFrame, n_new: int, seed: int) -> DataFrame:
    """id, n: n_new rows shared out over the rows of one class."""
    target = own.groupBy("label").agg((F.count(F.lit(1)) + n_new).alias("target"))
    return shared_out(own, target, seed).filter("__more > 0").select("id", F.col("__more").alias("n"))


def support_vectors(rows: DataFrame, label: int, rounds: int = 50, reg: float = 0.01) -> DataFrame:
    """Rows of a class within the margin of a linear support-vector classifier of the class against all others (a linear stand-in for a kernel one), or those about as near to the border as its nearest one, if none is within."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector, vector_to_array

    marked = rows.select("*", array_to_vector("features").alias("__v"), (F.col("label") == label).cast("double").alias("__y"))
    model = LinearSVC(featuresCol="__v", labelCol="__y", rawPredictionCol="__raw", predictionCol="__p", maxIter=rounds, regParam=reg).fit(marked)
    own = model.transform(marked).filter(F.col("label") == label).withColumn("__m", vector_to_array("__raw")[1])
    nearest_one = own.agg(F.min("__m")).collect()[0][0]
    return own.filter(F.col("__m") <= max(1.0, 1.1 * (nearest_one or 0.0))).select(*rows.columns)


def svm_smote(rows: DataFrame, label: int, n_new: int, k: int = 5, m: int = 10, out_step: float = 0.5, seed: int = 0) -> DataFrame:
    """Synthetic rows around the support vectors of a class: noise (only foreign neighbours) goes; in danger (half or more foreign) they move towards neighbours of the class, else away from them by out_step at most. About half of the rows come from each."""
    sv = support_vectors(rows, label)
    near = nearest(sv, rows, m).groupBy("id").agg(F.sum((F.col("other_label") != label).cast("int")).alias("foreign"), F.count(F.lit(1)).alias("m"))
    sv = sv.join(near, "id").filter(F.col("foreign") < F.col("m"))
    danger, safe = sv.filter(2 * F.col("foreign") >= F.col("m")).select(*rows.columns), sv.filter(2 * F.col("foreign") < F.col("m")).select(*rows.columns)
    some = [not danger.isEmpty(), not safe.isEmpty()]
    split = n_new // 2 if all(some) else n_new if some[0] else 0
    own = rows.filter(F.col("label") == label)
    moved = interpolated(own, _asked(danger, split, seed), nearest(danger, own, k), seed) if split else None
    if n_new - split and some[1]:
        outward = interpolated(own, _asked(safe, n_new - split, seed + 2), nearest(safe, own, k), seed + 2, scale=-out_step)
        moved = outward if moved is None else moved.union(outward)
    return moved


def with_categories(rows: DataFrame, label: int, n_new: int, categories: list[str], k: int = 5, seed: int = 0) -> DataFrame:
    """Synthetic rows of a class with number columns (`features`) and category columns: a differing category counts as the median deviation of the numbers; numbers move towards one neighbour, categories are the most frequent of all k (ties: the first by name). A null category is a category of its own, before all names."""
    own = rows.filter(F.col("label") == label)
    dims = own.select(F.posexplode("features").alias("dim", "x")).groupBy("dim").agg(F.stddev_pop("x").alias("sd"))
    median = dims.agg(F.median("sd")).collect()[0][0] or 0.0
    encoded = F.col("features")
    for c in categories:
        seen = sorted({r[0] for r in rows.select(F.col(c).cast("string")).distinct().limit(MAX_CATEGORIES + 1).collect()}, key=lambda v: (v is not None, v))
        if len(seen) > MAX_CATEGORIES:
            raise ValueError(f"{c} has more than {MAX_CATEGORIES} categories")
        encoded = F.concat(encoded, F.array(*[F.when(F.col(c).cast("string").eqNullSafe(F.lit(v)), median / 2).otherwise(0.0) for v in seen]))
    coded = own.withColumn("features", encoded)
    near = nearest(coded, coded, k)
    made = interpolated(own, _asked(own, n_new, seed), near, seed)
    votes = near.join(own.select(F.col("id").alias("other"), *categories), "other")
    for c in categories:
        count = votes.groupBy("id", c).agg(F.count(F.lit(1)).alias("n"))
        made = made.join(count.groupBy("id").agg(F.min_by(c, F.struct(-F.col("n"), F.col(c))).alias(c)), "id")
    return made.select("id", "copy", "label", "features", *categories)


def _distance_sum(left: pa.Table, right: pa.Table) -> pa.Table:
    if not len(left) or not len(right):
        return pa.table({"cell": pa.array([], pa.int32()), "total": pa.array([], pa.float64())})
    a, b = (np.array(t.column("features").to_pylist(), float) for t in (left, right))
    total = sum(float(np.sqrt(((a[i : i + 256, None] - b[None]) ** 2).sum(-1)).sum()) for i in range(0, len(a), 256))
    return pa.table({"cell": pa.array([left.column("cell")[0].as_py()], pa.int32()), "total": pa.array([total])})


def sparsity(rows: DataFrame, block_rows: int = 2000) -> DataFrame:
    """cell, n, sparsity of rows (cell, id, features): the mean distance of two of a cell's rows to the power 0.16 * log_1.6(n)^1.8, over n. Blocks meet blocks in tasks, and only sums leave them."""
    sizes = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    cut = rows.join(F.broadcast(sizes), "cell").withColumn("parts", F.ceil(F.col("n") / block_rows).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    left = cut.select("cell", F.col("own").alias("a"), every.alias("b"), F.col("features").alias("features"))
    right = cut.select(F.col("cell").alias("cell"), every.alias("a"), F.col("own").alias("b"), F.col("features").alias("features"))
    keys = ["cell", "a", "b"]
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_distance_sum, "cell int, total double")
    mean = F.try_divide(F.sum("total"), F.first("n") * (F.first("n") - 1))
    out = sums.join(F.broadcast(sizes), "cell").groupBy("cell").agg(F.first("n").alias("n"), mean.alias("mean"))
    power = 0.16 * F.pow(F.log("n") / math.log(1.6), F.lit(1.8))
    return out.select("cell", "n", (F.pow("mean", power) / F.col("n")).alias("sparsity"))


def kmeans_smote(rows: DataFrame, label: int, n_new: int, clusters: int = 8, k: int = 5, threshold: float = 0.0, seed: int = 1) -> DataFrame:
    """Synthetic rows of a class within the clusters of all rows in which the class has a share of `threshold` and more than k rows, more of them where its rows lie apart."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=clusters, seed=seed, featuresCol="__v", predictionCol="cell").fit(rows.select(array_to_vector("features").alias("__v")))
    cells = model.transform(rows.withColumn("__v", array_to_vector("features"))).drop("__v")
    shares = cells.groupBy("cell").agg(F.avg((F.col("label") == label).cast("double")).alias("share"), F.count_if(F.col("label") == label).alias("own"))
    good = shares.filter((F.col("share") >= threshold) & (F.col("own") > k)).select("cell")
    own = cells.filter(F.col("label") == label).join(F.broadcast(good), "cell")
    weight = {r.cell: (r.n, r.sparsity) for r in sparsity(own.select("cell", "id", "features")).collect()}  # a row for each cluster
    total = sum(w for _, w in weight.values())
    if not total:
        raise ValueError(f"no cluster has enough rows of class {label}; lower the threshold or take fewer clusters")
    targets = rows.sparkSession.createDataFrame([(c, n + math.ceil(n_new * w / total)) for c, (n, w) in weight.items()], "label int, target long")
    inside = own.select("id", F.col("cell").alias("label"), "features")  # a cluster is a class here
    asked = shared_out(inside, targets, seed).filter("__more > 0").select("id", "label", "features", F.col("__more").alias("n"))
    return interpolated(inside, asked.select("id", "n"), nearest(asked, inside, k, within=True), seed).withColumn("label", F.lit(label))


def regression_adasyn(rows: DataFrame, value: str, k: int = 5, seed: int = 0) -> DataFrame:
    """Synthetic rows for a numeric target: its values' bins (a standard deviation wide, small ones joined) are the classes, `features` the columns that are searched and move; the target and other columns are copied, and `tensor` (a flat array), where there is one, moves by the same steps towards the same neighbour."""
    s = rows.agg(F.min(value).alias("__lo"), F.stddev_pop(value).alias("__sd"))
    label = F.greatest(F.ceil((F.col(value) - F.col("__lo")) / F.col("__sd")), F.lit(0)).cast("int")
    binned = rows.crossJoin(F.broadcast(s)).withColumn("label", label).select("id", "label", "features", *(["tensor"] if "tensor" in rows.columns else []))  # one row
    counts = binned.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    asked = shared_out(binned.join(F.broadcast(counts.select("label")), "label").select(*binned.columns), strategy(counts, "over"), seed).filter("__more > 0")
    near = nearest(asked, binned, k, within=True)
    wide = binned.withColumn("features", F.concat("features", "tensor")) if "tensor" in rows.columns else binned
    made = interpolated(wide.select("id", "label", "features"), asked.select("id", F.col("__more").alias("n")), near, seed)
    rest = rows.select(F.col("id").alias("__id"), F.size("features").alias("__n"), *[c for c in rows.columns if c not in ("id", "features", "tensor")])
    out = made.join(rest, F.col("id") == F.col("__id"))
    if "tensor" in rows.columns:
        out = out.withColumn("tensor", F.slice("features", F.col("__n") + 1, F.size("features") - F.col("__n")))
    return out.withColumn("features", F.slice("features", F.lit(1), F.col("__n"))).drop("__id", "__n", "label")


def hardness(rows: DataFrame, folds: int = 5, trees: int = 20, seed: int = 1) -> DataFrame:
    """id, label, p: the probability of each row's own label, by forests that haven't seen its fold."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector, vector_to_array

    named = rows.select("id", "label", array_to_vector("features").alias("__v"), F.pmod(F.xxhash64("id"), F.lit(folds)).alias("__fold"))
    named = StringIndexer(inputCol="label", outputCol="__y", handleInvalid="keep").fit(named).transform(named)
    out = None
    for k in range(folds):
        model = RandomForestClassifier(featuresCol="__v", labelCol="__y", probabilityCol="__p", numTrees=trees, seed=seed).fit(named.filter(F.col("__fold") != k))
        got = model.transform(named.filter(F.col("__fold") == k)).select("id", "label", F.get(vector_to_array("__p"), F.col("__y").cast("int")).alias("p"))
        out = got if out is None else out.union(got)
    return out.fillna(0.0, subset=["p"])


def instance_hardness(rows: DataFrame, targets: DataFrame, folds: int = 5) -> DataFrame:
    """The rows of each class whose probability reaches the percentile that leaves its target."""
    h = hardness(rows, folds)
    n = h.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    cut = n.join(targets.select("label", "target"), "label", "left").withColumn("q", F.when(F.col("target") < F.col("n"), 1 - F.col("target") / F.col("n")).otherwise(0.0))
    limits = [(r.label, r.q) for r in cut.collect()]  # a row for each class
    at = h.groupBy("label").agg(*[F.percentile(F.when(F.col("label") == c, F.col("p")), q).alias(f"c{i}") for i, (c, q) in enumerate(limits)])
    least = at.select("label", F.coalesce(*[F.when(F.col("label") == c, F.col(f"c{i}")) for i, (c, _) in enumerate(limits)]).alias("least"))
    keep = h.join(F.broadcast(least), "label").filter(F.col("p") >= F.col("least")).select("id")
    return rows.join(keep, "id", "left_semi")


def nearest_representatives(rows: DataFrame, centres: DataFrame) -> DataFrame:
    """Hard cluster centroids: of each class, the row nearest to each of its centres (centres: label, features)."""
    least = rows.agg(F.min("id")).collect()[0][0] or 0  # ids below all rows' own, so that no row is left out of a search as the centre itself
    key = by_value(centres.withColumn("__h", F.xxhash64("label", "features")), [], "__h", ["label", "features"], "__c").select((F.lit(least).cast("long") - F.col("__c")).alias("id"), "label", "features")
    found = nearest(key, rows, 1, within=True)
    return rows.join(found.select(F.col("other").alias("id")).distinct(), "id", "left_semi")


def balanced_bags(rows: DataFrame, bags: int, learner: Callable[[DataFrame, int], object], seed: int = 0) -> list:
    """A model for each bag: the learner's fit on rows whose classes were all cut to the smallest, drawn anew for each bag."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    targets = strategy(counts, "under", "all")
    return [learner(random_under(rows, targets, seed + b), b) for b in range(bags)]


def _classifier(kind: str, seed: int):
    from pyspark.ml import classification

    of = {"tree": classification.DecisionTreeClassifier, "forest": classification.RandomForestClassifier, "boosted": classification.GBTClassifier}
    return of[kind](featuresCol="__v", labelCol="label", probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__yhat", seed=seed)


def _vectors(rows: DataFrame) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.withColumn("__v", array_to_vector("features"))


def balanced_ensemble(rows: DataFrame, kind: str = "tree", bags: int = 10, seed: int = 0) -> list:
    """Balanced bagging (trees), a balanced forest (one tree a bag with few features would be `tree`; `forest` has forests), or an easy ensemble (`boosted`, two classes)."""
    return balanced_bags(rows, bags, lambda part, b: _classifier(kind, seed + b).fit(_vectors(part)), seed)


def votes(models: list, rows: DataFrame) -> DataFrame:
    """id, label, guess: the class with the largest mean probability of all models (ties: the smallest)."""
    from pyspark.ml.functions import vector_to_array

    out, total = _vectors(rows), None
    for n, model in enumerate(models):
        out = model.transform(out).withColumn(f"__p{n}", vector_to_array("__p")).drop("__p", "__raw", "__yhat")
        total = F.col(f"__p{n}") if total is None else F.zip_with(total, F.col(f"__p{n}"), lambda a, b: a + b)
    return out.select("id", "label", (F.array_position(total, F.array_max(total)) - 1).cast("int").alias("guess"))


def under_boosted(rows: DataFrame, rounds: int = 10, depth: int = 3, seed: int = 0) -> tuple[list, list[float]]:
    """Boosting with undersampling: each round fits a weighted tree on classes cut to the smallest, and weighs up what it gets wrong among all rows. Weights are columns; one sum a round reaches the driver."""
    from pyspark.ml.classification import DecisionTreeClassifier

    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    classes = counts.count()
    weighed, models, says = _vectors(rows).withColumn("__w", F.lit(1.0)), [], []
    for r in range(rounds):
        part = random_under(weighed, strategy(counts, "under", "all"), seed + r)
        model = DecisionTreeClassifier(featuresCol="__v", labelCol="label", weightCol="__w", maxDepth=depth, seed=seed + r, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__yhat").fit(part)
        got = model.transform(weighed)
        wrong = (F.col("__yhat") != F.col("label")).cast("double")
        err = got.agg(F.sum(F.col("__w") * wrong) / F.sum("__w")).collect()[0][0]
        err = min(max(err, 1e-9), 1 - 1e-9)
        say = math.log((1 - err) / err) + math.log(max(classes - 1, 1))
        if say <= 0:
            break
        models.append(model)
        says.append(say)
        weighed = got.withColumn("__w", F.col("__w") * F.exp(say * wrong)).drop("__p", "__raw", "__yhat")
    return models, says


class ResamplingPipeline:
    """Steps in order: samplers (functions of a table) are applied when fitting only; Spark ML stages are fitted and kept."""

    def __init__(self, *steps):
        self.steps = list(steps)

    def fit(self, df: DataFrame):
        from pyspark.ml import PipelineModel
        from pyspark.ml.base import Estimator

        kept = []
        for step in self.steps:
            if isinstance(step, Estimator):
                step = step.fit(df)
            elif not hasattr(step, "transform"):  # a sampler
                df = step(df)
                continue
            kept.append(step)
            df = step.transform(df)
        return PipelineModel(kept)


def function_sampler(f: Callable[..., DataFrame], **more) -> Callable[[DataFrame], DataFrame]:
    """Any function of a table as a sampler step."""
    return lambda df: f(df, **more)


def balanced_batches(rows: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """rows with batch: equal numbers of every class in each batch of about `size` rows, the smallest class's rows once; what is left of larger classes goes."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    each = max(1, size // max(1, counts.count()))
    kept = random_under(rows, strategy(counts, "under", "all"), seed)
    placed = by_share(kept, ["label"], uniform(F.col("id"), seed=seed + 1), ["id"], "__r")
    return placed.withColumn("batch", F.floor((F.col("__r") - 1) / each)).drop("__r")

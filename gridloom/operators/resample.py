"""Resampling of imbalanced classes. Neighbours come from one operator: exact k nearest by cells and blocks.

Vectors are dealt to cells (the nearest of a bounded number of pivots) and blocks of about BLOCK_ROWS, a row each. Blocks
of queries meet the blocks that can hold one of their k nearest as pairs of such rows, which tasks read from the two
sides' parts: rows are never joined with rows, and no block is copied for each one that it meets. No vectors but the
pivots reach the driver, and distances never leave the task: a merge of k rows a part gives the k best of all.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.interim import dropped, written
from .ranks import by_share, by_value

BLOCK_ROWS = 4096
#: The numbers of a block at most, however long its vectors are; blocks of a part of the searched side; and the most pivots.
BLOCK_NUMBERS = 1 << 18
PART_BLOCKS = 16
MAX_PIVOTS = 256
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_FOUND = "id long, other long, other_label int, dist double"


def strategy(counts: DataFrame, kind: str, mode="auto") -> DataFrame:
    """label, n, target (rows after resampling): over tops classes up to the largest, under cuts them to the smallest, clean names the classes that may lose rows (target 0).

    mode: all, majority, not majority, minority, not minority, auto (over: not majority; else: not minority); a dict of
    targets; a list of labels (clean only); a float (two classes: smaller over larger after resampling); or a function
    from a dict of counts to a dict of targets. A few class counts reach the driver for the last four.
    """
    if not isinstance(mode, str):
        n = {r.label: r.n for r in counts.collect()}
        targets = mode(dict(n)) if callable(mode) else mode
        if isinstance(targets, list | tuple | set):
            if kind != "clean":
                raise ValueError("a list names classes to clean")
            targets = {c: 0 for c in targets}
        elif isinstance(targets, float):
            if len(n) != 2 or kind == "clean":
                raise ValueError("a share needs two classes")
            few, many = sorted(n, key=lambda c: (n[c], -c))
            targets = {few: int(targets * n[many])} if kind == "over" else {many: int(n[few] / targets)}
        if unknown := set(targets) - set(n):
            raise ValueError(f"no rows of the classes {sorted(unknown)}")
        for c, t in targets.items():
            if kind == "over" and t < n[c] or kind == "under" and t > n[c]:
                raise ValueError(f"class {c} has {n[c]} rows, {t} were asked for")
        listed = counts.sparkSession.createDataFrame([(c, int(t)) for c, t in targets.items()], "label int, target long")
        return counts.join(F.broadcast(listed), "label", "left").select("label", "n", F.coalesce("target", "n").alias("target"))
    w = Window.partitionBy()  # a row for each class
    top, low = F.max("n").over(w), F.min("n").over(w)
    first = F.row_number().over(Window.orderBy(F.desc("n"), "label")) == 1
    last = F.row_number().over(Window.orderBy("n", "label")) == 1
    applies = {"all": F.lit(True), "majority": first, "minority": last, "not majority": ~first, "not minority": ~last}
    mode = ("not majority" if kind == "over" else "not minority") if mode == "auto" else mode
    return counts.withColumn("target", F.when(applies[mode], {"over": top, "under": low, "clean": F.lit(0)}[kind]).otherwise(F.col("n")))


def _vectors(column) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).astype(float)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Best:
    """The k best rows so far of each query of a block: nearest, ties by id, or farthest, ties by the larger id. Products find the candidates, differences decide."""

    def __init__(self, own: np.ndarray, q: np.ndarray, k: int, farthest: bool = False):
        self.own, self.q, self.k, self.sign = own, q, k, -1 if farthest else 1
        self.nq = (q * q).sum(1)
        self.dist = np.full((len(q), k), np.inf)  # times sign, as are the ids: smaller is better
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max)
        self.labels = np.full((len(q), k), -1, np.int32)

    def limit(self) -> np.ndarray:
        """What a distance times sign must not exceed to matter."""
        return self.dist[:, -1]

    def meet(self, at: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        """Rows of the searched block meet the queries in the places `at`."""
        nx = (x * x).sum(1)
        step = max(1, 4_000_000 // max(1, len(x)))
        for a in range(0, len(at) if len(x) else 0, step):
            part = at[a : a + step]
            rough = self.q[part] @ x.T
            rough *= -2
            rough += nx
            rough += self.nq[part, None]
            rough *= self.sign
            rough[self.own[part, None] == ids[None]] = np.inf
            last = self.limit()[part]
            bound = np.where(np.isfinite(last), self.sign * last * last, np.inf)
            if not np.isfinite(bound).all():
                bound = np.minimum(bound, np.partition(rough, min(self.k, len(x)) - 1, axis=1)[:, min(self.k, len(x)) - 1])
            slack = 1e-9 * (self.nq[part] + nx.max(initial=0)) + 1e-12
            row, col = np.divmod(np.flatnonzero(rough <= (bound + slack)[:, None]), len(x))
            sure = self.own[part[row]] != ids[col]
            self._take(part[row[sure]], ids[col[sure]], labels[col[sure]], np.sqrt(((self.q[part[row[sure]]] - x[col[sure]]) ** 2).sum(1)))

    def _take(self, row: np.ndarray, ids: np.ndarray, labels: np.ndarray, dist: np.ndarray) -> None:
        touched = np.unique(row)
        row = np.concatenate([np.repeat(touched, self.k), row])
        dist = np.concatenate([self.dist[touched].ravel(), self.sign * dist])
        ids = np.concatenate([self.ids[touched].ravel(), self.sign * ids])
        labels = np.concatenate([self.labels[touched].ravel(), labels])
        order = np.lexsort((ids, dist, row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]  # each has k or more
        for to, v in ((self.dist, dist), (self.ids, ids), (self.labels, labels)):
            to[touched] = v[order].reshape(-1, self.k)

    def found(self, seen: np.ndarray | None = None) -> pa.RecordBatch:
        """id, other, other_label, dist of all that was found; `seen`: no ids that these, times sign, hold already."""
        ok = np.isfinite(self.dist)
        if seen is not None:
            ok &= ~(self.ids[:, :, None] == seen[:, None, :]).any(2)
        row, col = np.nonzero(ok)
        return pa.RecordBatch.from_arrays([pa.array(self.own[row]), pa.array(self.sign * self.ids[row, col]), pa.array(self.labels[row, col]), pa.array(self.sign * self.dist[row, col])], ["id", "other", "other_label", "dist"])


_PACKED = "cell int, block int, far double, ids binary, labels binary, vectors binary"
_BEGUN = _PACKED + ", home struct<cell: int, block: int>, dist binary, others binary, other_labels binary, most double, gaps array<double>"


def _pack(rows: pa.Table) -> pa.Table:
    """For `applyInArrow` over one block: one row with all that it holds; numbers that single precision keeps are kept so."""
    x = np.concatenate([_vectors(c) for c in rows.column("features").chunks if len(c)])
    with np.errstate(over="ignore"):
        short = x.astype(np.float32)
    kept = short if np.array_equal(short, x) else x
    ids, labels = rows.column("id").to_numpy().astype(np.int64), rows.column("label").to_numpy().astype(np.int32)
    out = [rows.column("cell")[0].as_py(), rows.column("block")[0].as_py(), max(rows.column("far").to_pylist()), ids.tobytes(), labels.tobytes(), kept.tobytes()]
    return pa.table([pa.array([v], t) for v, t in zip(out, (pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["cell", "block", "far", "ids", "labels", "vectors"])


def _unpacked(ids: bytes, labels: bytes, vectors: bytes, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own = np.frombuffer(ids, np.int64)
    kind = np.float32 if len(vectors) == 4 * dims * len(own) else np.float64
    return own, np.frombuffer(labels, np.int32), np.frombuffer(vectors, kind).reshape(len(own), dims).astype(float)


def _met(pivots: np.ndarray, k: int, within: bool, farthest: bool, first: bool):
    """For `mapInArrow` over pairs of packed blocks, of which those of one query block follow each other.

    `first`: every query block meets one block, and a row of it with what was found comes out; else what the further
    blocks add comes out, for queries whose own bound does not rule a block out.
    """
    dims, names = pivots.shape[1], ["cell", "block", "far", "ids", "labels", "vectors"]

    def run(batches):
        held = best = labels = seen = None
        for batch in batches:
            for n in range(batch.num_rows):
                at = {c: batch.column(c)[n] for c in batch.schema.names}
                key = (at["cell"].as_py(), at["block"].as_py())
                if key != held:
                    if best is not None and not first:
                        yield best.found(seen)
                    held = key
                    own, labels, q = _unpacked(*(at[c].as_buffer() for c in names[3:]), dims)
                    best = Best(own, q, k, farthest)
                    if not first:
                        best.dist, best.ids, best.labels = (np.frombuffer(at[c].as_py(), t).reshape(len(own), k).copy() for c, t in (("dist", np.float64), ("others", np.int64), ("other_labels", np.int32)))
                        seen = best.ids.copy()
                ids, their, x = _unpacked(*(at[f"x_{c}"].as_buffer() for c in names[3:]), dims)
                to = np.sqrt(((q - pivots[at["x_cell"].as_py()]) ** 2).sum(1))
                far = at["x_far"].as_py()
                least = -(to + far) * (1 + 1e-9) if farthest else (to - far) - 1e-9 * (to + far)
                near = least <= best.limit() + 1e-9
                for c in np.unique(labels) if within else (None,):
                    mine = np.flatnonzero(near if c is None else near & (labels == c))
                    theirs = slice(None) if c is None else np.flatnonzero(their == c)
                    if len(mine):
                        best.meet(mine, ids[theirs], their[theirs], x[theirs])
                if first:
                    got = [pa.array([v], pa.binary()) for v in (best.dist.tobytes(), best.ids.tobytes(), best.labels.tobytes())]
                    most = float(best.limit().max(initial=-np.inf))
                    gaps = pa.array([np.sqrt(((pivots - pivots[at["cell"].as_py()]) ** 2).sum(1)).tolist()], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(n, 1) for c in names), batch.column("home").slice(n, 1), *got, pa.array([most]), gaps], [*names, "home", "dist", "others", "other_labels", "most", "gaps"])
        if best is not None and not first:
            yield best.found(seen)

    return run


def _first_found(k: int, farthest: bool):
    """For `mapInArrow` over the query blocks: the rows that they found first."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own = np.frombuffer(row["ids"], np.int64)
                best = Best(own, np.zeros((len(own), 1)), k, farthest)
                best.dist, best.ids, best.labels = (np.frombuffer(row[c], t).reshape(len(own), k) for c, t in (("dist", np.float64), ("others", np.int64), ("other_labels", np.int32)))
                yield best.found()

    return run


def _best(found: DataFrame, k: int, farthest: bool = False) -> DataFrame:
    w = Window.partitionBy("id").orderBy(*([F.desc("dist"), F.desc("other")] if farthest else ["dist", "other"]))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _few_a_batch(df: DataFrame, name: str) -> DataFrame:
    """`written`, while Arrow batches have two rows: a row is a pair of blocks."""
    conf = df.sparkSession.conf
    rows = conf.get(ARROW_ROWS)
    conf.set(ARROW_ROWS, "2")
    try:
        return written(df, name)
    finally:
        conf.set(ARROW_ROWS, rows)


def nearest(queries: DataFrame, searched: DataFrame, k: int, block_rows: int = BLOCK_ROWS, within: bool = False, farthest: bool = False) -> DataFrame:
    """id, other, other_label, dist, rank (1 to k): the k nearest of `searched` (id, label, features) to each query, itself left out; ties by id. `within`: only rows of the query's own label. `farthest`: the k farthest instead, ties by the larger id.

    Both sides are packed into blocks, a row each. A block of queries first meets one block of its own cell, which
    bounds its k-th distances, and then all blocks that these bounds can't rule out, by cells' pivots and radii. Tasks
    read both sides' parts as they are, so no block is ever copied for the others it meets, and k rows a query and
    part are all that is shuffled. The result is a table of its own.
    """
    spark, same = searched.sparkSession, queries is searched
    q = queries.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label") if "label" in queries.columns else F.lit(0).alias("label"), "features")
    x = searched.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"), "features")
    n = searched.count()
    if not n:
        return spark.createDataFrame([], _FOUND + ", rank int")
    rows = x.orderBy(F.xxhash64("id"), "id").select("features").limit(min(MAX_PIVOTS, -(-n // block_rows))).collect()
    pivots = np.array([r.features for r in rows], float)
    block_rows = max(1, min(block_rows, BLOCK_NUMBERS // max(1, pivots.shape[1])))

    def located(df: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                v = _vectors(batch.column("features")).reshape(batch.num_rows, pivots.shape[1])
                cell, far = np.zeros(len(v), np.int32), np.full(len(v), np.inf)
                for c, p in enumerate(pivots):
                    d = np.sqrt(((v - p) ** 2).sum(1))
                    cell[d < far] = c
                    far = np.minimum(d, far)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "label", "features")), pa.array(cell), pa.array(far)], ["id", "label", "features", "cell", "far"])

        return df.mapInArrow(run, "id long, label int, features array<double>, cell int, far double")

    def packed(df: DataFrame, name: str) -> tuple[DataFrame, list]:
        at = located(df)
        sizes = {r.cell: r["count"] for r in at.groupBy("cell").count().collect()}  # a row for each pivot
        blocks = F.array(*[F.lit(-(-sizes.get(c, 1) // block_rows)) for c in range(len(pivots))])
        at = at.withColumn("block", F.pmod(F.xxhash64("id"), F.get(blocks, F.col("cell"))).cast("int"))
        out = written(at.groupBy("cell", "block").applyInArrow(_pack, _PACKED), name)
        return out, out.select("cell", "block").collect()  # a row for each block

    theirs, held = packed(x, "searched")
    queried, asked = (theirs, held) if same else packed(q, "queries")
    by_cell: dict = {}
    for r in held:
        by_cell.setdefault(r.cell, []).append(r.block)
    full = np.array(sorted(by_cell))
    # a cell of queries alone starts at the nearest one that has rows
    starts = [int(full[((pivots[full] - p) ** 2).sum(1).argmin()]) if c not in by_cell else c for c, p in enumerate(pivots)]
    homes = F.array(*[F.array(*[F.lit(b) for b in by_cell[c]]) for c in starts])
    start = F.get(F.array(*[F.lit(c) for c in starts]), F.col("cell"))
    home = F.get(homes, F.col("cell"))
    mine = queried.withColumn("home", F.struct(start.alias("cell"), F.get(home, F.pmod("block", F.size(home))).alias("block")))
    few = max(1, min(len(asked), max(2 * spark.sparkContext.defaultParallelism, -(-len(asked) // 8))))
    parts = -(-len(held) * block_rows * pivots.shape[1] // (PART_BLOCKS * BLOCK_NUMBERS))
    other = theirs.select([F.col(c).alias(f"x_{c}") for c in theirs.columns]).repartition(parts).hint("shuffle_replicate_nl")
    pair = F.struct(F.col("x_cell").alias("cell"), F.col("x_block").alias("block"))
    met = mine.repartition(few).join(other, F.col("home") == pair).mapInArrow(_met(pivots, k, within, farthest, True), _BEGUN)
    begun = _few_a_batch(met, "begun")
    found = begun.select("ids", "dist", "others", "other_labels").mapInArrow(_first_found(k, farthest), _FOUND)
    if len(held) > 1:
        gap, radii = F.get("gaps", F.col("x_cell")), F.col("far") + F.col("x_far")
        least = -(gap + radii) * (1 + 1e-9) if farthest else gap - radii - 1e-9 * (gap + radii)
        further = begun.repartition(few).join(other, (F.col("home") != pair) & (least <= F.col("most") + 1e-9))
        found = found.union(further.mapInArrow(_met(pivots, k, within, farthest, False), _FOUND))
    out = _few_a_batch(_best(found, k, farthest), "nearest")
    for df in (theirs, begun) if same else (theirs, queried, begun):
        dropped(df)
    return out


def tomek_links(rows: DataFrame) -> DataFrame:
    """a < b: mutual nearest neighbours of different labels."""
    near = nearest(rows, rows, 1).join(rows.select("id", "label"), "id").filter(F.col("label") != F.col("other_label"))
    back = near.select(F.col("id").alias("other"), F.col("other").alias("id"))
    return near.select("id", "other").join(back, ["id", "other"]).filter("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"))


def edited(rows: DataFrame, k: int = 3, kind: str = "mode", targets: list[int] | None = None) -> DataFrame:
    """The rows that edited nearest neighbours keeps: the label is the neighbours' most frequent one (ties: the smallest), or that of all. `targets`: the classes that may lose rows."""
    return _agreeing(rows, nearest(rows, rows, k), kind, targets)


def _agreeing(rows: DataFrame, near: DataFrame, kind: str, targets: list[int] | None) -> DataFrame:
    """The rows whose label is that of their neighbours in `near`."""
    votes = near.groupBy("id", "other_label").agg(F.count(F.lit(1)).alias("n"))
    if kind == "mode":
        won = votes.groupBy("id").agg(F.max_by("other_label", F.struct("n", -F.col("other_label"))).alias("won"))
    else:
        won = votes.groupBy("id").agg(F.when(F.count(F.lit(1)) == 1, F.first("other_label")).alias("won"))
    good = F.coalesce(F.col("won") == F.col("label"), F.lit(False))
    if targets is not None:
        good = good | ~F.col("label").isin(targets)
    return rows.join(won, "id", "left").filter(good).select(*rows.columns)


def _near_left(near: DataFrame, left: DataFrame, k: int) -> DataFrame:
    """`nearest` of the rows left: searched anew for those that lost a neighbour only, as the others' k nearest stay the same."""
    own = near.join(left.select("id"), "id", "left_semi")
    lost = written(own.join(left.select(F.col("id").alias("other")), "other", "left_anti").select("id").distinct(), "lost")
    anew = nearest(left.join(lost, "id", "left_semi"), left, k)
    out = written(own.join(lost, "id", "left_anti").unionByName(anew), "near")
    for df in (near, lost, anew):
        dropped(df)
    return out


def repeated_edited(rows: DataFrame, k: int = 3, kind: str = "mode", targets: list[int] | None = None, most: int | None = None) -> DataFrame:
    """Edited nearest neighbours until nothing goes, a class would vanish, or the smallest class would no longer be it; `most`: after so many rounds at the latest.

    Each round's rows and their neighbours are tables of their own, so a round's plan is that of one edit.
    """
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    minority = min(counts, key=lambda c: (counts[c], c)) if counts else None
    near = None
    for _ in count() if most is None else range(most):  # a round that isn't the last one loses a row
        near = nearest(rows, rows, k) if near is None else _near_left(near, rows, k)
        left = written(_agreeing(rows, near, kind, targets), "edited")
        now = {r.label: r["count"] for r in left.groupBy("label").count().collect()}
        if now == counts or len(now) < len(counts) or any(n < now[minority] for c, n in now.items() if c != minority):
            rows = rows if len(now) < len(counts) else left
            break
        dropped(rows)
        rows, counts = left, now
    if near is not None:
        dropped(near)
    return rows


def all_knn(rows: DataFrame, k: int = 3, kind: str = "mode", targets: list[int] | None = None) -> DataFrame:
    """Edited nearest neighbours with 1, 2, ... k neighbours in turn."""
    for n in range(1, k):
        before, rows = rows, written(edited(rows, n, kind, targets), "edited")
        dropped(before)
    return edited(rows, k, kind, targets)


def near_miss(rows: DataFrame, minority: int, k: int = 3, version: int = 1, keep: int | None = None) -> DataFrame:
    """NearMiss: of every other class, as many rows as the minority has: nearest to their k closest (1) or k farthest (2) minority rows, or farthest of those near it (3)."""
    few, rest = rows.filter(F.col("label") == minority), rows.filter(F.col("label") != minority)
    n = few.count() if keep is None else keep
    if version == 3:
        close = nearest(few, rest, k).select(F.col("other").alias("id")).distinct()
        rest = rest.join(close, "id", "left_semi")
    near = nearest(rest, few, k, farthest=version == 2)
    score = near.groupBy("id").agg(F.avg("dist").alias("d")).withColumn("d", -F.col("d") if version == 3 else F.col("d"))
    kept = by_value(rest.join(score, "id"), ["label"], "d", ["id"], "r").filter(F.col("r") <= n).select(*rows.columns)
    return few.union(kept)


def neighbourhood_cleaning(rows: DataFrame, minority: int, k: int = 3, share: float = 0.5) -> DataFrame:
    """The rows that the neighbourhood cleaning rule keeps: neither misclassified by their neighbours, nor a neighbour, of a class large enough, of a misclassified minority row."""
    near = nearest(rows, rows, k)
    votes = near.groupBy("id", "other_label").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.max_by("other_label", F.struct("n", -F.col("other_label"))).alias("won"))
    wrong = rows.join(votes, "id").filter(F.col("won") != F.col("label")).select("id", "label")
    a1 = wrong.filter(F.col("label") != minority).select("id")
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    large = [c for c, n in counts.items() if c != minority and n > share * counts.get(minority, 0)]
    a2 = near.join(wrong.filter(F.col("label") == minority).select("id"), "id").filter(F.col("other_label").isin(large)).select(F.col("other").alias("id"))
    return rows.join(a1.union(a2).distinct(), "id", "left_anti")


def condensed(rows: DataFrame, minority: int, prefix: int = 4096) -> DataFrame:
    """Condensed nearest neighbour: each class grows a store, by id order, with the rows that its store and the minority misclassify.

    A row joins unless a row of its class that joined before is as near as the minority's nearest, so a row is decided
    once all before it are. A round takes each class's first `prefix` undecided rows, decides them in order (a task a
    class, of that many rows at most), and one pass drops all later rows that the newly stored ones keep out. The
    distance to the minority is searched by blocks beforehand; the newly stored rows, at most `prefix` a class, are
    what goes to all tasks. The result is that of the sequential store, whatever the prefix.
    """
    few, rest = rows.filter(F.col("label") == minority), rows.filter(F.col("label") != minority)
    closest = nearest(rest, few, 1).select("id", "dist")
    schema = rest.select("id", "label", "features").schema
    # without a minority nothing is nearer than a class's first row
    left = written(rest.select("id", "label", "features").join(closest, "id", "left").withColumn("dist", F.coalesce("dist", F.lit(float("inf")))), "undecided")
    stored = None
    while labels := [r.label for r in left.select("label").distinct().collect()]:
        first = [left.filter(F.col("label") == c).orderBy("id").limit(prefix) for c in labels]
        firsts = first[0]
        for df in first[1:]:
            firsts = firsts.union(df)
        decided = written(firsts.groupBy("label").applyInArrow(_in_order, "id long, label int, features array<double>, stays boolean"), "decided")
        last = {r.label: r.last for r in decided.groupBy("label").agg(F.max("id").alias("last")).collect()}
        new = decided.filter("stays").drop("stays")
        by_class: dict = {}
        for r in new.collect():  # at most prefix rows a class
            by_class.setdefault(r.label, []).append(r.features)
        stored = new if stored is None else stored.union(new)
        before, left = left, written(left.mapInArrow(_kept_out({c: np.array(v, float) for c, v in by_class.items()}, last), left.schema), "undecided")
        dropped(before)
    mine = few.select("id", "label", "features")
    return mine if stored is None else mine.union(stored.select([F.col(f.name).cast(f.dataType) for f in schema]))


def _in_order(rows: pa.Table) -> pa.Table:
    """Whether each row, in order of id, is farther from all that stay before it than from the minority."""
    rows = rows.sort_by("id").combine_chunks()
    x = np.array(rows.column("features").to_pylist(), float)
    far, own = rows.column("dist").to_numpy(), np.full(len(x), np.inf)
    stays = np.zeros(len(x), bool)
    for i in range(len(x)):
        if i == 0 or far[i] < own[i]:
            stays[i] = True
            own[i:] = np.minimum(own[i:], np.sqrt(((x[i:] - x[i]) ** 2).sum(1)))
    kinds = {"id": pa.int64(), "label": pa.int32(), "features": pa.list_(pa.float64())}
    return pa.table({c: rows.column(c).cast(t) for c, t in kinds.items()} | {"stays": stays})


def _kept_out(stored: dict[int, np.ndarray], last: dict[int, int]):
    """The rows after those decided that no newly stored row of their class keeps out."""

    def run(batches):
        for batch in batches:
            ids, labels, far = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", "dist"))
            on = np.zeros(len(ids), bool)
            for c in np.unique(labels):
                at = np.flatnonzero((labels == c) & (ids > last[int(c)]))
                if len(at):
                    x = _vectors(batch.column("features").take(pa.array(at)))
                    on[at] = ~near_any(x, far[at], stored[int(c)])
            yield batch.filter(pa.array(on))

    return run


def near_any(x: np.ndarray, far: np.ndarray, stored: np.ndarray) -> np.ndarray:
    """Whether a stored row is within each row's distance; products rule out, differences decide."""
    out = np.zeros(len(x), bool)
    ns = (stored * stored).sum(1)
    step = max(1, 2_000_000 // max(1, len(stored)))
    for a in range(0, len(x), step):
        part, limit = x[a : a + step], far[a : a + step]
        nx = (part * part).sum(1)
        rough = nx[:, None] + ns[None] - 2 * (part @ stored.T)
        row, col = np.nonzero(rough <= (limit * limit + 1e-9 * (nx + ns.max(initial=0)) + 1e-12)[:, None])
        hit = np.sqrt(((part[row] - stored[col]) ** 2).sum(1)) <= limit[row]
        out[a + row[hit]] = True
    return out


def uniform(*parts: Column, seed: int = 0) -> Column:
    """A uniform number that depends on the parts and the seed alone, not on partitions, by MD5, so that other engines can draw it too."""
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts], F.lit(str(seed))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def random_under(rows: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """At most `target` rows of each label (targets: label, target), by hashed order."""
    ranked = by_share(rows, ["label"], uniform(F.col("id"), seed=seed), ["id"], "__r")
    return ranked.join(F.broadcast(targets.select("label", "target")), "label").filter(F.col("__r") <= F.col("target")).select(*rows.columns)


def random_over(rows: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """All rows and, with replacement, as many more of each label as its target asks for: each row is repeated a whole number of times and a hashed rest."""
    placed = shared_out(rows, targets, seed).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), "__more")))
    return placed.select(*rows.columns, "copy")


def shared_out(rows: DataFrame, targets: DataFrame, seed: int = 0) -> DataFrame:
    """rows with __more: how many of the rows that its label lacks fall to each row; the rest by hashed order."""
    n = rows.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
    t = targets.select("label", "target").join(n, "label").withColumn("__lack", F.greatest(F.col("target") - F.col("__n"), F.lit(0)))
    placed = by_share(rows, ["label"], uniform(F.col("id"), seed=seed), ["id"], "__r").join(F.broadcast(t), "label")
    more = F.floor(F.col("__lack") / F.col("__n")) + F.when(F.col("__r") <= F.col("__lack") % F.col("__n"), 1).otherwise(0)
    return placed.withColumn("__more", more.cast("long")).select(*rows.columns, "__more")


def interpolated(rows: DataFrame, asked: DataFrame, near: DataFrame, seed: int = 0, each: bool = False, half_foreign: bool = False, scale: float = 1.0) -> DataFrame:
    """Synthetic rows x + u * (neighbour - x): asked (id, n) rows for each id, a hashed neighbour of `near` each; u once a row, or for each feature, and up to a half only towards another label with half_foreign; steps are `scale` times as long (below zero: away)."""
    listed = near.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("rank", "other"))).alias("near"))  # k rows an id
    drawn = rows.join(asked.filter("n > 0"), "id").join(listed, "id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    pick = F.floor(uniform(F.col("id"), F.col("copy"), seed=seed) * F.size("near")).cast("int")
    drawn = drawn.withColumn("other", F.col("near")[pick]["other"])
    other = rows.select(F.col("id").alias("other"), F.col("features").alias("__f"), F.col("label").alias("__l"))
    far = F.when(F.col("__l") != F.col("label"), 0.5).otherwise(scale) if half_foreign else F.lit(float(scale))
    step = (lambda i: far * uniform(F.col("id"), F.col("copy"), i, seed=seed + 1)) if each else (lambda i: far * uniform(F.col("id"), F.col("copy"), seed=seed + 1))
    moved = F.transform(F.arrays_zip("features", "__f"), lambda p, i: p["features"] + step(i) * (p["__f"] - p["features"]))
    return drawn.join(other, "other").select("id", "copy", "label", moved.alias("features"))


def smote(rows: DataFrame, label: int, n_new: int, k: int = 5, seed: int = 0) -> DataFrame:
    """n_new synthetic rows of one class between its rows and their k nearest of the class."""
    own = rows.filter(F.col("label") == label)
    target = own.groupBy("label").agg((F.count(F.lit(1)) + n_new).alias("target"))
    return smote_to(own, target, k, seed)


def smote_to(rows: DataFrame, targets: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """Synthetic rows of every class that its target (label, target) asks for, all classes at once."""
    asked = shared_out(rows, targets, seed).filter("__more > 0").select("id", "label", "features", F.col("__more").alias("n"))
    near = nearest(asked, rows, k, within=True)
    return interpolated(rows, asked.select("id", "n"), near, seed)


def borderline(rows: DataFrame, label: int, m: int = 10) -> DataFrame:
    """Ids of a class in danger: half or more, but not all, of their m nearest are of other classes."""
    near = nearest(rows.filter(F.col("label") == label), rows, m)
    foreign = near.groupBy("id").agg(F.sum((F.col("other_label") != label).cast("int")).alias("foreign"), F.count(F.lit(1)).alias("m"))
    return foreign.filter((2 * F.col("foreign") >= F.col("m")) & (F.col("foreign") < F.col("m"))).select("id", "foreign")


def borderline_smote(rows: DataFrame, label: int, n_new: int, k: int = 5, m: int = 10, kind: int = 1, seed: int = 0) -> DataFrame:
    """Synthetic rows of a class from its rows in danger. Kind 1: towards neighbours of the class; kind 2: towards neighbours of any class, half as far at most where that is another one."""
    danger = rows.join(borderline(rows, label, m).select("id"), "id", "left_semi").select(*rows.columns)
    target = danger.groupBy("label").agg((F.count(F.lit(1)) + n_new).alias("target"))
    asked = shared_out(danger, target, seed).filter("__more > 0").select("id", F.col("__more").alias("n"))
    near = nearest(danger, rows.filter(F.col("label") == label) if kind == 1 else rows, k)
    return interpolated(rows, asked, near, seed, half_foreign=kind == 2)


def adasyn_counts(rows: DataFrame, label: int, n_new: int, k: int = 5) -> DataFrame:
    """id, ratio, n: synthetic rows for each row of a class, by the share of other classes near it; a share of 0 counts as 0.01, each row gets one more, and a row that would get none gets two."""
    near = nearest(rows.filter(F.col("label") == label), rows, k)
    r = near.groupBy("id").agg(F.avg((F.col("other_label") != label).cast("double")).alias("ratio"))
    r = r.withColumn("ratio", F.when(F.col("ratio") == 0, 0.01).otherwise(F.col("ratio")))
    n = F.bround(F.col("ratio") / F.col("__sum") * n_new).cast("int")
    return r.crossJoin(F.broadcast(r.agg(F.sum("ratio").alias("__sum")))).select("id", "ratio", (F.when(n == 0, 2).otherwise(n) + 1).alias("n"))  # one row


def adasyn(rows: DataFrame, label: int, n_new: int, k: int = 5, seed: int = 0) -> DataFrame:
    own = rows.filter(F.col("label") == label)
    return interpolated(own, adasyn_counts(rows, label, n_new, k).select("id", "n"), nearest(own, own, k), seed, each=True)


def adasyn_to(rows: DataFrame, targets: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """`adasyn` of every class that its target (label, target) asks for, all classes at once."""
    n = rows.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
    lack = targets.join(n, "label").select("label", (F.col("target") - F.col("__n")).alias("__lack")).filter("__lack > 0")
    asked = rows.join(F.broadcast(lack), "label")
    r = nearest(asked, rows, k).join(asked.select("id", "label", "__lack"), "id")
    r = r.groupBy("id", "label", "__lack").agg(F.avg((F.col("other_label") != F.col("label")).cast("double")).alias("ratio"))
    r = r.withColumn("ratio", F.when(F.col("ratio") == 0, 0.01).otherwise(F.col("ratio")))
    r = r.join(F.broadcast(r.groupBy("label").agg(F.sum("ratio").alias("__sum"))), "label")
    made = F.bround(F.col("ratio") / F.col("__sum") * F.col("__lack")).cast("int")
    counts = r.select("id", (F.when(made == 0, 2).otherwise(made) + 1).alias("n"))
    return interpolated(rows, counts, nearest(asked, rows, k, within=True), seed, each=True)


def one_sided(rows: DataFrame, minority: int, seeds: list[int]) -> DataFrame:
    """One-sided selection: of the other classes, the seeds and what 1-NN on minority and seeds gets wrong; then Tomek links lose their majority member."""
    few = rows.filter(F.col("label") == minority)
    store = few.union(rows.filter(F.col("id").isin(seeds) & (F.col("label") != minority)))
    rest = rows.filter((F.col("label") != minority) & ~F.col("id").isin(seeds))
    wrong = nearest(rest, store, 1).join(rest.select("id", "label"), "id").filter(F.col("other_label") != F.col("label")).select("id")
    left = store.union(rest.join(wrong, "id", "left_semi").select(*rows.columns))
    return without_tomek(written(left, "selected"), minority)


def without_tomek(rows: DataFrame, minority: int | None = None) -> DataFrame:
    """Rows without Tomek links' members: of both sides, or, with `minority`, of the other classes only."""
    links = tomek_links(rows)
    ends = links.select(F.col("a").alias("id")).union(links.select(F.col("b").alias("id"))).distinct()
    gone = rows.join(ends, "id", "left_semi").filter(F.lit(True) if minority is None else F.col("label") != minority).select("id")
    return rows.join(gone, "id", "left_anti")


def _numbered(rows: DataFrame, made: DataFrame) -> DataFrame:
    """Old and synthetic rows with distinct ids, in a table of their own, as searches read them again and again: synthetic ones go on from the largest old id, in order of their sources and copies."""
    top = rows.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("__top"))  # one row
    made = written(made, "made")
    placed = by_value(made, [], "id", ["id", "copy"], "__r").crossJoin(F.broadcast(top))
    out = written(rows.select("id", "label", "features").union(placed.select((F.col("__top") + F.col("__r")).alias("id"), "label", "features")), "numbered")
    dropped(made)
    return out


def smote_enn(rows: DataFrame, label: int, n_new: int, k: int = 5, seed: int = 0) -> DataFrame:
    return edited(_numbered(rows, smote(rows, label, n_new, k, seed)), 3, "all")


def smote_tomek(rows: DataFrame, label: int, n_new: int, k: int = 5, seed: int = 0) -> DataFrame:
    return without_tomek(_numbered(rows, smote(rows, label, n_new, k, seed)))


def cluster_centroids(rows: DataFrame, targets: dict[int, int], seed: int = 1) -> DataFrame:
    """label, features: of each class in `targets`, that many k-means centres in place of its rows; other classes stay."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = rows.sparkSession
    out = rows.filter(~F.col("label").isin(list(targets))).select("label", "features")
    for label, n in sorted(targets.items()):
        model = KMeans(k=n, seed=seed, featuresCol="v").fit(rows.filter(F.col("label") == label).select(array_to_vector("features").alias("v")))
        out = out.union(spark.createDataFrame([(label, [float(x) for x in c]) for c in model.clusterCenters()], "label int, features array<double>"))
    return out


def bins_by_deviation(rows: DataFrame, value: str, least: int = 2) -> DataFrame:
    """Right-closed bins of one standard deviation from the minimum, with counts; bins under `least` rows join the one before."""
    s = rows.agg(F.min(value).alias("__lo"), F.stddev_pop(value).alias("__sd"))
    binned = rows.crossJoin(F.broadcast(s)).withColumn("bin", F.greatest(F.ceil((F.col(value) - F.col("__lo")) / F.col("__sd")), F.lit(0)).cast("int"))  # one row
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("bin")  # a few bins
    kept = counts.withColumn("into", F.last(F.when(F.col("n") >= least, F.col("bin")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.groupBy(F.coalesce("into", "bin").alias("bin")).agg(F.sum("n").alias("n"))

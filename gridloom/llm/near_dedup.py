"""Near-duplicate groups by MinHash bands, odd sketches and exact checks.

One pass takes of every document the MD5 of its words (A-Z lower-cased, between blanks), its number of distinct 5-word
shingles, BANDS x ROWS MinHash values and, folded from these, an odd sketch: a bitmap of SKETCH_BITS in which each
sample flips one bit, so that the bits of the XOR of two sketches tell how many samples differ. Documents with equal
words are one node, however many they are; nodes that agree in a band share a bucket. Pairs whose sketches are too far
apart (SKETCH_LEAST, over four standard deviations under the threshold) are left out; all others are checked on the
full sets. Texts are shuffled only of nodes that share a bucket, found behind a Bloom filter of bounded size.

Pairs are few. Every node is first held against one other: of the smallest nodes of its buckets, the one that most of
its bands name. Buckets that hold several components after that are searched whole, by finer sketches (FINE_SAMPLES):
nodes outside a bucket's largest component against all of other components, in parts of bounded size that a task holds
at once. Of the pairs near enough, at first only those leave it that would join all its components, the likeliest, fewer
than its nodes; then, of what is still apart, each from the first of its buckets, and of a node and a component only the
nearest where that is SURE. So no link between nodes of a bucket is lost, and no pair within a component is made, but for
chances of about 5e-6: that two texts at 0.75 share no band, or that a sketch is four and a half deviations off. Sets
are of 64-bit hashes of shingles: two of a pair's n shingles coincide with n * n chances in 2^64, 1e-11 for 10,000 words.

Defined cases: a text that is null or has no words has an empty set and is linked with nothing; with fewer than five
words the whole sequence is the one shingle; repeated rows and ids are members like any other; a document without id is
a member, but no id of a group: it is kept only where its whole group has none; an empty table gives an empty one;
other columns are ignored. Texts are taken whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import cut, row_key, tidy
from .url_filter import blocks_for, bloom, marked, possible

SHINGLE = 5
BANDS, ROWS = 32, 4
SKETCH_BITS = 512
#: Links need 100 * |A and B| >= PERCENT * |A or B|.
PERCENT = 75
SKETCH_LEAST = 0.54
#: The finer sketches, of nodes whose buckets hold several components: samples, bits, and four and a half deviations under what 0.75 shows as.
FINE_SAMPLES, FINE_BITS, FINE_LEAST = 4096, 16384, 0.7
#: A pair that the finer sketches show as this near, four and a half deviations over 0.75, stands for the node and that component.
SURE = 0.8
#: Nodes of a bucket in a part; pairs whose sets a task holds at once.
PART = 512
PAIRS = 256
#: Stands for a null id.
NO_ID = -(1 << 63)

_rng = np.random.Generator(np.random.PCG64(7))
_A = _rng.integers(1, 1 << 63, FINE_SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, FINE_SAMPLES, dtype=np.uint64)


def min_hashes(h: np.ndarray, bounds: np.ndarray, samples: int = BANDS * ROWS) -> np.ndarray:
    """A row of MinHash samples for each set that isn't empty."""
    at = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(at), samples), np.uint64)
    for k in range(samples):
        v = h ^ _B[k]
        v *= _A[k]
        v ^= v >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(v, at)
    return out


def band_keys(samples: np.ndarray) -> np.ndarray:
    from .kernels import mix

    n = len(samples)
    s = mix(samples).reshape(n, BANDS, ROWS)
    key = np.repeat(np.arange(BANDS, dtype=np.uint64)[None, :], n, 0)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9DDFEA08EB382D69) + s[:, :, r])
    return key.view(np.int64)


def odd_sketches(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """bits / 64 words for each row of samples: sample k with value v flips bit hash(k, v)."""
    from .kernels import mix

    n, k = samples.shape
    bit = (mix(samples + np.arange(k, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(bits)).astype(np.int64)
    odd = np.bincount((np.arange(n)[:, None] * bits + bit).ravel(), minlength=n * bits).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits) & 1, axis=1, bitorder="little").view(np.int64)


def likeness(a: Column, b: Column, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> Column:
    """The similarity that two odd sketches (arrays of long) tell."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return 1 + bits / (4.0 * samples) * F.log(F.greatest(F.lit(1e-9), 1 - 2 * differ / bits))


def words_only(data: np.ndarray, off: np.ndarray) -> Iterator[bytes]:
    """Of each text: its words in lower case (A-Z), one blank between two of them."""
    from .kernels import _BLANK, _FOLD

    blank = _BLANK[data]
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # the first blank after a word stays
    heads = off[:-1][off[:-1] < off[1:]]
    keep[heads] = ~blank[heads]
    at = np.r_[0, np.cumsum(keep)][off].tolist()
    out = _FOLD[data[keep]]
    out[blank[keep]] = 0x20
    raw = out.tobytes()
    for a, b in zip(at, at[1:], strict=False):
        yield raw[a : b - (b > a and raw[b - 1] == 0x20)]


def prints(docs: DataFrame) -> DataFrame:
    """d, k, node (MD5 of the words), n_shingles, bands (array of long) and sketch (array of long; both null for an empty set) of docs (d, k, text). One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .kernels import blocks, shingle_sets

        for batch in batches:
            nodes = [md5(words).digest() for _, data, off in blocks(batch.column("text")) for words in words_only(data, off)]
            at = 0
            for _, h, bounds in shingle_sets(batch.column("text"), SHINGLE):
                size = np.diff(bounds)
                full = size > 0
                keys, odd = np.zeros((len(size), BANDS), np.int64), np.zeros((len(size), SKETCH_BITS // 64), np.int64)
                if full.any():
                    samples = min_hashes(h, bounds)
                    keys[full], odd[full] = band_keys(samples), odd_sketches(samples)
                listed = [pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()), mask=pa.array(~full)) for x in (keys, odd)]
                part = batch.slice(at, len(size))
                yield pa.RecordBatch.from_arrays([part.column("d"), part.column("k"), pa.array(nodes[at : at + len(size)], pa.binary()), pa.array(size.astype(np.int64)), *listed], ["d", "k", "node", "n_shingles", "bands", "sketch"])
                at += len(size)

    return docs.select("d", "k", "text").mapInArrow(tidy(run), "d long, k long, node binary, n_shingles long, bands array<long>, sketch array<long>")


def _overlaps(pairs: DataFrame) -> DataFrame:
    """a, b of the pairs (a, b, text_a, text_b) that are similar enough on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .kernels import shingle_sets

        for batch in (whole.slice(at, PAIRS) for whole in batches for at in range(0, whole.num_rows, PAIRS)):
            sets = []
            for side in ("text_a", "text_b"):
                got = []
                for _, h, bounds in shingle_sets(batch.column(side), SHINGLE):
                    got += [h[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                sets.append(got)
            good = []
            for x, y in zip(*sets, strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(tidy(run), "a binary, b binary")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b, of node keys) that are links by their full sets."""
    t = texts.select("node", "text")
    with_a = pairs.join(t.withColumnsRenamed({"node": "a", "text": "text_a"}), "a")
    return _overlaps(with_a.join(t.withColumnsRenamed({"node": "b", "text": "text_b"}), "b").select("a", "b", "text_a", "text_b"))


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """d (a null id: less than all), k (of id and text) and text."""
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("d"), row_key(F.col(doc_id), F.col(text)).alias("k"), F.col(text).alias("text"))


def fine_sketches(texts: DataFrame) -> DataFrame:
    """node, fine (array of long) of texts (node, text) with shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .kernels import shingle_sets

        for batch in batches:
            for first, h, bounds in shingle_sets(batch.column("text"), SHINGLE):
                full = np.flatnonzero(np.diff(bounds) > 0)
                for at in range(0, len(full), 32):  # the samples of a text take 32 KB
                    part = full[at : at + 32]
                    lo, hi = bounds[part[0]], bounds[part[-1] + 1]
                    inside = bounds[part[0] : part[-1] + 2] - lo
                    words = odd_sketches(min_hashes(h[lo:hi], inside, FINE_SAMPLES), FINE_BITS)
                    fine = pa.FixedSizeListArray.from_arrays(pa.array(words.ravel()), FINE_BITS // 64).cast(pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(first + part)), fine], ["node", "fine"])

    return texts.select("node", "text").mapInArrow(tidy(run), "node binary, fine array<long>")


def spanning(left: np.ndarray, right: np.ndarray, alike: np.ndarray) -> list[int]:
    """Of edges between numbered components: those that join two trees, the likeliest first."""
    tree: dict[int, int] = {}

    def top(n: int) -> int:
        while (up := tree.get(n, n)) != n:
            tree[n] = n = tree.get(up, up)
        return n

    out, order = [], np.argsort(-alike, kind="stable")
    for k, x, y in zip(order.tolist(), left[order].tolist(), right[order].tolist(), strict=True):
        if (a := top(x)) != (b := top(y)):
            tree[a] = b
            out.append(k)
    return out


def near_in_buckets(rows: DataFrame, forest: bool = False) -> DataFrame:
    """a, b: nodes of different components that share a bucket and whose finer sketches are near enough, each pair in the first of its buckets only.

    forest: of all these only the likeliest that, were they links, would join the components of two parts: fewer than there are rows.

    rows: band, fa, fb (a part of the bucket's nodes outside its largest component, and a part of all its nodes), outside
    (whether the row is of the first part), node, root, bands, fine. A part has about PART nodes, so a task holds two
    parts, whatever the bucket's size, and only near pairs leave it.
    """

    def compare(key: int, group: pa.RecordBatch) -> tuple[list[bytes], list[bytes]]:
        flags = group.column("outside").to_numpy(zero_copy_only=False)
        nodes, roots = (np.array(group.column(c).to_pylist(), "V16") for c in ("node", "root"))
        _, root = np.unique(roots, return_inverse=True)
        _, name = np.unique(nodes, return_inverse=True)  # by their bytes, so of one order in all groups
        bands = group.column("bands").flatten().to_numpy().reshape(-1, BANDS)
        fine = group.column("fine").flatten().to_numpy().reshape(-1, FINE_BITS // 64)
        top = group.column("top").to_numpy(zero_copy_only=False)
        own, others = np.flatnonzero(flags), np.flatnonzero(~flags)
        if not len(own) or not len(others):
            return [], []
        place = int(np.flatnonzero(bands[own[0]] == key)[0])
        earlier, at, their = bands[others, :place], root[others], fine[others]
        a, b, likely = [], [], []
        for x in own:
            # both outside the largest component: the pair is met twice, and taken once
            ok = (at != root[x]) & (top[others] | (name[others] > name[x]))
            ok &= ~(earlier == bands[x, :place]).any(1)
            cand = np.flatnonzero(ok)
            if len(cand):
                differ = np.bitwise_count(their[cand].view(np.uint64) ^ fine[x].view(np.uint64)).sum(1)
                with np.errstate(invalid="ignore", divide="ignore"):
                    alike = 1 + FINE_BITS / (4.0 * FINE_SAMPLES) * np.log(np.maximum(1e-9, 1 - 2.0 * differ / FINE_BITS))
                near = np.flatnonzero(alike >= FINE_LEAST)
                near = near[np.lexsort((-alike[near], at[cand[near]]))]  # by component, the likeliest first
                theirs_ = at[cand[near]]
                head = np.r_[True, theirs_[1:] != theirs_[:-1]] if len(near) else np.zeros(0, bool)
                sure = (alike[near] >= SURE)[np.flatnonzero(head)][np.cumsum(head) - 1]
                near = near[head if forest else head | ~sure]
                a.append(np.full(len(near), x))
                b.append(others[cand[near]])
                likely.append(alike[near])
        if not a:
            return [], []
        a, b, likely = (np.concatenate(v) for v in (a, b, likely))
        if forest:
            at = spanning(root[a], root[b], likely)
            a, b = a[at], b[at]
        return [v.tobytes() for v in nodes[a]], [v.tobytes() for v in nodes[b]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = compare(last[0], pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held.clear()
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("band", "fa", "fb")), strict=True))
            start = 0
            for i, key in enumerate(keys):
                if key != last:
                    if i > start:
                        held.append(batch.slice(start, i - start))
                    yield from flush()
                    last, start = key, i
            if start < len(keys):
                held.append(batch.slice(start))
        yield from flush()

    return rows.mapInArrow(tidy(run), "a binary, b binary")


class Groups:
    """The steps of one grouping."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str):
        self.rows = keyed(docs, doc_id, text)
        self.seen = cut(prints(self.rows), "prints")
        full = self.seen.filter("n_shingles > 0")
        #: One row a node: `at` tells the document that its text is read from, `least` the smallest id.
        self.nodes = cut(full.groupBy("node").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min(F.struct("d", "k")).alias("at"), F.min(F.when(F.col("d") != NO_ID, F.col("d"))).alias("least")), "nodes")
        self.sketches = self.nodes.select("node", "sketch")

    def buckets(self) -> DataFrame:
        """band, node of all buckets with two nodes or more; only the bands' hashes, and these buckets' rows, are shuffled."""
        banded = self.nodes.select("node", F.explode("bands").alias("band"))
        shared = cut(banded.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band"), "shared")
        n = blocks_for(shared.count())
        return cut(possible(banded, bloom(shared, "band", n), "band", n).join(shared, "band"), "bands")

    def texts(self, nodes: DataFrame) -> DataFrame:
        """node, text of these nodes. A Bloom filter leaves out most other texts before the shuffle."""
        asked = cut(self.nodes.join(nodes, "node", "left_semi").select("node", "at.d", "at.k"), "asked")
        n = blocks_for(asked.count())
        found = possible(self.rows, bloom(asked, "k", n), "k", n).groupBy("d", "k").agg(F.first("text").alias("text"))
        return cut(found.join(asked, ["d", "k"]).select("node", "text"), "texts")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """a, b, alike: the pairs (a, b) whose sketches are near enough."""
        with_a = pairs.join(self.sketches.withColumnsRenamed({"node": "a", "sketch": "sa"}), "a")
        with_b = with_a.join(self.sketches.withColumnsRenamed({"node": "b", "sketch": "sb"}), "b")
        return with_b.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("alike")).filter(F.col("alike") >= SKETCH_LEAST)

    def links(self, pairs: DataFrame, texts: DataFrame, known: bool = False) -> DataFrame:
        """Of candidate pairs (a, b): those that are links, by sketches first (unless known to be near), then by full sets."""
        likely = cut(pairs if known else self.likely(pairs).select("a", "b"), "pairs")
        return cut(verified(likely, texts), "links")

    def components(self) -> DataFrame:
        """node, root of all linked nodes."""
        banded = self.buckets()
        texts = self.texts(banded.select("node").distinct())
        leaders = banded.groupBy("band").agg(F.min("node").alias("leader"))
        star = banded.join(leaders, "band").filter("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("n"))
        links = self.links(star.groupBy(F.col("node").alias("a")).agg(F.max_by("leader", F.struct("n", "leader")).alias("b")), texts)
        roots = cut(graph.components(links), "roots")
        fine = None
        for forest in (True, False):  # most links come from few pairs; the others are then of components that stay apart
            mixed = self.mixed(banded, roots)
            if mixed.isEmpty():
                break
            if fine is None:  # buckets that hold several components are fewer each time
                theirs = cut(mixed.select("node").distinct(), "theirs")
                fine = cut(fine_sketches(texts.join(theirs, "node", "left_semi")), "fine")
            more = self.links(near_in_buckets(self.parts(mixed, fine), forest), texts, True)
            if not more.isEmpty():
                links = links.union(more)
                roots = cut(graph.components(links), "roots")
        return roots

    def parts(self, mixed: DataFrame, fine: DataFrame) -> DataFrame:
        """The rows of `near_in_buckets`, one bucket's pair of parts after the other."""
        parts = mixed.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("nb"), F.ceil(F.count_if(F.col("root") != F.col("top")) / PART).cast("int").alias("na"))
        rows = mixed.join(parts, "band").withColumn("top", F.col("root") == F.col("top"))
        dealt = lambda n: F.pmod(F.hash("node"), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        outside = rows.filter("NOT top").select("band", dealt("na").alias("fa"), every("nb").alias("fb"), F.lit(True).alias("outside"), "top", "node", "root")
        all_ = rows.select("band", every("na").alias("fa"), dealt("nb").alias("fb"), F.lit(False).alias("outside"), "top", "node", "root")
        both = outside.union(all_).join(self.nodes.select("node", "bands"), "node").join(fine, "node")
        return both.repartition("band", "fa", "fb").sortWithinPartitions("band", "fa", "fb").select("band", "fa", "fb", "outside", "top", "node", "root", "bands", "fine")

    def mixed(self, banded: DataFrame, roots: DataFrame) -> DataFrame:
        """band, node, root, top (the root of the bucket's largest component) of the buckets that hold several components."""
        known = banded.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
        sizes = known.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
        tops = sizes.groupBy("band").agg(F.max_by("root", F.struct("n", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).filter("roots > 1").select("band", "top")
        return cut(known.join(tops, "band"), "mixed")

    def members(self) -> DataFrame:
        """d, k, doc_id, n_shingles, component_id and kept of every row."""
        of_node = self.nodes.select("node", "least").join(self.components(), "node", "left").withColumn("root", F.coalesce("root", "node"))
        least = of_node.groupBy("root").agg(F.min("least").alias("component"))
        found = of_node.join(least, "root").select("node", "component")
        own = F.when(F.col("d") != NO_ID, F.col("d"))
        out = self.seen.select("d", "k", "node", "n_shingles").join(found, "node", "left").withColumn("doc_id", own)
        out = out.select("d", "k", "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(own).alias("component_id"))
        return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable) and kept."""
    return Groups(docs, doc_id, text).members().select("doc_id", "n_shingles", "component_id", "kept")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with their own columns, of which the smallest doc_id of each group stays. Rows equal in id and text are that one document, told apart by nothing, and stay together."""
    gone = cut(Groups(docs, doc_id, text).members().filter("NOT kept").select(F.col("d").alias("__gl_d"), F.col("k").alias("__gl_k")).distinct(), "gone")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__gl_row"), F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("__gl_id"), row_key(F.col(doc_id), F.col(text)).alias("__gl_key"))
    # a Bloom filter of what goes: all other texts pass without a shuffle
    n = blocks_for(gone.count())
    seen = marked(packed, bloom(gone, "__gl_k", n), "__gl_key", n)
    unsure = seen.filter("__gl_may").join(gone, (F.col("__gl_id") == F.col("__gl_d")) & (F.col("__gl_key") == F.col("__gl_k")), "left_anti")
    return seen.filter("NOT __gl_may").select("__gl_row.*").union(unsure.select("__gl_row.*"))

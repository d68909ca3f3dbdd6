"""Line dedup by pairwise alignment: overlapping documents are found through shared rare lines, aligned by patience
diff, and the aligned common blocks are deleted from the later document (the larger doc_id).

Keys that make documents meet are windows: from each line on, and up to each line, the fewest lines in a row with
MIN_CHARS characters or more and a word. The windows of a common block cover it, so documents with a common block share
a key, and blank lines within a block don't part it. How many documents hold a key is counted. First the later holders
of rare keys (RARE holders at most) are aligned with the key's first holder. Where lines of a shared window are left
after that, their holders are aligned with the first holder of that window, however common it is, and then with more and
more of its earlier holders (GROWTH times as many a round) until none is left or all were tried. So pairs grow with the
lines where the first holder settles a key, a passage that very many documents share costs pairs only where no rarer
line has settled it, and the result is that of aligning every two documents. A common block is a run of lines, aligned
one to one, of MIN_CHARS characters in all or more; what is in no such block stays. Blocks are judged on the input
texts, and all pairs' deletions add up.

Defined cases: null and empty texts have no lines and stay as they are; lines without a word make no key by
themselves; rows equal in id and text are one document and share a result; a null doc_id comes before all others;
an empty table gives an empty one; `dedup` keeps all columns of the documents. Texts are aligned whole.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, cut, row_key, tidy
from .url_filter import blocks_for, bloom, marked, possible

MIN_CHARS = 100
#: Holders of a key that is rare: documents first meet by these.
RARE = 64
GROWTH = 8
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


def windows(h: np.ndarray, n: np.ndarray, w: np.ndarray, least: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First lines, lines after the last, and keys of a text's windows; h: hashes, n: characters, w: has a word, of its lines."""
    chars, worded = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(w)]
    at = np.arange(len(n))
    # from each line on, and up to each line
    a = np.r_[at, np.minimum(np.searchsorted(chars, chars[1:] - least, "right"), np.searchsorted(worded, worded[1:] - 1, "right")) - 1]
    b = np.r_[np.maximum(np.searchsorted(chars, chars[:-1] + least), np.searchsorted(worded, worded[:-1] + 1)), at + 1]
    ok = (a >= 0) & (b <= len(n))
    a, b = np.divmod(np.unique(a[ok] * (len(n) + 1) + b[ok]), len(n) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(h.view(np.uint64) * _powers(_BACK, len(h))[:-1])]
    return a, b, ((sums[b] - sums[a]) * _powers(_ODD, len(h))[a] + (b - a).astype(np.uint64)).view(np.int64)


def _weights(a: list[int], b: list[int], sizes: list[int]) -> np.ndarray:
    """Greatest sizes of common subsequences of a and each beginning of b."""
    b, sizes = np.array(b, np.int64), np.array(sizes, np.int64)
    best = np.zeros(len(b) + 1, np.int64)
    for x in a:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], best[:-1] + np.where(b == x, sizes, 0)))
    return best


def heaviest(a: list[int], b: list[int], sizes: list[int]) -> list[tuple[int, int]]:
    """A common subsequence with the most characters, as pairs of places, ascending; in memory that grows with the lines."""
    number = {x: n for n, x in enumerate(set(a) & set(b))}
    ia, ib = [i for i, x in enumerate(a) if x in number], [j for j, x in enumerate(b) if x in number]
    a, b, sizes = [number[a[i]] for i in ia], [number[b[j]] for j in ib], [sizes[j] for j in ib]
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 >= a1 or b0 >= b1:
            continue
        if a1 - a0 == 1:
            same = [j for j in range(b0, b1) if b[j] == a[a0]]
            out += [(ia[a0], ib[same[0]])] if same else []
            continue
        mid = (a0 + a1) // 2
        left = _weights(a[a0:mid], b[b0:b1], sizes[b0:b1])
        right = _weights(a[mid:a1][::-1], b[b0:b1][::-1], sizes[b0:b1][::-1])[::-1]
        j = b0 + int((left + right).argmax())
        todo += [(a0, mid, b0, j), (mid, a1, j, b1)]
    return sorted(out)


def aligned(a: list[int], b: list[int], sizes: list[int] | None = None) -> list[tuple[int, int]]:
    """Patience diff: pairs of places of equal lines, ascending in both; lines unique in both stretches are the anchors, and a stretch without one gets its heaviest common subsequence (sizes: of b's lines; 1 each by default)."""
    sizes = [1] * len(b) if sizes is None else [max(1, x) for x in sizes]
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        na, nb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {b[j]: j for j in range(b0, b1)}
        both = [(i, where[a[i]]) for i in range(a0, a1) if na[a[i]] == 1 == nb.get(a[i], 0)]
        # the longest run of anchors that ascends in b, by patience sorting
        tops: list[int] = []
        last: list[int] = []
        before = [-1] * len(both)
        for n, (_, j) in enumerate(both):
            pile = bisect_left(tops, j)
            before[n] = last[pile - 1] if pile else -1
            if pile == len(tops):
                tops.append(j)
                last.append(n)
            else:
                tops[pile], last[pile] = j, n
        chain = []
        n = last[-1] if last else -1
        while n >= 0:
            chain.append(both[n])
            n = before[n]
        if not chain:
            out += [(a0 + i, b0 + j) for i, j in heaviest(a[a0:a1], b[b0:b1], sizes[b0:b1])]
            continue
        edges = [(a0 - 1, b0 - 1), *reversed(chain), (a1, b1)]
        out += chain
        todo += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def blocks(a: list[int], b: list[int], sizes: list[int], least: int = MIN_CHARS) -> list[int]:
    """Places of the lines of b in common blocks of `least` characters or more; sizes: characters of b's lines."""
    found: list[int] = []
    run: list[int] = []
    last = (-2, -2)
    for i, j in [*aligned(a, b, sizes), (-9, -9)]:
        if (i, j) != (last[0] + 1, last[1] + 1):
            if sum(sizes[x] for x in run) >= least:
                found += run
            run = []
        run.append(j)
        last = i, j
    return found


def _arrays(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes, characters and has-a-word flags of each row's lines."""
    for h, n, w in zip(batch.column("h"), batch.column("n"), batch.column("w"), strict=True):
        yield h.values.to_numpy(), n.values.to_numpy().astype(np.int64), w.values.to_numpy(zero_copy_only=False).astype(np.int64)


def deletions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_CHARS) -> DataFrame:
    """d, k (the document) and gone (array of line numbers from 0) of each document that loses lines."""
    d = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    split = F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)
    # the line hashes are a small part of the texts; one row for equal rows
    lines = docs.select(d.alias("d"), row_key(F.col(doc_id), F.col(text)).alias("k"), F.transform(split, lambda x: F.xxhash64(x)).alias("h"), F.transform(split, lambda x: F.length(x)).alias("n"), F.transform(split, lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0).alias("w"))
    lines = cut(lines.groupBy("d", "k").agg(F.first("h").alias("h"), F.first("n").alias("n"), F.first("w").alias("w")), "lines")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.unique(windows(h, n, w, least)[2]) for h, n, w in _arrays(batch)]
            rows = pa.array(np.repeat(np.arange(len(got)), [len(x) for x in got]))
            yield pa.RecordBatch.from_arrays([batch.column("d").take(rows), batch.column("k").take(rows), pa.array(np.concatenate([np.zeros(0, np.int64), *got]))], ["d", "k", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = [blocks(a.as_py(), b.as_py(), n.as_py(), least) for a, b, n in zip(batch.column("ah"), batch.column("h"), batch.column("n"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("k"), pa.array(gone, pa.list_(pa.int32()))], ["d", "k", "gone"]).filter(pa.array([bool(g) for g in gone], pa.bool_()))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for (h, n, w), keys, gone in zip(_arrays(batch), batch.column("keys").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                stays = np.ones(len(h), np.int64)
                stays[np.array(gone or [], np.int64)] = 0
                stays = np.r_[0, np.cumsum(stays)]
                a, b, key = windows(h, n, w, least)
                got.append(np.intersect1d(key[stays[b] > stays[a]], np.array(keys, np.int64)))
            rows = pa.array(np.repeat(np.arange(len(got)), [len(x) for x in got]))
            yield pa.RecordBatch.from_arrays([batch.column("d").take(rows), batch.column("k").take(rows), pa.array(np.concatenate([np.zeros(0, np.int64), *got]))], ["d", "k", "key"])

    earlier = lines.select(F.col("d").alias("ad"), F.col("k").alias("ak"), F.col("h").alias("ah"))
    own = lines.select("d", "k", "h", "n", "w")
    kind = "d long, k long, key long"
    holders = cut(own.mapInArrow(tidy(keyed), kind), "holders")
    shared = holders.groupBy("key").agg(F.min(F.struct("d", "k")).alias("a"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = cut(shared, "shared")
    n_keys = blocks_for(shared.count())
    holders = cut(possible(holders, bloom(shared, "key", n_keys), "key", n_keys).join(shared.select("key"), "key", "left_semi"), "holders")
    # rare keys first; then, of what stands, every key with its first holder; then with more and more of them
    standing, lost, tried, buckets, first = holders, None, None, 0, shared
    while True:
        if buckets > 1:
            # any order of earlier holders serves; a bucket's first one is met each round, and in the end each is alone
            bucket = F.pmod(F.xxhash64("d", "k"), F.lit(buckets)) if buckets < 1 << 40 else F.struct("d", "k")
            first = holders.groupBy("key", bucket.alias("bucket")).agg(F.min(F.struct("d", "k")).alias("a"), F.count(F.lit(1)).alias("c"))
        asked = standing.join(first, "key").filter(F.col("a") < F.struct("d", "k")).select(F.col("a.d").alias("ad"), F.col("a.k").alias("ak"), "d", "k", "key", "c")
        asked = cut(asked, "asked")
        met = asked.filter(F.col("c") <= RARE) if buckets == 0 else asked
        pairs = met.select("ad", "ak", "d", "k").distinct()
        pairs = pairs if tried is None else pairs.join(tried, ["ad", "ak", "d", "k"], "left_anti")
        pairs = cut(pairs, "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        both = pairs.join(earlier, ["ad", "ak"]).join(own, ["d", "k"]).select("d", "k", "ah", "h", "n")
        found = both.mapInArrow(tidy(run), "d long, k long, gone array<int>")
        found = found if lost is None else found.union(lost)
        lost = cut(found.select("d", "k", F.explode("gone").alias("line")).groupBy("d", "k").agg(F.collect_set("line").alias("gone")), "lost")
        asked = asked.groupBy("d", "k").agg(F.collect_set("key").alias("keys"))
        standing = cut(asked.join(own, ["d", "k"]).join(lost, ["d", "k"], "left").select("d", "k", "h", "n", "w", "keys", "gone").mapInArrow(tidy(left), kind), "standing")
        if standing.isEmpty() or buckets >= 1 << 40:
            break
        # only the keys that are still asked for; once each holder has its bucket, all were tried
        holders = cut(holders.join(standing.select("key").distinct(), "key", "left_semi"), "holders")
        if buckets > 1 and first.join(standing.select("key").distinct(), "key", "left_semi").filter("c > 1").isEmpty():
            break
        buckets = buckets * GROWTH if buckets else 1
    return lost.select("d", "k", F.sort_array("gone").alias("gone"))


def _joined(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row, t (the text), gone (null: nothing): texts that lose nothing, but for a few that a Bloom filter passes, aren't shuffled."""
    d = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), d.alias("d"), row_key(F.col(doc_id), F.col(text)).alias("k"), F.col(text).alias("t"))
    gone = cut(deletions(docs, doc_id, text), "gone")
    n = blocks_for(gone.count())
    seen = marked(packed, bloom(gone, "k", n), "k", n)
    whole = seen.filter("NOT __gl_may").select("row", "t", F.lit(None).cast("array<int>").alias("gone"))
    return whole.union(seen.filter("__gl_may").join(gone.hint("merge"), ["d", "k"], "left").select("row", "t", "gone"))  # a hint: the plan is the same at any size


def _kept_text():
    numbers = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    rest = F.transform(F.array(F.split("t", "\n", -1)), lambda lines: F.array_join(F.transform(numbers(lines), lambda i: lines[i]), "\n"))[0]
    return F.when(F.col("gone").isNull(), F.col("t")).otherwise(rest)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_lines, n_removed, kept_sha256 and the text that is left."""
    out = _joined(docs, doc_id, text).select(F.col(f"row.{doc_id}").alias("doc_id"), F.size(F.split(F.coalesce("t", F.lit("")), "\n", -1)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce(_kept_text(), F.lit("")).alias("kept_text"))
    return out.select("doc_id", "n_lines", F.greatest("n_removed", F.lit(0)).alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"), "kept_text")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their own columns and what is left of their texts; one that is left without a word goes (it is wholly in earlier ones), and n_chars, where there is such a column, is counted anew."""
    cols = []
    for c in docs.columns:
        if c == text:
            cols.append(F.col("left_text").alias(c))
        elif c == "n_chars":
            cols.append(F.when(F.col("gone").isNull(), F.col("row.n_chars")).otherwise(F.length("left_text")).cast(docs.schema[c].dataType).alias(c))
        else:
            cols.append(F.col(f"row.`{c}`"))
    left = _joined(docs, doc_id, text).withColumn("left_text", _kept_text())
    return left.filter(F.col("gone").isNull() | (F.length(F.btrim("left_text", F.lit(BLANKS))) > 0)).select(*cols)

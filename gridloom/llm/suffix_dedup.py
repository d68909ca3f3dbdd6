"""Suffix-array dedup: removes every byte covered by a 200-byte string that starts anywhere else too.

A suffix array of all texts would be one sequential task, so the strings are dealt to shards by content. Of each
200-byte string the 24-byte gram of smallest hash is its anchor; equal strings have equal anchors at equal places. The
starts that share an anchor's place make a context (the bytes of all their strings). A first pass only counts anchors:
contexts whose anchor occurs once hold no repeat. A second one keeps the others (behind a Bloom filter of bounded size).
They go, by anchor, to shards, each distinct context once, with its number of copies; each shard's suffix array is built
by induced sorting, and permuted common prefixes of 200 bytes or more, or the copies, mark starts, which go back to all
documents with that context. Contexts are told apart by 64-bit hashes of their anchor and of their bytes. Texts are
shuffled only of documents that stand for a context, and at the end of those that lose bytes.

An anchor with more than HOT_CONTEXTS distinct contexts (a passage in very many documents, with other text around it) is
split: its contexts are cut into SPLITS starts, keyed by all bytes that these strings share, then into single strings.
Equal strings always meet under one key, so nothing is lost, and no key keeps many different contexts.

Defined cases: a null text is empty; texts under 200 bytes lose nothing; matches never cross documents; rows equal in id
and text are two documents; a null doc_id is an id like any other; an empty table gives an empty one; other columns are
ignored. Texts are taken whole, in stretches of STRETCH starts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, cut, row_key, tidy
from .url_filter import blocks_for, bloom, marked, possible

WIDTH = 200
GRAM = 24
STRETCH = 1 << 19
#: Bits of a place in a block of texts or a stretch.
PLACE_BITS = 20
HOT_CONTEXTS = 4096
SPLITS = (16, 1)
#: Bytes of contexts in one suffix array, and the byte between them, which UTF-8 never has.
SHARD_BYTES = 1 << 20
#: Contexts handed on at a time.
ROWS_OUT = 4096
BETWEEN = 255
_NO_ID = -(1 << 63)
OCCURRENCES = "d long, k long, lo int, hi int, anchor int, g long, c long"


class Rolling:
    """Hashes of any substrings of some bytes."""

    def __init__(self, data: np.ndarray):
        from . import kernels as K

        n = len(data)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(K._SYMBOLS[data] * K._table(K._BASE, n), out=self.total[1:])
        self.back = K._table(pow(K._BASE, -1, 1 << 64), n + 1)
        self.mix = K.mix

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.mix((self.total[b] - self.total[a]) * self.back[a] + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sliding_least(v: np.ndarray, w: int) -> np.ndarray:
    """Minima of all w values in a row: of the prefixes and the suffixes of pieces of w."""
    n = len(v)
    pad = -n % w
    x = np.r_[v, np.full(pad, np.iinfo(v.dtype).max, v.dtype)].reshape(-1, w)
    left = np.minimum.accumulate(x, axis=1).ravel()
    right = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def contexts(data: np.ndarray, off: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of several texts' bytes: text number, first and last start (in the data), anchor place, anchor hash, hash of the context's bytes."""
    n = len(data)
    if n < width:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    h = Rolling(data)
    at = np.arange(n - gram + 1)
    grams = h(at, at + gram)
    bits = np.uint64(max(PLACE_BITS, (n - 1).bit_length()))  # the same for all blocks, so that equal strings have equal anchors
    least = sliding_least((grams >> bits << bits) | at.astype(np.uint64), width - gram + 1)
    anchor = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(anchor)]
    good = np.arange(len(anchor)) + width <= off[text + 1]
    cutting = np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (good[1:] != good[:-1])]
    lo = np.flatnonzero(cutting)
    hi = np.r_[lo[1:], len(anchor)] - 1
    keep = good[lo]
    lo, hi = lo[keep], hi[keep]
    a = anchor[lo]
    return text[lo], lo, hi, a, grams[a], h(lo, hi + width)


def _stretches(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, offset in its text, bytes, offsets): blocks of texts, or overlapping stretches of a long one."""
    from .kernels import blocks

    for first, data, off in blocks(column):
        if len(off) == 2 and len(data) > STRETCH + WIDTH:
            for s in range(0, len(data) - WIDTH + 1, STRETCH):
                part = data[s : s + STRETCH + WIDTH - 1]
                yield first, s, part, np.array([0, len(part)])
        else:
            yield first, 0, data, off


def occurrences(docs: DataFrame) -> DataFrame:
    """Contexts of all texts; docs: d, k, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, k = batch.column("d").to_numpy(), batch.column("k").to_numpy()
            for first, shift, data, off in _stretches(batch.column("text")):
                text, lo, hi, a, g, c = contexts(data, off)
                base = off[text] - shift
                cols = [d[first + text], k[first + text], (lo - base).astype(np.int32), (hi - base).astype(np.int32), (a - base).astype(np.int32), g.view(np.int64), c.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["d", "k", "lo", "hi", "anchor", "g", "c"])

    return docs.mapInArrow(tidy(run), OCCURRENCES)


def anchors(docs: DataFrame) -> DataFrame:
    """g of the anchors that two contexts or more have, of all texts; only hashes and counts are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, off in _stretches(batch.column("text")):
                g, n = np.unique(contexts(data, off)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int32))], ["g", "n"])

    return docs.select("text").mapInArrow(tidy(run), "g long, n int").groupBy("g").agg(F.sum("n").alias("n")).filter("n > 1").select("g")


def _behind_filter(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among the keys, and few others: by a Bloom filter of bounded size, without a shuffle."""
    n = blocks_for(keys.count())
    return possible(rows, bloom(keys, key, n), key, n)


def _with_text(rows: DataFrame, docs: DataFrame, fields: list[str]) -> DataFrame:
    """The rows of each document in one list (no longer than its text) beside the text; other texts aren't shuffled."""
    listed = cut(rows.groupBy("d", "k").agg(F.collect_set(F.struct(*fields)).alias("rows")), "listed")
    return listed.join(_behind_filter(docs, listed, "k").dropDuplicates(["d", "k"]), ["d", "k"])


def _lists(batch: pa.RecordBatch, fields: list[str]) -> Iterator[tuple[int, np.ndarray, dict[str, np.ndarray]]]:
    rows = batch.column("rows")
    for i, text in enumerate(batch.column("text").cast(pa.binary())):
        part = rows[i].values
        yield i, np.frombuffer(text.as_py() or b"", np.uint8), {f: part.field(f).to_numpy() for f in fields}


def split(occ: DataFrame, docs: DataFrame, starts: int) -> DataFrame:
    """The occurrences cut into stretches of `starts` starts by their distance to the anchor, keyed by the bytes that these strings share."""
    fields = ["lo", "hi", "anchor", "g"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .kernels import mix

        for batch in batches:
            d, k = batch.column("d").to_numpy(), batch.column("k").to_numpy()
            for i, data, r in _lists(batch, fields):
                size = (r["hi"] - r["lo"] + 1).astype(np.int64)
                row = np.repeat(np.arange(len(size)), size)
                p = np.arange(size.sum()) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size) + r["lo"][row]
                far = (r["anchor"][row] - p) // starts
                edge = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (far[1:] != far[:-1])])
                lo, hi = p[edge], p[np.r_[edge[1:], len(p)] - 1]
                row, far = row[edge], far[edge]
                # all strings whose start is far * starts to (far + 1) * starts - 1 before the anchor share these bytes
                a = r["anchor"][row].astype(np.int64)
                b0, b1 = a - far * starts, a - (far + 1) * starts + 1 + WIDTH
                h = Rolling(data)
                g = mix(h(b0, b1) ^ mix(r["g"][row].view(np.uint64) + far.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))
                cols = [np.full(len(lo), d[i]), np.full(len(lo), k[i]), lo.astype(np.int32), hi.astype(np.int32), a.astype(np.int32), g.view(np.int64), h(lo, hi + WIDTH).view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["d", "k", "lo", "hi", "anchor", "g", "c"])

    return _with_text(occ, docs, fields).select("d", "k", "rows", "text").mapInArrow(tidy(run), OCCURRENCES)


def segments(reps: DataFrame, docs: DataFrame) -> DataFrame:
    """g, c, n and the bytes of each distinct context; reps: d, k, lo, hi, g, c, n."""
    fields = ["lo", "hi", "g", "c", "n"]

    def packed(held: list) -> pa.RecordBatch:
        cols = [pa.array(np.concatenate([r[f] for r, _ in held])) for f in ("g", "c", "n")]
        return pa.RecordBatch.from_arrays([*cols, pa.array([x for _, seg in held for x in seg], pa.binary())], ["g", "c", "n", "seg"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for _, data, r in _lists(batch, fields):
                raw = data.tobytes()
                held.append((r, [raw[lo : hi + WIDTH] for lo, hi in zip(r["lo"].tolist(), r["hi"].tolist(), strict=True)]))
                n += len(r["lo"])
                if n >= ROWS_OUT:
                    yield packed(held)
                    held, n = [], 0
        if held:
            yield packed(held)

    return _with_text(reps, docs, fields).select("d", "k", "rows", "text").mapInArrow(tidy(run), "g long, c long, n long, seg binary")


def repeats(segs: list[bytes], copies: list[int], width: int = WIDTH) -> list[np.ndarray]:
    """For each context, which of its starts repeat: by the suffix array of all of them. A context of two copies or more stands once, for all: each of its starts is that of several equal strings."""
    from .suffix_arrays import permuted_lcp, suffix_array

    data = np.frombuffer(bytes([BETWEEN]).join(segs), np.uint8)
    sa = suffix_array(data)
    long = permuted_lcp(data, sa) >= width
    marked = long.copy()
    marked[sa[:-1][long[sa[1:]]]] = True
    out, at = [], 0
    for s, n in zip(segs, copies, strict=True):
        own = marked[at : at + len(s) - width + 1]  # later starts reach into the next context
        out.append(np.arange(len(own)) if n > 1 else np.flatnonzero(own))
        at += len(s) + 1
    return out


def marks(segs: DataFrame, width: int = WIDTH) -> DataFrame:
    """g, c, a, b: stretches of starts (a to b, counted from the context's first) that repeat; one shard for each partition."""

    def shard(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        g, c, lo, hi = [], [], [], []
        for row, found in zip(rows, repeats([r[3] for r in rows], [r[2] for r in rows], width), strict=True):
            if len(found):
                edge = np.flatnonzero(np.r_[True, np.diff(found) > 1])
                lo += found[edge].tolist()
                hi += found[np.r_[edge[1:], len(found)] - 1].tolist()
                g += [row[0]] * len(edge)
                c += [row[1]] * len(edge)
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(c, pa.int64()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())], ["g", "c", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, bytes]] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(f).to_pylist() for f in ("g", "c", "n", "seg")), strict=True):
                if size > SHARD_BYTES and row[0] != rows[-1][0]:  # all contexts of an anchor stay together
                    yield shard(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
        if rows:
            yield shard(rows)

    return segs.repartition("g").sortWithinPartitions("g").select("g", "c", "n", "seg").mapInArrow(tidy(run), "g long, c long, a int, b int")


def _level(occ: DataFrame, docs: DataFrame, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """(d, k, lo, hi of repeated starts; the occurrences of anchors with too many contexts, null if there are none)."""
    distinct = cut(occ.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("d", "k", "lo", "hi")).alias("at")), "contexts")
    sizes = distinct.groupBy("g").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("holders"))
    calm, hot = distinct, None
    if not last:
        many = cut(sizes.filter(F.col("kinds") > HOT_CONTEXTS).select("g"), "hot")
        if not many.isEmpty():
            # crowded anchors, and the few that the filter takes for one, leave before any shuffle by g
            n = blocks_for(many.count())
            filt = bloom(many, "g", n)
            calm = marked(distinct, filt, "g", n).filter("NOT __gl_may").drop("__gl_may")
            hot = possible(occ, filt, "g", n)
    several = calm.groupBy("g").agg(F.sum("n").alias("holders")).filter("holders > 1").select("g")
    reps = cut(calm.join(several, "g", "left_semi").select("at.*", "g", "c", "n"), "reps")
    found = cut(marks(segments(reps, docs)), "marks")
    # a join, so that contexts that very many documents hold are dealt out
    return occ.join(found, ["g", "c"]).select("d", "k", (F.col("lo") + F.col("a")).alias("lo"), (F.col("lo") + F.col("b")).alias("hi")), hot


def removed(docs: DataFrame) -> DataFrame:
    """d, k, lo, hi: stretches of starts whose 200-byte strings are elsewhere too; docs: d, k, text."""
    docs = docs.filter(F.length("text") > 0)
    seen = cut(anchors(docs), "anchors")
    out, occ = None, cut(_behind_filter(occurrences(docs), seen, "g"), "occurrences")
    for n in range(len(SPLITS) + 1):
        found, hot = _level(occ, docs, n == len(SPLITS))
        out = found if out is None else out.union(found)
        if hot is None:
            break
        occ = cut(split(hot, docs, SPLITS[n]), "split")
    return out


def strip(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_kept: bool = True) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary: the bytes that stay)."""
    ids = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("d"), row_key(F.col(doc_id), F.col(text)).alias("k"), F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    gone = cut(removed(ids.select("d", "k", "text")).groupBy("d", "k").agg(F.collect_set(F.struct("lo", "hi")).alias("gone")), "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, n, spans, sha, kept = [], [], [], [], []
            for text, gone in zip(batch.column("text"), batch.column("gone"), strict=True):
                raw = text.as_py()
                out = []
                n.append(0)
                spans.append(0)
                last = -1
                for lo, hi in sorted((x["lo"], x["hi"]) for x in gone.as_py() or ()):
                    if lo > last:  # a run of its own: what stands between stays
                        out.append(raw[max(last, 0) : lo])
                        spans[-1] += 1
                        n[-1] += hi + WIDTH - lo
                    else:
                        n[-1] += max(0, hi + WIDTH - last)
                    last = max(last, hi + WIDTH)
                out.append(raw[max(last, 0) :])
                left = b"".join(out)
                size.append(len(raw))
                sha.append(hashlib.sha256(left).hexdigest())
                if with_kept:
                    kept.append(left)
            cols = [batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), *([pa.array(kept, pa.binary())] if with_kept else [])]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(cols)])

    # a text that loses nothing isn't shuffled
    n = blocks_for(gone.count())
    seen = marked(ids, bloom(gone, "k", n), "k", n)
    whole = seen.filter("NOT __gl_may").select("doc_id", "text", F.lit(None).cast(gone.schema["gone"].dataType).alias("gone"))
    both = whole.union(seen.filter("__gl_may").join(gone, ["d", "k"], "left").select("doc_id", "text", "gone"))
    return both.mapInArrow(tidy(run, BATCH_ROWS), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept)

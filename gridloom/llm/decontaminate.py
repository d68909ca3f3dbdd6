"""Benchmark decontamination: size-partitioned MinHash containment search, checked on exact shingles.

A document is contaminated by an item if it holds PERCENT of the item's distinct 5-word shingles or more (A-Z
lower-cased, words between blanks). Documents may be thousands of times longer than items, so the MinHash samples are
taken of the items, and as many as their size asks for: items are partitioned by set size, and an item of q shingles
gets its q - ceil(0.75 q) + 1 smallest hashes. At most q - ceil(0.75 q) shingles of an item may be missing from a
document that contains it, so one of these samples is always met: the search misses nothing. A partition looks only
at those hashes of a document that are not above its largest sample. Candidates are checked on all shingles, word by word.

An item of q < 5 words is one shingle of q words, and is searched among the q-word shingles of the documents.

Items are the stated query set: they go to the executors in blocks of about BLOCK_ITEMS items and BLOCK_BYTES bytes,
each a broadcast of bounded size, against all documents, which are read once for each block; there is no shuffle of
documents. Equal items of one id are searched once.

Defined cases: null and empty texts, of items or documents, have an empty set and contain or contaminate nothing; an
item of fewer than five words is found wherever its words stand in a row; repeated items and rows give a row each; empty tables
give empty results; `clean` keeps all columns of the documents, `search` ignores others.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, tidy

SHINGLE = 5
PERCENT = 75
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 32 << 20
SCHEMA = "doc_id long, item_id long, n_item long, n_shared long, containment double"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text: str | None, k: int = SHINGLE) -> set[tuple[str, ...]]:
    """The exact set of a text."""
    w = _WORD.findall((text or "").translate(_LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def needed(q: int) -> int:
    """Shingles of an item of q that a document must hold."""
    return -(-PERCENT * q // 100)


class Items:
    """A block of items with their samples, by words a shingle and size partition: (largest sample, samples sorted, item numbers)."""

    def __init__(self, ids: list, texts: list[str | None], times: list[int]):
        from .kernels import shingle_sets

        self.ids, self.texts, self.times = ids, texts, times
        self.sets: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(texts)
        self.words = [min(SHINGLE, len(_WORD.findall(t or ""))) for t in texts]
        self.parts: dict[int, list] = {}
        for k in sorted(set(self.words) - {0}):
            own = [n for n, w in enumerate(self.words) if w == k]
            for first, h, bounds in shingle_sets(pa.array([texts[n] for n in own], pa.string()), k):
                for n, x, y in zip(own[first:], bounds[:-1], bounds[1:], strict=False):
                    self.sets[n] = h[x:y]
            self.parts[k] = self._parts(own)

    def _parts(self, own: list[int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        sized: dict[int, list[tuple[np.ndarray, int]]] = {}
        for n in own:
            s = self.sets[n]
            sized.setdefault(len(s).bit_length(), []).append((s[: len(s) - needed(len(s)) + 1], n))
        parts = []
        for size in sorted(sized):
            samples = np.concatenate([s for s, _ in sized[size]])
            number = np.concatenate([np.full(len(s), n) for s, n in sized[size]])
            order = np.argsort(samples, kind="stable")
            parts.append((samples[order[-1]], samples[order], number[order]))
        return parts

    def candidates(self, h: np.ndarray, text: np.ndarray, k: int) -> np.ndarray:
        """Distinct (text, item) rows that share a sample; h: hashes of shingles of k words, text: the text number of each."""
        found = [np.zeros((0, 2), np.int64)]
        for top, samples, number in self.parts[k]:
            low = np.flatnonzero(h <= top)
            a, b = np.searchsorted(samples, h[low], "left"), np.searchsorted(samples, h[low], "right")
            low, a, n = low[b > a], a[b > a], (b - a)[b > a]
            if len(low):
                at = np.repeat(a - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
                found.append(np.stack([np.repeat(text[low], n), number[at]], 1))
        return np.unique(np.concatenate(found), axis=0)

    def search(self, column: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item number, shared shingles) of each contained item."""
        from .kernels import shingle_sets

        out = []
        for k in self.parts:
            for first, h, bounds in shingle_sets(column, k):
                text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
                exact: tuple[int, set] = (-1, set())
                for t, n in self.candidates(h, text, k).tolist():
                    s = self.sets[n]
                    own = h[bounds[t] : bounds[t + 1]]
                    if len(np.intersect1d(s, own, assume_unique=True)) < needed(len(s)):
                        continue
                    if exact[0] != t:
                        exact = t, shingles(column[first + t].as_py(), k)
                    item = shingles(self.texts[n], k)
                    if (shared := len(item & exact[1])) >= needed(len(item)):
                        out.append((first + t, n, shared))
        return out


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text", block_items: int = BLOCK_ITEMS) -> Iterator:
    """Broadcasts of about block_items items and BLOCK_BYTES bytes each at most, by expectation; equal rows are one item, with their number."""
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).groupBy("i", "t").agg(F.count(F.lit(1)).alias("n"))
    count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).collect()[0]
    n = max(1, -(-count // block_items), -(-size // BLOCK_BYTES))
    for k in range(n):
        got = rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect() if n > 1 else rows.collect()
        yield items.sparkSession.sparkContext.broadcast(Items([r.i for r in got], [r.t for r in got], [r.n for r in got]))


def search(docs: DataFrame, items: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """A row for each document and item that it contains."""
    out = None
    for held in item_blocks(items, block_items=block_items):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = [x for x in held.value.search(batch.column("text")) for _ in range(held.value.times[x[1]])]
                q = [len(held.value.sets[n]) for _, n, _ in hits]
                cols = [batch.column("doc_id").take(pa.array([r for r, _, _ in hits], pa.int64())), pa.array([held.value.ids[n] for _, n, _ in hits], pa.int64()), pa.array(q, pa.int64())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([s for *_, s in hits], pa.int64()), pa.array([s / n for (*_, s), n in zip(hits, q, strict=True)], pa.float64())], ["doc_id", "item_id", "n_item", "n_shared", "containment"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run, BATCH_ROWS), SCHEMA)
        out = found if out is None else out.union(found)
    return out


def clean(docs: DataFrame, items: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The documents that contain no item, with all their columns."""
    at = docs.columns.index("text")
    for held in item_blocks(items, block_items=block_items):

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = np.zeros(batch.num_rows, bool)
                bad[[r for r, _, _ in held.value.search(batch.column(at))]] = True
                yield batch.filter(pa.array(~bad))

        docs = docs.mapInArrow(tidy(run, BATCH_ROWS), docs.schema)
    return docs

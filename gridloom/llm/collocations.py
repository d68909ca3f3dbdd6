"""Phrase collocations by language: phrases whose words meet more often than their counts alone would have it.

Passes over the texts, none of which shuffles text:
1. A count-min sketch of the words: each task (about one a core) fills one with saturating cells, equal blocks are added up
   by a shuffle, and the whole, of bounded size (`cells`), is broadcast. A word's bound is the least of its cells, so no word
   that reaches the threshold is missed.
2. Phrases of two words whose bounds reach it are counted by 64-bit hashes, in a shuffle of hashes and counts. Those that
   reach the threshold are marked in two rows of bits of bounded size, which are broadcast.
3. A task takes its texts a shard (`SHARD_BYTES` of one language) at a time. A shard's phrases, told apart by the numbers
   of their words, not by hashes, are counted where all their words and pairs of neighbours may reach the threshold. Counts
   by language and phrase are summed before and after the shuffle.
4. What falls below the threshold goes; cuts, scores, drops and ranks are joins and windows over the counted phrases.

Full cells and bits, or hashes that coincide, let more phrases through to the last counts, which are by the phrases
themselves: that costs time and never changes results.

Words never cross documents or pieces. A stretch without any delimiter that is longer than a shard is cut between words;
the words around a cut stand in both parts, and what they hold together is subtracted once.

A null text is empty, a null language `und`. Repeated rows count as often as they stand; an empty table gives no rows;
other columns are never read. Bytes that aren't UTF-8 are replacement characters in phrases.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, release, tidy
from .kernels import mix, word_hashes

if TYPE_CHECKING:
    import pyarrow as pa

MAX_WORDS = 3
MIN_COUNT = 10
TOP = 2000
#: A candidate goes if a longer one that holds it has this share of its count.
ABSORBED_PERCENT = 50
SCALE = 1_000_000
NO_LANGUAGE = "und"
DELIMITERS = ".,;:!?\n\x0b\x0c\r"
SHARD_BYTES = 1 << 22
#: Cells of a row of the sketch: a power of two that grows with the texts within these bounds; a cell is a byte, rows are two.
MIN_CELLS, MAX_CELLS = 1 << 20, 1 << 25
BYTES_A_CELL = 128
#: Bits of a row of marks: a power of two, within these bounds, that grows with the marked phrases.
MIN_BITS, MAX_BITS = 1 << 10, 1 << 28
BITS_A_MARK = 16
#: Hashes that a task holds before it counts them.
HELD = 1 << 22
#: Texts that one task sketches, at most (as far as the input's own partitions allow).
SKETCH_BYTES = 4 << 30
BLOCK = 1 << 16
BLOCKS = "k int, cells binary"
FULL = 255
#: Parts of a language that are ranked apart before its best meet.
PARTS = 32

_FLAT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + DELIMITERS.encode(), b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(DELIMITERS))


class Sketch:
    """Two rows of saturating byte counters."""

    def __init__(self, cells: int, data: np.ndarray | None = None):
        self.cells, self.rows = cells, np.zeros((2, cells), np.uint8) if data is None else data.reshape(2, cells)

    def at(self, h: np.ndarray) -> list[np.ndarray]:
        last = np.uint64(self.cells - 1)
        return [(h & last).astype(np.uint32), ((h >> np.uint64(32)) & last).astype(np.uint32)]

    def add(self, h: np.ndarray, n: np.ndarray | None = None) -> None:
        """Add hashes, each once or n times."""
        for row, cell in zip(self.rows, self.at(h), strict=True):
            cell, which = np.unique(cell, return_inverse=True)
            row[cell] = np.minimum(row[cell] + np.minimum(np.bincount(which, n, len(cell)), FULL), FULL).astype(np.uint8)

    def bound(self, h: np.ndarray) -> np.ndarray:
        a, b = self.at(h)
        return np.minimum(self.rows[0][a], self.rows[1][b])

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        yield from _blocks(self.rows, self.cells)


class Marks:
    """Two rows of bits; a hash is marked by one in each."""

    def __init__(self, bits: int, data: np.ndarray | None = None):
        self.bits, self.rows = bits, np.zeros((2, bits // 8), np.uint8) if data is None else data.reshape(2, bits // 8)

    def at(self, h: np.ndarray) -> list[np.ndarray]:
        last = np.uint64(self.bits - 1)
        return [(h & last).astype(np.uint32), ((h >> np.uint64(32)) & last).astype(np.uint32)]

    def add(self, h: np.ndarray) -> None:
        for row, bit in zip(self.rows, self.at(h), strict=True):
            bit = np.sort(bit)
            byte = bit >> 3
            edge = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]]) if len(bit) else np.zeros(0, np.int64)
            if len(edge):
                row[byte[edge]] |= np.bitwise_or.reduceat(np.left_shift(1, bit & 7).astype(np.uint8), edge)

    def has(self, h: np.ndarray) -> np.ndarray:
        a, b = ((row[bit >> 3] >> (bit & 7)) & 1 for row, bit in zip(self.rows, self.at(h), strict=True))
        return (a & b).astype(bool)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        yield from _blocks(self.rows, self.bits // 8)


def _blocks(rows: np.ndarray, size: int) -> Iterator[tuple[int, bytes]]:
    """The blocks of rows of so many bytes that aren't empty, with their numbers."""
    for k, block in enumerate(rows.reshape(-1, min(BLOCK, size))):
        if block.any():
            yield k, block.tobytes()


def _both(a: bytes, b: bytes) -> bytes:
    """Two blocks of cells, added up."""
    return np.minimum(np.frombuffer(a, np.uint8).astype(np.uint16) + np.frombuffer(b, np.uint8), FULL).astype(np.uint8).tobytes()


def _either(a: bytes, b: bytes) -> bytes:
    """Two blocks of bits, both's marks."""
    return (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()


def _utf8(text: bytes) -> bytes:
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        return text.decode(errors="replace").encode()


def chunks(flat: bytes, size: int, max_words: int) -> Iterator[tuple[bytes, list[bytes]]]:
    """A flattened text in parts of about size bytes, cut at delimiters; where there are none, between words, and the part then begins with the max_words - 1 words before the cut, which are also given by themselves."""
    start, before, shared = 0, 0, []
    while len(flat) - start > size:
        end = flat.rfind(b"\n", start, start + size)
        if end < 0:  # the stretch goes on: to its end, or else a word further than the cut before
            reach = max(start + size, before + 1)
            end, space = flat.find(b"\n", reach), flat.find(b" ", reach)
            if 0 <= space and not 0 <= end < space:
                yield flat[start:space], shared
                words = flat[start:space].rsplit(None, max_words - 1)
                rest, shared = (words[:1], words[1:]) if len(words) == max_words else ([], words)
                start, before = start + sum(map(len, rest)), space
                continue
            if end < 0:
                break
        yield flat[start:end], shared
        start, shared = end + 1, []
    yield flat[start:], shared


def shards(batches, max_words: int = MAX_WORDS, size: int | None = None) -> Iterator[tuple[str, list[bytes], list[list[bytes]]]]:
    """language, flattened texts, word runs to subtract once, of texts that arrive as (lang, text) batches."""
    import pyarrow as pa

    size = size or SHARD_BYTES
    held: dict[str, tuple[list, list, int]] = {}
    total = 0
    for b in batches:
        langs = b.column("lang").to_pylist()
        for lang, text in zip(langs, b.column("text").cast(pa.binary()), strict=True):
            for flat, shared in chunks(_utf8(text.as_py() or b"").translate(_FLAT), size, max_words):
                texts, runs, n = held.get(lang) or ([], [], 0)
                texts.append(flat)
                runs += [shared] * bool(shared)
                held[lang] = texts, runs, n + len(flat)
                total += len(flat)
                if n + len(flat) >= size:
                    del held[lang]
                    total -= n + len(flat)
                    yield lang, texts, runs
                elif total >= 4 * size:  # many languages
                    yield from ((k, *v[:2]) for k, v in held.items())
                    held, total = {}, 0
    yield from ((k, *v[:2]) for k, v in held.items())


class Words:
    """A shard's words as numbers, in pieces, and its text with one space between words and a guarded newline between pieces, as bytes."""

    def __init__(self, lang: str, texts: list[bytes]):
        import pyarrow as pa
        import xxhash

        data = np.frombuffer(b"\n".join(texts), np.uint8)
        line = data == 10
        full = ~line & (data != 32)
        edge = np.diff(np.r_[False, full, False].astype(np.int8))
        starts, size = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
        n = len(starts)
        # only the words' bytes, one word after the other
        flat, ends = data[full], np.cumsum(size)
        coded = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(flat)]).dictionary_encode()
        self.ids, self.distinct = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
        piece = np.cumsum(line)[starts]
        begins = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]]) if n else np.zeros(0, np.int64)
        many = np.diff(np.r_[begins, n])
        self.left = np.repeat(begins + many, many) - np.arange(n)  # words from here to the end of the piece
        before = np.ones(n, np.int64)
        before[begins[1:]] = 3
        self.starts = np.cumsum(before + size) - size
        self.ends = self.starts + size
        guarded = np.full(int(self.ends[-1]) + 1 if n else 1, 32, np.uint8)
        guarded[np.repeat(self.starts - (ends - size), size) + np.arange(len(flat))] = flat
        guarded[self.starts[begins[1:]] - 2] = 10
        self.text = guarded
        off = np.frombuffer(coded.dictionary.buffers()[1], np.int32)[: self.distinct + 1].astype(np.int64)
        kinds = np.frombuffer(coded.dictionary.buffers()[2] or b"", np.uint8)
        self.hashes = mix(word_hashes(kinds, off[:-1], off[1:], lower=False) ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode(errors="replace"))))

    def phrases(self, at: np.ndarray, m: int) -> pa.Array:
        """The phrases of m words at these places."""
        import pyarrow as pa

        first = self.starts[at]
        size = self.ends[at + m - 1] - first
        off = np.r_[0, np.cumsum(size)]
        data = self.text[np.repeat(first - off[:-1], size) + np.arange(off[-1])]
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(data)])

    def grams(self, max_words: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each number of words: it, the places where so many stand in a piece, and the phrases' hashes at all places (others are undefined)."""
        one = self.hashes[self.ids]
        h = one
        for m in range(1, max_words + 1):
            if m > 1:
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.r_[one[m - 1 :], np.zeros(min(m - 1, len(one)), np.uint64)])
            yield m, np.flatnonzero(self.left >= m), h


def _block_rows(table: Sketch | Marks) -> Iterator[pa.RecordBatch]:
    import pyarrow as pa

    for k, block in table.blocks():
        yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int32()), "cells": pa.array([block], pa.binary())})


def _sketched(cells: int, max_words: int):
    def run(batches):
        sketch = Sketch(cells)
        for lang, texts, _ in shards(batches, max_words):
            words = Words(lang, texts)
            sketch.add(words.hashes, np.bincount(words.ids, minlength=words.distinct))
        yield from _block_rows(sketch)

    return tidy(run)


def _marked(bits: int):
    def run(batches):
        marks = Marks(bits)
        for b in batches:
            marks.add(b.column("h").to_numpy().view(np.uint64))
        yield from _block_rows(marks)

    return tidy(run)


def each(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct number, and how often it comes."""
    order = np.argsort(codes)
    codes = codes[order]
    edge = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(order) else order
    return order[edge], np.diff(np.r_[edge, len(codes)])


def frequent(words: Words, sketch: Sketch, min_count: int) -> np.ndarray:
    """Whether the word at each place (and one past the last) may reach min_count in the whole corpus."""
    return np.r_[(sketch.bound(words.hashes) >= min_count)[words.ids], False]


def _pairs(sketch_of, min_count: int, max_words: int):
    """Hashes of phrases of two words that may be frequent, and counts that are never too low: words around a cut count twice."""

    def run(batches):
        import pyarrow as pa

        def rows():
            h = np.sort(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            edge = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h[edge].view(np.int64)), pa.array(np.diff(np.r_[edge, len(h)]))], ["h", "n"])

        sketch, held = sketch_of(), []
        for lang, texts, _ in shards(batches, max_words):
            words = Words(lang, texts)
            often = frequent(words, sketch, min_count)
            for m, at, h in words.grams(2):
                if m == 2:
                    held.append(h[at[often[at] & often[at + 1]]])
            if sum(map(len, held)) >= HELD:
                yield rows()
                held = []
        yield rows()

    return tidy(run)


def found(words: Words, sketch: Sketch, marks: Marks | None, min_count: int, max_words: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """The shard's words and phrases that may reach min_count in the whole corpus, and their counts here, by number of words."""
    n, v = len(words.ids), max(1, words.distinct)
    code, top, below = words.ids, v, None  # a number for the phrase at each place, what all are below, and whether the phrase of a word less may be frequent
    for m, at, h in words.grams(max_words):
        if m == 1:
            below = frequent(words, sketch, min_count)
            at = np.flatnonzero(below)
        else:
            at = at[below[at] & below[at + 1]]
            if m == 2 and marks is not None:
                at = at[marks.has(h[at])]
            if top * v >= 1 << 63:  # dense numbers keep the products small enough
                _, dense = np.unique(code[at], return_inverse=True)
                code, top = np.zeros(n, np.int64), n
                code[at] = dense
            longer = np.zeros(n, np.int64)
            longer[at] = code[at] * v + words.ids[at + m - 1]
            code, top = longer, top * v
            below = np.zeros(n + 1, bool)
            below[at] = True
        place, times = each(code[at])
        yield words.phrases(at[place], m), times


def _batch(lang: str, phrases: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(phrases)), phrases, pa.array(n, pa.int64())], ["lang", "phrase", "n"])


def _scanned(sketch_of, marks_of, min_count: int, max_words: int):
    def run(batches):
        import pyarrow as pa

        sketch, marks = sketch_of(), marks_of()
        for lang, texts, runs in shards(batches, max_words):
            for sign, part in ((1, texts), (-1, [b" ".join(r) for r in runs])):
                if not part:
                    continue
                words = Words(lang, part)
                yield _batch(lang, pa.array([""]), np.array([sign * len(words.ids)]))
                for phrases, n in found(words, sketch, marks, min_count, max_words):
                    yield _batch(lang, phrases, sign * n)

    return tidy(run)


def cells_for(n_bytes: int) -> int:
    return min(MAX_CELLS, max(MIN_CELLS, 1 << (n_bytes // BYTES_A_CELL).bit_length()))


def bits_for(n: int) -> int:
    return min(MAX_BITS, max(MIN_BITS, 1 << (n * BITS_A_MARK).bit_length()))


def _shared(rows: DataFrame, size: int, block: int, merge):
    """Blocks (k, cells) of tables of so many bytes, merged and put together, as a broadcast."""
    spark = rows.sparkSession
    data = np.zeros(size, np.uint8)
    merged = rows.rdd.map(lambda r: (r.k, bytes(r.cells))).reduceByKey(merge, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for k, cells in merged.collect():
        data[k * block : (k + 1) * block] = np.frombuffer(cells, np.uint8)
    return spark.sparkContext.broadcast(data.tobytes())


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, cells: int | None = None, bits: int | None = None) -> DataFrame:
    """lang, phrase, n: all words and phrases of up to max_words with min_count occurrences in their language, and an empty phrase with the count of all words. A table of its own."""
    if not 1 <= min_count <= FULL:
        raise ValueError(f"min_count must be from 1 to {FULL}")
    spark = docs.sparkSession
    texts = docs.select(F.coalesce("lang", F.lit(NO_LANGUAGE)).alias("lang"), "text")
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    cells = cells or cells_for(n_bytes)
    # a task a core, or more where its texts would pass SKETCH_BYTES: what is shuffled is a small part of the texts
    few = texts.coalesce(max(1, spark.sparkContext.defaultParallelism, -(-n_bytes // SKETCH_BYTES)))
    held = [_shared(few.mapInArrow(_sketched(cells, max_words), BLOCKS), 2 * cells, min(BLOCK, cells), _both)]
    sketch_of = lambda words=held[0]: Sketch(cells, np.frombuffer(words.value, np.uint8))
    marks_of = lambda: None
    try:
        if max_words > 2:
            pairs = texts.mapInArrow(_pairs(sketch_of, min_count, max_words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
            pairs = cut(pairs.filter(F.col("n") >= min_count).select("h"), "pairs")
            bits = bits or bits_for(pairs.count())
            rows = pairs.coalesce(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(_marked(bits), BLOCKS)
            held.append(_shared(rows, bits // 4, min(BLOCK, bits // 8), _either))
            release(pairs)
            marks_of = lambda marks=held[1]: Marks(bits, np.frombuffer(marks.value, np.uint8))
        scanned = texts.mapInArrow(_scanned(sketch_of, marks_of, min_count, max_words), "lang string, phrase string, n long")
        return cut(scanned.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= min_count) | (F.col("phrase") == "")), "phrases")
    finally:
        for shared in held:
            shared.destroy()


def _words(phrase: str = "phrase") -> Column:
    return F.split(phrase, " ")


def scored(counts: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase of two words or more: of its cut with the lowest score, the earliest of equals."""
    ws = _words()
    phrases = counts.filter(F.size(ws) > 1)
    cuts = phrases.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size(ws) - 1)).alias("k"))
    part = lambda start, n: F.array_join(F.slice(ws, start, n), " ")
    cuts = cuts.select("*", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.size(ws) - F.col("k")).alias("rest"))
    both = cuts.join(counts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"])
    wide = "decimal(38,0)"  # products of counts pass 64 bits
    both = both.withColumn("score", F.expr(f"CAST({SCALE} AS {wide}) * CAST(a AS {wide}) * CAST(a AS {wide}) DIV (CAST(l AS {wide}) * CAST(r AS {wide}))"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("best")
    return both.groupBy("lang", "phrase", "a").agg(best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def absorbed(counts: DataFrame, percent: int = ABSORBED_PERCENT) -> DataFrame:
    """lang, phrase of the phrases that lie inside a longer one with at least percent of their count."""
    ws = _words()
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.size(ws) - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size(ws) - m + 1), lambda i: F.array_join(F.slice(ws, i, m), " "))))
    longest = counts.filter(F.size(ws) > 2).select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    return counts.join(longest, ["lang", "phrase"]).filter(F.col("longer") * 100 >= F.col("n") * percent).select("lang", "phrase")


def mine(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, percent: int = ABSORBED_PERCENT, cells: int | None = None, bits: int | None = None) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two to max_words words."""
    counts = phrase_counts(docs, min_count, max_words, cells, bits)
    phrases = counts.filter("phrase <> ''")
    left = scored(phrases).join(absorbed(phrases, percent), ["lang", "phrase"], "left_anti")
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = lambda df, *keys: df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).filter(F.col("rank") <= top)
    parts = ranked(left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))), "lang", "part").drop("part")
    total = counts.filter("phrase = ''").select("lang", F.col("n").alias("words"))
    return ranked(parts, "lang").join(total, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")

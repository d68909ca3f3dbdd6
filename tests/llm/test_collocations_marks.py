"""What reaches the shuffle of phrases, whatever the size of the words' sketch, and what full marks change: nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import collocations

from .test_collocations import brute, frame, got, texts


def test_full_sketch_lets_no_rare_phrase_through(spark, monkeypatch):
    """Common words in phrases that are nearly all rare: before, a sketch of all phrases, once full, let each of them through."""
    rng = np.random.default_rng(5)
    rows = [("en", " ".join(f"w{x}" for x in rng.integers(0, 400, 200))) for _ in range(100)] + [("en", "often seen words")] * 20
    whole, seen = collocations._scanned, spark.sparkContext.accumulator(0)

    def counting(*a):
        run = whole(*a)

        def inner(batches):
            for b in run(batches):
                seen.add(sum(x.count(" ") > 0 for x in b.column("phrase").to_pylist()))
                yield b

        return inner

    monkeypatch.setattr(collocations, "_scanned", counting)
    assert got(spark, rows, cells=64) == brute(rows)
    assert 0 < seen.value < 2000  # of about 39,700 phrases, nearly all different


@pytest.mark.parametrize("bits", [8, 1024])
def test_full_marks_change_nothing(spark, bits):
    rows = [*texts(8, 300, 30), ("en", "a b c d " * 30)]
    assert got(spark, rows, bits=bits) == got(spark, rows, bits=bits, cells=64) == brute(rows)


@pytest.mark.parametrize("words", [2, 4])
def test_other_lengths(spark, words):
    rows = texts(9, 200, 30, "a b c d".split())
    want = {(lang, phrase): a for lang, _, phrase, a, *_ in brute(rows, percent=10**6)}
    have = {(r.lang, r.phrase): r.a for r in collocations.mine(frame(spark, rows), max_words=words, percent=10**6).collect()}
    both = {k: a for k, a in want.items() if len(k[1].split()) <= words}
    assert both and {k: a for k, a in have.items() if len(k[1].split()) <= 3} == both


def test_marks():
    h = np.random.default_rng(2).integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2)
    whole = {}
    for part in (h[:500], h[500:1000], h[:0]):
        marks = collocations.Marks(1 << 16)
        marks.add(part)
        for k, block in marks.blocks():
            whole[k] = collocations._either(whole[k], block) if k in whole else block
    data = np.frombuffer(b"".join(whole[k] for k in sorted(whole)), np.uint8)
    has = collocations.Marks(1 << 16, data).has(h)
    assert has[:1000].all() and has[1000:].mean() < 0.01


def test_bytes_that_are_not_utf8(spark):
    """Different broken words are one and the same: replaced before they are counted."""
    rows = [("en", "a \ufffd b"), ("en", "c a \ufffd")] * 6
    broken = spark.createDataFrame([("en", "6120FF2062"), ("en", "63206120FE")] * 6, "lang string, x string").select("lang", F.expr("CAST(unhex(x) AS STRING)").alias("text"))
    assert sorted(tuple(r) for r in collocations.mine(broken).collect()) == brute(rows)

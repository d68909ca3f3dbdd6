"""Collocations against plain counting, however the texts are cut, and under a sketch that is far too small."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import collocations

from .. import duck


def brute(rows, least=10, top=2000, percent=50):
    """lang, rank, phrase, a, l, r, n, score by counting everything."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for m in (1, 2, 3):
                f.update((lang, *ws[i : i + m]) for i in range(len(ws) - m + 1))
    best = {}
    for key, a in f.items():
        lang, *ws = key
        if len(ws) < 2 or a < least:
            continue
        if len(ws) == 2 and any(100 * f[g] >= percent * a for g in f if len(g) == 4 and f[g] >= least and g[0] == lang and tuple(ws) in (g[1:3], g[2:4])):
            continue
        score, _, left, right = min((1_000_000 * a * a // (f[(lang, *ws[:k])] * f[(lang, *ws[k:])]), k, f[(lang, *ws[:k])], f[(lang, *ws[k:])]) for k in range(1, len(ws)))
        best.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, rows in best.items() for rank, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1))


def frame(spark, rows):
    return spark.createDataFrame([(lang, text, 1, "p", 2) for lang, text in rows], "lang string, text string, n int, phrase string, rank int")


def texts(seed, docs, words=12, vocabulary="a b c D d É é \U0001f600 x-y \x1c 漢".split(" ")):
    rng = random.Random(seed)
    gap = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n", " ! "]
    return [(rng.choice(["en", "de", None, "und", ""]), "".join(rng.choice(vocabulary) + rng.choice(gap) for _ in range(rng.randint(0, words)))) for _ in range(docs)]


def got(spark, rows, **options):
    return sorted(tuple(r) for r in collocations.mine(frame(spark, rows), **options).collect())


def test_equals_sql(spark):
    from gridloom.llm.queries import oracle_sql, queries

    duck.compare(duck.connect(), queries()["op11_collocations"](spark, duck.SF), oracle_sql()["op11_collocations"])


def test_odd_texts(spark):
    rows = [*texts(1, 400), (None, None), ("en", ""), ("en", " \t\n"), ("xx", None)] + [("en", "one two three")] * 12
    assert got(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    assert got(spark, []) == [] and got(spark, [("en", "a b")] * 9) == []
    rows = [("en", "a b")] * 10
    assert got(spark, rows) == brute(rows) == [("en", 1, "a b", 10, 10, 10, 20, 1_000_000)]


def test_first_of_each_language(spark):
    rows = texts(2, 300, 30)
    assert got(spark, rows, top=5) == brute(rows, top=5)


@pytest.mark.parametrize("size", [7, 40, 1000])
def test_shards_of_any_size(spark, monkeypatch, size):
    """Shards, automata and scans far below the texts' lengths, texts without a delimiter, and a sketch of 64 cells."""
    rng = random.Random(3)
    rows = texts(4, 60, 30) + [("en", " ".join(rng.choice("abc") * rng.choice([1, 1, 9]) for _ in range(300)))] + [("en", "q" * 90), ("en", "q" * 90 + " a " + "b" * 50 + " a b")]
    words = collocations._scanned
    monkeypatch.setattr(collocations, "_scanned", lambda *a: small(words(*a), size))
    monkeypatch.setattr(collocations, "_sketched", lambda *a, make=collocations._sketched: small(make(*a), size))
    assert got(spark, rows, cells=64) == brute(rows)


def small(run, size):
    def inner(batches):
        collocations.SHARD_BYTES = collocations.AUTOMATON_CHARS = size
        try:
            yield from run(batches)
        finally:
            collocations.SHARD_BYTES = collocations.AUTOMATON_CHARS = 1 << 22

    return inner


def test_chunks_hold_every_phrase_once():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "bb", "cccccccc", " ", " ", "  ", "\n"]) for _ in range(rng.randint(0, 40))).encode()
        words, size = rng.randint(1, 4), rng.randint(1, 20)
        count = lambda pieces: Counter(tuple(ws[i : i + m]) for ws in pieces for m in range(1, words + 1) for i in range(len(ws) - m + 1))  # noqa: B023, E731
        parts = list(collocations.chunks(text, size, words))
        found = count(p.split() for t, _ in parts for p in t.split(b"\n"))
        found.subtract(count(shared for _, shared in parts))
        assert +found == count(p.split() for p in text.split(b"\n")) and not -found


def test_bounds_are_never_below_counts():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 1 << 63, 5000, dtype=np.uint64) ** np.uint64(3)
    h = h[rng.zipf(1.5, 40_000).clip(1, 5000) - 1]
    for cells in (64, 1024, 1 << 14):
        a, b = collocations.Sketch(cells), collocations.Sketch(cells)
        a.add(h[:15_000])
        b.add(h[15_000:])
        whole = dict(a.blocks())
        for k, block in b.blocks():
            whole[k] = collocations._both(whole[k], block) if k in whole else block
        data = np.frombuffer(b"".join(whole[k] for k in sorted(whole)), np.uint8)
        keys, n = np.unique(h, return_counts=True)
        assert (collocations.Sketch(cells, data).bound(keys) >= np.minimum(n, collocations.FULL)).all()


def test_exact_beyond_64_bits(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", "a", big + 7), ("en", "b", big + 1), ("en", "a b", big), ("en", "c", 11)], "lang string, phrase string, n long")
    assert [tuple(r) for r in collocations.scored(counts).collect()] == [("en", "a b", big, big + 7, big + 1, 1_000_000 * big * big // ((big + 7) * (big + 1)))]

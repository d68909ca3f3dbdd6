"""The operators and their queries against brute force, on whole small tables, and the SQL ones against DuckDB."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from gridloom.llm import decontaminate, line_dedup, oracles, queries, suffix_dedup
from gridloom.llm.suffix_arrays import permuted_lcp, suffix_array

from .. import duck

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{duck.SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_equals_sql(spark, name):
    duck.compare(duck.connect(), queries.queries()[name](spark, duck.SF), oracles.ORACLES[name])


def test_suffix_arrays():
    rng = random.Random(5)
    for _ in range(300):
        s = bytes(rng.choice(b"abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 50))) * rng.randint(1, 3)
        a = np.frombuffer(s, np.uint8)
        order = sorted(range(len(s)), key=lambda i: s[i:])
        sa = suffix_array(a)
        assert list(sa) == order
        lcp = permuted_lcp(a, sa)
        for x, y in zip(order, order[1:], strict=False):
            n = next((k for k, (p, q) in enumerate(zip(s[x:], s[y:], strict=False)) if p != q), min(len(s) - x, len(s) - y))
            assert lcp[y] == n


def brute_suffixes(texts):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(b[p : p + 200] for b in raw.values() for p in range(len(b) - 199))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        spans = sum(1 for j, g in enumerate(gone) if g and (j == 0 or not gone[j - 1]))
        out[i] = len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()
    return out


@pytest.mark.parametrize("hot", [128, 0])
def test_suffix_dedup(spark, texts, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_CONTEXTS", hot)  # 0: every anchor is split
    got = {r.doc_id: tuple(r)[1:] for r in queries.op1_suffix_dedup(spark, duck.SF).collect()}
    assert got == brute_suffixes(texts)


def test_lm_scoring(spark, texts):
    got = {r.doc_id: r for r in queries.op2_lm_scoring(spark, duck.SF).collect()}
    tokens = {i: [*words(t), "\0"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    assert set(got) == set(texts)
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(ws), sum(w in c for w in ws), n)
        assert abs(got[i].base_score - base) < 1e-6 * max(1, abs(base)) and got[i].score < 0


def test_lm_learns():
    """The trained network beats the counts that it starts from, on texts that it hasn't seen."""
    from gridloom.llm.lm_scoring import Model

    rng = np.random.default_rng(3)
    cls, mass = np.repeat(np.arange(4), 5), np.full(20, 1.0)
    make = lambda: np.concatenate([[a, (a + 7) % 20] for a in rng.integers(0, 20, 30)]).astype(np.int64)
    model, new = Model(cls, mass), [make() for _ in range(20)]
    before = model.score(new).sum()
    for _ in range(3):
        model.train([make() for _ in range(1500)])
    assert model.score(new).sum() > 0.9 * before
    assert np.allclose(model.score(new), [model.score([t])[0] for t in new], rtol=1e-4)
    full = sum(10 ** model.score([np.array([5, y])])[0] for y in range(20))
    assert abs(full - 10 ** model.score([np.array([5])])[0]) < 1e-4  # probabilities of the next token sum to one


def shingles(text):
    w = words(text)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_dedup(spark, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op4_near_dedup(spark, duck.SF).collect()}
    sets, holders = {i: shingles(t) for i, t in texts.items()}, defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in holders[g] if j < i).items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    assert got == {i: (len(sets[i]), top(i), top(i) == i) for i in sets}


def test_decontamination(spark, texts):
    bench = {r.item_id: shingles(r.text) for r in spark.read.parquet(f"{duck.SF}/benchmark.parquet").collect()}
    got = sorted((r.doc_id, r.item_id, r.n_shared) for r in queries.op5_decontaminate(spark, duck.SF).collect())
    sets = {i: shingles(t) for i, t in texts.items()}
    want = sorted((i, b, len(s & q)) for i, s in sets.items() for b, q in bench.items() if q and 100 * len(s & q) >= 75 * len(q))
    assert got == want and want


def test_sentencepiece(spark, texts):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    ids = {i: sp.encode(t or "", add_eos=True) for i, t in texts.items()}
    want = {i: (len(x), sha(" ".join(map(str, x))), sha(sp.decode(x))) for i, x in ids.items()}
    assert {r.doc_id: tuple(r)[1:] for r in queries.op7_sentencepiece(spark, duck.SF).collect()} == want


def test_sentencepiece_on_odd_texts():
    import public_tokenizers
    import sentencepiece

    from gridloom.llm.sentencepiece_codec import MODEL, codec

    sp, c, rng = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL)), codec(MODEL), random.Random(2)
    signs = "aeinrsthg  ▁éß漢①\U0001f600\n\t.,-0123²_ <s>ABC"
    for _ in range(3000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        assert c.encode(t) == sp.encode(t, add_eos=True), t
        assert c.decode(c.encode(t)) == sp.decode(sp.encode(t)), t


def brute_lines(texts):
    """Every later holder of a key against the key's first holder, by the operator's own alignment."""
    lines = {i: (t or "").split("\n") for i, t in texts.items()}
    worded = lambda x: bool(x.strip(" \t\n\x0b\x0c\r"))
    first, pairs = {}, set()
    for i in sorted(lines):
        ls = lines[i]
        keys = {x for x in ls if len(x) >= 100 and worded(x)} | {(x, y) for x, y in zip(ls, ls[1:], strict=False) if worded(x) and worded(y)}
        for k in keys:
            if first.setdefault(k, i) != i:
                pairs.add((first[k], i))
    gone = defaultdict(set)
    for a, b in pairs:
        gone[b] |= set(line_dedup.blocks(lines[a], lines[b], [len(x) for x in lines[b]]))
    return {i: "\n".join(x for n, x in enumerate(ls) if n not in gone[i]) if gone[i] else (texts[i] or "") for i, ls in lines.items()}


def test_line_dedup(spark, texts):
    want = {i: hashlib.sha256(t.encode()).hexdigest() for i, t in brute_lines(texts).items()}
    assert {r.doc_id: r.kept_sha256 for r in queries.op8_line_dedup(spark, duck.SF).collect()} == want


def test_quality_rules_keep_labelled_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = queries.op9_quality_rules(spark, "/root/testdata/sf0.01").collect()
    assert all(r.kept for r in got if labels.get(r.doc_id) == 1 and not r.base_failed)
    assert not any(r.kept for r in got if labels.get(r.doc_id) == 0)


def test_pipeline(spark, texts):
    """Each stage against its operator's brute force, on what the stage before it kept."""
    docs = spark.read.parquet(f"{duck.SF}/documents.parquet")
    left = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, docs, duck.SF).collect()}
    kept = {r.doc_id for r in queries.op9_quality_rules(spark, duck.SF).filter("kept").collect()}
    assert set(left) == kept
    left = {i: t for i, t in brute_lines(left).items() if words(t)}
    sets = {i: shingles(t) for i, t in left.items()}
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            n = len(sets[i] & sets[j]) if j < i else 0
            if n and 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    left = {i: t for i, t in left.items() if top(i) == i}
    bench = [shingles(r.text) for r in spark.read.parquet(f"{duck.SF}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(q and len(q & sets[i]) >= decontaminate.needed(len(q)) for q in bench)}
    from gridloom.llm.sentencepiece_codec import MODEL, codec

    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, duck.SF).collect()} == {i: len(codec(MODEL).encode(t)) for i, t in left.items()}

"""The language model's work: few logits a token, right gradients, right sums, right words."""

import re

import numpy as np
import pytest

from gridloom.llm import kernels, lm_scoring


def test_few_logits_a_token():
    """By equal masses, words as frequent as in Zipf's law cost 117 logits a token."""
    counts = (1e7 / np.arange(1, 5001)).astype(np.int64)
    voc = lm_scoring.Vocabulary(np.arange(1, 5001, dtype=np.uint64) << np.uint64(40), counts, int(counts.sum()) + 1000, 5001, 1000)
    size, mass = np.bincount(voc.cls), np.bincount(voc.cls, voc.mass / voc.mass.sum())
    assert len(voc.cls) == 2 + lm_scoring.VOCAB and (np.diff(voc.cls) >= 0).all() and (size > 0).all()
    assert len(size) <= lm_scoring.CLASSES
    assert len(size) + (mass * size)[size > 1].sum() < 90


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_every_token_has_a_class(n):
    cls = lm_scoring.classes(1.0 / np.arange(1, n + 1))
    assert len(cls) == n and cls[0] == 0 and set(np.diff(cls)) <= {0, 1}


@pytest.mark.parametrize("high", [False, True])
def test_gradients(high):
    rng = np.random.default_rng(4)
    model = lm_scoring.Model(np.array([0, 1, 1, 1, 2, 2, 3]), np.arange(8.0, 1, -1))
    for k in ("wc", "bc", "wo", "bo"):
        model.p[k] = (rng.standard_normal(model.p[k].shape) * (4 if high else 0.5)).astype(np.float64)
    y = rng.integers(0, 7, 50)
    y = y[model._order(y)]
    h = rng.uniform(-1, 1, (50, lm_scoring.HIDDEN))
    dh, grads = model.gradients(h.astype(np.float32), y)
    eps = 1e-5
    for k, g in grads.items():
        flat, got = model.p[k].reshape(-1), g.reshape(-1)
        for i in rng.permutation(len(flat))[:20]:
            old, near = flat[i], []
            for x in (old + eps, old - eps):
                flat[i] = x
                near.append(-model.log_prob(h, y).sum())
            flat[i] = old
            assert got[i] == pytest.approx((near[0] - near[1]) / (2 * eps), rel=2e-3, abs=2e-3), (k, i)
    for i in range(0, 50, 7):
        near = []
        for x in (eps, -eps):
            moved = h.copy()
            moved[i, 3] += x
            near.append(-model.log_prob(moved, y).sum())
        assert dh[i, 3] == pytest.approx((near[0] - near[1]) / (2 * eps), rel=2e-3, abs=2e-3)


def test_sums_by_number():
    rng = np.random.default_rng(6)
    for most in (1, 3, 40, 3000):
        at, rows = rng.integers(0, most, 500) ** 2 // most, rng.integers(-9, 9, (500, 3)).astype(np.float32)
        numbers, sums = lm_scoring.by_number(at, rows)
        assert sorted(numbers) == sorted(set(at.tolist()))
        assert all((sums[i] == rows[at == k].sum(0)).all() for i, k in enumerate(numbers))


def test_word_spans():
    rng = np.random.default_rng(8)
    for _ in range(300):
        texts = [bytes(rng.choice(list(b" \n\tabc"), rng.integers(0, 9)).tolist()) for _ in range(rng.integers(1, 6))]
        off = np.r_[0, np.cumsum([len(t) for t in texts])]
        want = [(off[i] + m.start(), off[i] + m.end(), i) for i, t in enumerate(texts) for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        assert list(zip(*kernels.word_spans(np.frombuffer(b"".join(texts), np.uint8), off), strict=True)) == want

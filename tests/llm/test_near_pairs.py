"""How many pairs near-dedup holds against each other, and that their links stay whole."""

import random

import numpy as np

from gridloom.llm import near_dedup

from .test_more import components, near_copies, tokens


def test_a_large_group_of_near_copies_makes_few_pairs(spark, monkeypatch):
    rng = random.Random(8)
    base = tokens(rng, 120)
    texts = [near_copies(rng, base, 0.03 * rng.uniform(0.5, 1.2)) for _ in range(240)]
    pairs, verified = [], near_dedup.verified
    monkeypatch.setattr(near_dedup, "verified", lambda p, t: pairs.append(p.count()) or verified(p, t))
    got = {r.doc_id: r.component_id for r in near_dedup.groups(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()}
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    assert got == dict(enumerate(components(sets)))
    assert sum(pairs) < 10 * len(texts), pairs


def test_spanning_edges_join_what_all_edges_join():
    rng = np.random.default_rng(4)
    left, right, alike = rng.integers(0, 60, 400), rng.integers(0, 60, 400), rng.random(400)
    at = near_dedup.spanning(left, right, alike)

    def trees(edges):
        of = list(range(60))
        for _ in of:
            for k in edges:
                of[left[k]] = of[right[k]] = min(of[left[k]], of[right[k]])
        return of

    assert trees(at) == trees(range(400)) and len(at) == 60 - len(set(trees(at)))
    assert near_dedup.spanning(left[:0], right[:0], alike[:0]) == []

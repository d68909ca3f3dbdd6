"""Operators do their whole job: nothing is sampled, capped or passed over."""

import random

from gridloom.llm import decontaminate, line_dedup, lm_scoring


def test_lm_trains_on_every_token(spark, monkeypatch):
    long = " ".join(f"w{i % 97}" for i in range(3000))
    docs = spark.createDataFrame([(i, f"t{i} {long}" if i % 2 else "a b c") for i in range(12)], "doc_id long, text string")
    given, fit = [], lm_scoring.fit
    monkeypatch.setattr(lm_scoring, "fit", lambda parts, held: given.append(sum(len(r.ids) for r in parts.collect())) or fit(parts, held))
    rows = lm_scoring.score(docs).collect()
    assert given == [rows[0].train_tokens] == [sum(r.n_tokens for r in rows if not r.held_out)]


def test_lm_carries_states_through_a_text(monkeypatch):
    import numpy as np

    seen, step = [], lm_scoring.Model.train_window

    def window(self, y, before, h):
        seen.append((int((y >= 0).sum()), before.tolist(), bool(np.any(h))))
        return step(self, y, before, h)

    monkeypatch.setattr(lm_scoring.Model, "train_window", window)
    model = lm_scoring.Model(np.repeat(np.arange(4), 5), np.full(20, 1.0))
    model.train([np.arange(n) % 20 for n in (5, 40, 70)])
    assert [n for n, *_ in seen] == [69, 40, 6]
    assert [b for _, b, _ in seen] == [[20, 20, 20], [31 % 20, 31 % 20], [63 % 20]] and [c for *_, c in seen] == [False, True, True]


def all_pairs(texts):
    """What is left of each text if it is aligned with every earlier one."""
    lines = {i: t.split("\n") for i, t in texts.items()}
    left = {}
    for b in lines:
        gone = {x for a in lines if a < b for x in line_dedup.blocks(lines[a], lines[b], [len(x) for x in lines[b]])}
        left[b] = "\n".join(x for n, x in enumerate(lines[b]) if n not in gone)
    return left


def kept(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: r.kept_text for r in line_dedup.report(docs).collect()}


def test_lines_parted_by_blank_lines_are_a_block(spark):
    block = "\n\n".join(c * 80 for c in "pqr")
    assert kept(spark, {1: f"one\n{block}\nx", 2: f"two\n{block}\ny"})[2] == "two\ny"


def test_lines_are_met_by_a_later_holder(spark):
    p, q, short = "p" * 120, "q" * 120, ["r" * 40, "s" * 40, "t" * 40]
    texts = {1: f"{p}\nx\n{q}", 2: f"{q}\ny\n{p}", 3: f"{q}\nz\n{p}"}
    assert kept(spark, texts)[3] == "z" and kept(spark, texts) == all_pairs(texts)
    texts = {1: "\n".join(short[:2]), 2: "\n".join(short[1:]), 3: "\n".join(short), 4: "\n".join(["new", *short])}
    assert kept(spark, texts)[4] == "new"


def test_lines_that_stand_twice_are_aligned(spark):
    p = "p" * 120
    texts = {1: f"{p}\na\n{p}\nb", 2: f"c\n{p}\nd\n{p}\ne"}
    assert kept(spark, texts)[2] == "c\nd\ne"


def test_line_dedup_equals_all_pairs(spark):
    rng = random.Random(4)
    for kinds, docs in ((5, 30), (12, 40), (40, 40)):
        pool = ["", " ", *("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"[i] * rng.choice([5, 30, 45, 70, 110]) for i in range(kinds))]
        texts = {i: "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) for i in range(docs)}
        assert kept(spark, texts) == all_pairs(texts)


def test_heaviest_common_lines():
    rng = random.Random(6)
    for _ in range(300):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 9))] for _ in "ab")
        weight = {x: rng.randint(1, 150) for x in range(5)}
        got = line_dedup.heaviest(a, b, [weight[x] for x in b])
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight[x] * (x == y))
        assert sum(weight[a[i]] for i, _ in got) == best[-1][-1] and all(a[i] == b[j] for i, j in got)
        assert all(i < k and j < m for (i, j), (k, m) in zip(got, got[1:], strict=False))


def test_short_items_are_found_within_documents(spark):
    bench = spark.createDataFrame([(0, "Few words"), (1, "one"), (2, "here are four words"), (3, "a b c d e"), (4, "few")], "item_id long, text string")
    d = spark.createDataFrame([(1, "There are few  WORDS in this text"), (2, "few of the words stand apart here"), (3, "Here are four\nwords, and here are four words a b c d e"), (4, "one"), (5, None), (6, "fewer words than before in it")], "doc_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_shared) for r in decontaminate.search(d, bench).collect())
    assert got == [(1, 0, 1), (1, 4, 1), (2, 4, 1), (3, 2, 1), (3, 3, 1), (4, 1, 1)]
    assert sorted(r.doc_id for r in decontaminate.clean(d, bench).collect()) == [5, 6]

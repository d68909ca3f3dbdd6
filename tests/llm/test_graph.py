"""Connected components: roots, and the joins of a round."""

import random

from gridloom.llm import graph


def test_a_round_makes_each_join_once(spark, monkeypatch):
    joins, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name="t": joins.append(df._jdf.queryExecution().optimizedPlan().toString().count("Join ")) or cut(df, name))
    rng = random.Random(2)
    edges = [(rng.randrange(90), rng.randrange(90)) for _ in range(70)] + [(100, n) for n in range(101, 140)] + [(7, 7)]
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in range(90):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == root and len(got) == len(root)
    assert max(joins) == 1

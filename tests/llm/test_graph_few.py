"""Connected components of few edges: no shuffles, the same roots."""

import random

from gridloom.llm import graph


def test_few_edges_are_not_shuffled(spark, monkeypatch):
    plans, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, name="t": plans.append(df._jdf.queryExecution().executedPlan().toString().count("hashpartitioning")) or cut(df, name))
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(300), rng.randrange(300)) for _ in range(260)], "a long, b long").repartition(3)
    got = sorted(map(tuple, graph.components(edges).collect()))
    assert not any(plans[1:])
    monkeypatch.setattr(graph, "FEW", 0)
    assert sorted(map(tuple, graph.components(edges).collect())) == got

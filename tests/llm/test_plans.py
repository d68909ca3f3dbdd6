"""What reaches a shuffle, and orders that don't change from call to call."""

from gridloom.llm import quality_rules, url_filter


def test_rows_that_the_filter_rejects_are_not_shuffled(spark):
    pages = spark.range(4000).selectExpr("id AS page_id", "concat('http://h', id, '.info/x') AS url")
    listed = spark.createDataFrame([("h7.info/x",), ("h9.info/x",), ("other.info/",)], "canonical string")
    decided = url_filter.ruled(pages)
    out = url_filter.looked_up(decided, listed)
    rows = out.collect()
    assert len(rows) == 4000 and sorted(r.page_id for r in rows if r.listed) == [7, 9]
    # the one exchange of pages stands above the filter's flag
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = url_filter.looked_up(decided, listed)._jdf.queryExecution().executedPlan()
        assert shuffles_of(plan, "page_id") == 1
        text = plan.toString()
        exchange = text.index("Exchange hashpartitioning(canonical")
        assert "__gl_may" in text[exchange:] or "Filter" in text[exchange : exchange + 800]
        out = url_filter.looked_up(decided, listed)
        assert sorted(r.page_id for r in out.collect() if r.listed) == [7, 9]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    passed = url_filter.marked(decided, url_filter.bloom(listed, n_blocks=1), n_blocks=1).filter("__gl_may").count()
    assert 2 <= passed < 40


def shuffles_of(plan, column):
    """Exchanges by a hash whose rows hold the column."""
    mine = "ShuffleExchange" in plan.getClass().getSimpleName() and column in plan.output().toString()
    return int(mine) + sum(shuffles_of(plan.children().apply(i), column) for i in range(plan.children().size()))


def test_one_order_of_the_rules(spark):
    words = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(i, words if i % 4 else "###" * 30) for i in range(300)] + [(400, None), (401, "")], "doc_id long, text string")
    orders = [[r.name for r in quality_rules.ordered(docs)] for _ in range(3)]
    assert orders[0] == orders[1] == orders[2] and orders[0][0] == "few_words" and orders[0].index("symbols") < orders[0].index("repeated_windows")
    assert [r.name for r in quality_rules.ordered(docs.repartition(7))] == orders[0]
    found = quality_rules.estimates(docs)
    assert found["symbols"][1] >= 60 and found["few_words"][0] < found["symbols"][0] < found["repeated_windows"][0]
    assert [r.name for r in quality_rules.ordered(docs.filter("false"))] == [r.name for r in quality_rules.RULES]


def test_the_order_changes_no_verdict(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % (3 + i % 40)}" for j in range(i % 70)) + ("# " * (i % 9))) for i in range(400)], "doc_id long, text string")
    kept = sorted(r.doc_id for r in quality_rules.keep(docs).collect())
    assert kept == sorted(r.doc_id for r in quality_rules.judge(docs).filter("kept").collect()) and 0 < len(kept) < 400

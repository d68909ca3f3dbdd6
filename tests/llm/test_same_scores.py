"""Scores of the language model don't depend on batches, partitions or what ran before; queries leave the session as it was."""

import pytest

from gridloom.llm import chat_format, decontaminate, lm_scoring, sentencepiece_codec, suffix_dedup

from .. import duck

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{duck.SF}/documents.parquet")


def scores(docs):
    return {(r.doc_id, r.n_tokens): r.score for r in lm_scoring.score(docs).collect()}


@pytest.fixture(scope="module")
def expected(docs):  # with the session's 10,000 rows a batch
    return scores(docs)


@pytest.mark.parametrize("rows", [32, 1024])
def test_any_batch_size(spark, docs, expected, rows):
    before = spark.conf.get(ROWS)
    spark.conf.set(ROWS, str(rows))
    try:
        assert scores(docs) == pytest.approx(expected, rel=1e-5)
    finally:
        spark.conf.set(ROWS, before)


def test_any_partitions(docs, expected):
    assert scores(docs.repartition(5)) == pytest.approx(expected, rel=1e-5)


def test_several_groups_a_replica(spark, docs, monkeypatch):
    """With groups far below a replica's tokens, batches and partitions still don't matter."""
    monkeypatch.setattr(lm_scoring, "groups", lambda batches, make=lm_scoring.groups: make(batches, 2000))
    want = scores(docs)
    monkeypatch.setattr(lm_scoring, "WIDE", 17)
    assert scores(docs.repartition(3)) == pytest.approx(want, rel=1e-5)


def test_groups_ignore_batches():
    import numpy as np
    import pyarrow as pa

    texts = [list(range(n)) for n in (3, 0, 9, 1, 1, 20, 2)]
    for size in (1, 2, 7):
        batches = [pa.RecordBatch.from_pydict({"ids": pa.array(texts[a : a + size], pa.list_(pa.int32()))}) for a in range(0, 7, size)]
        assert [[len(t) for t in g] for g in lm_scoring.groups(batches, 10)] == [[3, 0, 9], [1, 1, 20], [2]]
        assert all(isinstance(t, np.ndarray) for g in lm_scoring.groups(batches, 10) for t in g)


def test_other_queries_leave_the_session_alone(spark, docs, expected):
    before = {k: spark.conf.get(k) for k in (ROWS, "spark.sql.shuffle.partitions")}
    suffix_dedup.strip(docs).collect()
    sentencepiece_codec.digest(docs).count()
    decontaminate.search(docs, spark.read.parquet(f"{duck.SF}/benchmark.parquet")).count()
    chat_format.rotate(spark.read.parquet(f"{duck.SF}/conversations.parquet")).count()
    assert {k: spark.conf.get(k) for k in before} == before
    assert scores(docs) == pytest.approx(expected, rel=1e-5)

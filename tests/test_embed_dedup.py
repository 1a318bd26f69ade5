"""Embedding of distinct texts: one computation a text, one deal of the rows."""

import numpy as np
import pytest

from skein.operators import embed as E


def rows(copies=40):
    out = [(i, f"text {i % 7}") for i in range(60)] + [(100 + i, "crowd") for i in range(copies)]
    return out + [(200, None), (201, None), (202, ""), (None, "text 3"), (203, "née  ü")]


@pytest.mark.parametrize("many", [10, 10_000])
@pytest.mark.parametrize("batch", ["3", "10000"])
def test_every_row_has_its_texts_vector(spark, many, batch):
    df = spark.createDataFrame(rows(), "id long, chunk string").repartition(5)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        made = E.embed_dedup(df, "chunk", many=many)
        assert made.columns == ["text_hash", "id", "chunk", "embedding"]
        got = made.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert sorted((str(r.id), str(r.chunk)) for r in got) == sorted((str(i), str(t)) for i, t in rows())
    fn = E.hashed_embedder()
    for r in got:
        if r.chunk is None:
            assert r.embedding is None and r.text_hash is None
        else:
            assert np.array_equal(np.array(r.embedding, np.float32), fn([r.chunk])[0])


@pytest.mark.parametrize("many", [10, 10_000])
def test_each_text_is_embedded_once(spark, many):
    seen = spark.sparkContext.accumulator(0)

    def fn(texts):
        seen.add(len(texts))
        return np.ones((len(texts), 2))
    df = spark.createDataFrame(rows(), "id long, chunk string").repartition(5)
    assert E.embed_dedup(df, "chunk", fn=fn, many=many).where("embedding is not null").count() == 103
    assert seen.value == 10


def test_texts_are_dealt_once(spark):
    df = spark.createDataFrame(rows(), "id long, chunk string")
    plan = E.embed_dedup(df, "chunk")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, chunk string")
    assert [r.embedding for r in E.embed_dedup(df, "chunk").collect()] == [None, None]
    assert E.embed_dedup(df.where("id > 5"), "chunk").count() == 0

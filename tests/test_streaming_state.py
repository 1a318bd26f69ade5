"""List state with a time to live, restarts, late rows; the streamed catalog."""

import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from skein.session import ship_package
from skein.streaming import incremental as S

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
#: processing-time state asks for another batch after each, so that a run would not end
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"
MESSAGES = "session_id string, seq long, role string, content string"


@pytest.fixture
def rocksdb(spark):
    ship_package(spark)
    before = {k: spark.conf.get(k, None) for k in (PROVIDER, NO_DATA)}
    spark.conf.set(PROVIDER, S.ROCKSDB)
    spark.conf.set(NO_DATA, "false")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def feed(spark, base, name, rows):
    spark.createDataFrame(rows, MESSAGES).coalesce(1).write.parquet(os.path.join(base, "in", name))


def run(spark, base, ttl, turns=2):
    """One run over what is new in the folder: the last history of each session."""
    stream = spark.readStream.schema(MESSAGES).parquet(os.path.join(base, "in", "*"))
    seen = {}

    def keep(df, _id):
        for r in df.orderBy("seq").collect():
            seen.setdefault(r["session_id"], []).append((r["seq"], r["content"]))
    q = (S.session_state_stream(stream, turns, ttl).writeStream.outputMode("update").foreachBatch(keep)
         .option("checkpointLocation", os.path.join(base, "ck")).trigger(availableNow=True).start())
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()
    return seen


def test_list_state_over_restarts(spark, rocksdb):
    """Each run is a new query on the same checkpoint."""
    base = tempfile.mkdtemp(prefix="skein-state-")
    feed(spark, base, "a", [("s", k, "user", f"m{k}") for k in (0, 1, 5, 6)] + [("t", 0, "user", "x")])
    assert run(spark, base, None)["s"] == [(0, "m0"), (1, "m1"), (5, "m5"), (6, "m6")]
    # a late message takes its place, one older than the history goes, one comes again
    feed(spark, base, "b", [("s", 3, "user", "late"), ("s", 6, "user", "m6 again"), ("s", -4, "user", "too old")])
    got = run(spark, base, None)
    assert got == {"s": [(1, "m1"), (3, "late"), (5, "m5"), (6, "m6 again")]}


def test_state_expires(spark, rocksdb):
    base = tempfile.mkdtemp(prefix="skein-ttl-")
    feed(spark, base, "a", [("s", 0, "user", "old"), ("s", 1, "assistant", "old too")])
    assert [m for m, _ in run(spark, base, 2.0)["s"]] == [0, 1]
    time.sleep(3)
    feed(spark, base, "b", [("s", 2, "user", "new")])
    assert run(spark, base, 2.0)["s"] == [(2, "new")]


def test_provider_is_asked_for(spark):
    stream = spark.readStream.schema(MESSAGES).parquet(tempfile.mkdtemp(prefix="skein-none-"))
    with pytest.raises(ValueError):
        S.session_state_stream(stream)


def test_streamed_catalog(spark):
    base = tempfile.mkdtemp(prefix="skein-cat-")
    schema = "article_id string, title string, chunks int, ingested_at timestamp"

    def batch(name, rows):
        (spark.createDataFrame(rows, "article_id string, title string, chunks int, at string")
         .select("article_id", "title", "chunks", F.to_timestamp("at").alias("ingested_at"))
         .coalesce(1).write.parquet(os.path.join(base, "in", name)))

    def go():
        stream = spark.readStream.schema(schema).parquet(os.path.join(base, "in", "*"))
        S.catalog_stream(stream, os.path.join(base, "out"), os.path.join(base, "ck")).awaitTermination(60)
        return {r["article_id"]: (r["title"], r["chunks"])
                for r in S.read_catalog(spark, os.path.join(base, "out")).collect()}
    batch("a", [("u1", "first", 1, "2024-01-01 10:00:00"), ("u2", "two", 2, "2024-01-01 10:05:00")])
    assert go() == {"u1": ("first", 1), "u2": ("two", 2)}
    # the same row again, a newer one, a late older one
    batch("b", [("u1", "first", 1, "2024-01-01 10:00:00"), ("u1", "newer", 3, "2024-01-01 10:30:00"),
                ("u2", "older", 9, "2024-01-01 09:50:00")])
    assert go() == {"u1": ("newer", 3), "u2": ("two", 2)}
    # a batch that is run again replaces its own version
    versions = S._versions(spark, os.path.join(base, "out"))
    assert versions == sorted(set(versions)) and len(versions) >= 2

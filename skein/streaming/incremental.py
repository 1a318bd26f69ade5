"""Incremental forms of the batch operators on Structured Streaming.

* ``ingest_pages_stream``  new page files -> extract -> chunk -> embed ->
  append to the vector table, one ``foreachBatch`` per micro-batch (the same
  transforms as the batch path; the sink is idempotent per batch id).
* ``session_history_stream``  messages -> bounded per-session history kept
  in state (``applyInPandasWithState``), emitting each changed session's
  last ``2 * max_turns`` messages.
* ``session_state_stream``  the same on list state with a time to live
  (``transformWithStateInPandas`` over RocksDB).
* ``catalog_stream``  the article catalog from re-delivered and late rows.
* ``latency_windows``  event-time tumbling windows with a watermark, so late
  data within the delay is counted and state is dropped after it.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.state import GroupStateTimeout

from skein.operators import chunk as C
from skein.operators import embed as E
from skein.operators.extract import extract_articles

PAGES_SCHEMA = "page_id long, url string, html string"


def ingest_pages_stream(spark: SparkSession, pages_dir: str, vectors_path: str,
                        checkpoint: str, trigger_once: bool = True,
                        max_files_per_trigger: int | None = None):
    """Start the streaming ingestion; returns the ``StreamingQuery``."""
    reader = spark.readStream.schema(PAGES_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    pages = reader.parquet(pages_dir)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        arts = extract_articles(batch)
        chunks = C.chunk_fixed(arts.select("page_id", F.col("url").alias("article_id"),
                                           "title", "url", "text"))
        vecs = E.embed_dedup(chunks, "chunk")
        (vecs.withColumn("batch_id", F.lit(batch_id))
         .write.mode("overwrite").parquet(f"{vectors_path}/batch_id={batch_id}"))

    w = pages.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="10 seconds")
    return w.start()


def session_history_stream(messages: DataFrame, max_turns: int = 10) -> DataFrame:
    """Per session, the last ``2 * max_turns`` messages after each batch.

    Input: streaming ``session_id, seq, role, content``.  Output rows:
    ``session_id, seq, role, content`` for every message in the retained
    window of each session touched in the batch (update mode).
    """
    keep = 2 * max_turns
    out_schema = "session_id string, seq long, role string, content string"
    state_schema = "seq array<long>, role array<string>, content array<string>"

    def update(key, pdfs, state):
        if state.exists:
            s, r, c = state.get
            cur = pd.DataFrame({"seq": list(s), "role": list(r), "content": list(c)})
        else:
            cur = pd.DataFrame({"seq": [], "role": [], "content": []})
        for pdf in pdfs:
            cur = pd.concat([cur, pdf[["seq", "role", "content"]]], ignore_index=True)
        cur = cur.sort_values("seq", kind="stable").tail(keep)
        state.update((cur["seq"].astype("int64").tolist(), cur["role"].tolist(),
                      cur["content"].tolist()))
        yield cur.assign(session_id=key[0])[["session_id", "seq", "role", "content"]]

    return (messages.groupBy("session_id")
            .applyInPandasWithState(update, out_schema, state_schema, "update",
                                    GroupStateTimeout.NoTimeout))


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HISTORY_SCHEMA = "session_id string, seq long, role string, content string"
_MESSAGE_STATE = "seq long, role string, content string"


class SessionHistory(StatefulProcessor):
    """The last ``keep`` messages of a session as list state.

    Every message that arrives renews the session's time to live; a session that is
    silent for longer is forgotten.  Late messages take the place that their ``seq``
    gives them among those held; ones older than all of a full history are dropped, and
    a message that is delivered again (same ``seq``) replaces itself."""

    def __init__(self, keep: int, ttl_seconds: float | None):
        self.keep, self.ttl = keep, ttl_seconds

    def init(self, handle) -> None:
        ttl = None if self.ttl is None else int(self.ttl * 1000)
        self.messages = handle.getListState("messages", _MESSAGE_STATE, ttl)

    def handleInputRows(self, key, rows, timerValues):
        held = {m[0]: tuple(m) for m in self.messages.get()} if self.messages.exists() else {}
        for pdf in rows:
            for m in pdf[["seq", "role", "content"]].itertuples(index=False):
                held[int(m[0])] = (int(m[0]), m[1], m[2])
                if len(held) > 2 * self.keep:       # bounded however many rows arrive
                    for old in sorted(held)[:-self.keep]:
                        del held[old]
        last = [held[k] for k in sorted(held)[-self.keep:]]
        self.messages.put(last)
        yield pd.DataFrame([(key[0], *m) for m in last], columns=["session_id", "seq", "role", "content"])

    def close(self) -> None:
        pass


def session_state_stream(messages: DataFrame, max_turns: int = 10,
                         ttl_seconds: float | None = None) -> DataFrame:
    """``session_history_stream`` on list state with a time to live, for sessions that
    end without saying so.  Output (update mode): the retained messages of each session
    that the batch touched.

    Processing-time state makes Spark plan a batch after each batch; a run that is to end
    (``availableNow``) sets ``spark.sql.streaming.noDataMicroBatches.enabled`` to false.
    State lives in RocksDB, on disk and in the checkpoint's change log: the session must
    name that provider in ``spark.sql.streaming.stateStore.providerClass``."""
    spark = messages.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    return messages.groupBy("session_id").transformWithStateInPandas(
        SessionHistory(2 * max_turns, ttl_seconds), HISTORY_SCHEMA, "Update", "ProcessingTime")


def catalog_stream(updates: DataFrame, path: str, checkpoint: str, key: str = "article_id",
                   order_col: str = "ingested_at", delay: str = "1 hour"):
    """Keep an article catalog from a stream of its rows: one newest row an article.

    Rows that are delivered again within ``delay`` (same key and time) are dropped by a
    watermark-bounded state.  Each micro-batch is merged with the last version of the
    catalog into a fresh one, named by the batch: a batch that is run again after a
    failure overwrites its own version and reads the one before, so it counts once.
    Late rows never replace newer ones.  Returns the ``StreamingQuery``; ``read_catalog``
    reads the newest version."""
    from skein.sources.tables import catalog_upsert
    fresh = updates.withWatermark(order_col, delay).dropDuplicatesWithinWatermark([key, order_col])

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, path) if v < batch_id]
        old = spark.read.parquet(f"{path}/version={max(before)}") if before else None
        catalog_upsert(old, batch, key, order_col).write.mode("overwrite").parquet(f"{path}/version={batch_id}")
    return (fresh.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the whole versions under ``path`` (those with a success marker)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/_SUCCESS")
    found = root.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(root)
    return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of a catalog kept by ``catalog_stream``."""
    return spark.read.parquet(f"{path}/version={_versions(spark, path)[-1]}")


def latency_windows(events: DataFrame, value: str = "value", ts: str = "ts",
                    window: str = "1 hour", delay: str = "10 minutes",
                    by: list[str] | None = None) -> DataFrame:
    """count, mean, min, max and p50/p90/p99 per tumbling event-time window
    (and ``by`` keys), with a watermark of ``delay``."""
    keys = [F.window(ts, window).alias("window")] + [F.col(c) for c in (by or [])]
    v = F.col(value).cast("double")
    pct = F.percentile_approx(v, [0.5, 0.9, 0.99], 10000)
    # watermarks need TIMESTAMP (the source may store TIMESTAMP_NTZ)
    events = events.withColumn(ts, F.col(ts).cast("timestamp"))
    return (events.withWatermark(ts, delay).groupBy(*keys)
            .agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.min(v).alias("min"),
                 F.max(v).alias("max"), pct.alias("_p"))
            .select("*", F.col("_p")[0].alias("p50"), F.col("_p")[1].alias("p90"),
                    F.col("_p")[2].alias("p99")).drop("_p"))

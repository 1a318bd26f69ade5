"""Session persistence: one JSON object per session, messages nested.

Each line holds ``session_id, created_at, messages[{seq, role, content,
timestamp}]``; a session may have no messages.
Reading uses PERMISSIVE mode with a corrupt-record column, so a damaged
line is skipped (the session is "not loaded") instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MESSAGES = "array<struct<seq:long,role:string,content:string,timestamp:timestamp>>"
SESSION_SCHEMA = f"session_id string, created_at timestamp, messages {_MESSAGES}, _corrupt_record string"


def save_sessions(messages: DataFrame, path: str, mode: str = "overwrite",
                  max_turns: int | None = 10, sessions: DataFrame | None = None) -> None:
    """Nest each session's message list and write JSON lines.

    A session keeps its last ``max_turns`` turns (as the store does after
    every append), so the list gathered per session is bounded.  ``messages``
    may carry a ``timestamp``.  ``sessions`` (``session_id`` and, if known,
    ``created_at``) lists sessions that are stored even without messages."""
    if max_turns is not None:
        from skein.operators.sessions import history_last_n
        messages = history_last_n(messages, max_turns)
    when = F.col("timestamp") if "timestamp" in messages.columns else F.lit(None)
    nested = messages.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("seq").cast("long").alias("seq"), "role", "content",
            when.cast("timestamp").alias("timestamp")))).alias("messages"))
    made = F.current_timestamp()
    if sessions is not None:
        since = F.col("created_at") if "created_at" in sessions.columns else F.lit(None).cast("timestamp")
        known = sessions.groupBy("session_id").agg(F.min(since).alias("created_at"))
        nested = nested.join(known, "session_id", "full")
        made = F.coalesce("created_at", made)
    nested.select("session_id", made.alias("created_at"),
                  F.coalesce("messages", F.array().cast(_MESSAGES)).alias("messages")) \
        .write.mode(mode).json(path)


def _read(spark: SparkSession, path: str) -> DataFrame:
    raw = (spark.read.schema(SESSION_SCHEMA)
           .option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", "_corrupt_record")
           .json(path))
    return raw.filter(F.col("_corrupt_record").isNull() & F.col("session_id").isNotNull())


def load_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Flat messages of every readable session (corrupt lines skipped)."""
    return _read(spark, path).select("session_id", F.inline("messages"))


def list_sessions(spark: SparkSession, path: str) -> DataFrame:
    """``session_id, created_at, message_count`` of every readable session,
    those without messages too."""
    return _read(spark, path).select(
        "session_id", "created_at",
        F.coalesce(F.size("messages"), F.lit(0)).cast("long").alias("message_count"))

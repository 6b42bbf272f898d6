"""Structured Streaming jobs: files and commits that change, requests to store, captures.

An index lives in buckets that are published together (operators.index_store): a batch reads and writes those of its
paths only, readers see whole batches, and a batch that is run again after a failure ends the same.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.scalars import at_time, is_excluded, language_of
from tidemark.operators.index_store import refresh_commits, refresh_files
from tidemark.operators.memory import DEDUP_WINDOW, prepare_memories
from tidemark.operators.vectors import Embedder

DRAIN = "500 milliseconds"
STORE_SCHEMA = "id string, project_id string, session_id string, content_hash string, title string, content string, created_at timestamp, kept boolean, dup_of string"


def stream_dirty_paths(events: DataFrame) -> DataFrame:
    """Events (path, kind) of files that the index would hold. What the event was doesn't matter: the file's state
    now does."""
    return events.filter("kind in ('create', 'modify', 'remove')").filter(~is_excluded("path") & language_of("path").isNotNull()).select("path")


def started(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DRAIN)).start()


def run_incremental_index(stream: DataFrame, root: str, read_files: Callable[[DataFrame], DataFrame], embedder: Embedder, now, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keeps the index at root fresh: each batch's distinct dirty paths go to read_files, which gives (path, text,
    content_hash) of those that still are; the others are dropped from the index."""

    def each(batch: DataFrame, _: int) -> None:
        refresh_files(batch.sparkSession, root, batch.select("path").distinct(), read_files, embedder, now)

    return started(stream_dirty_paths(stream), each, checkpoint, once)


def run_commit_updates(stream: DataFrame, root: str, now, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Each batch of new changes renews churn, hotspots and links of the files in it."""

    def each(batch: DataFrame, _: int) -> None:
        refresh_commits(batch.sparkSession, root, batch, now)

    return started(stream, each, checkpoint, once)


def stream_store(requests: DataFrame, window_secs: int = DEDUP_WINDOW, watermark: str = "10 minutes") -> DataFrame:
    """Requests with created_at, redacted, hashed and judged as dedup_window does: a key's state is the time and id of its
    last kept row. Rows of a batch are sorted by time; a row older than the last kept one counts as within its window;
    rows behind the watermark are dropped."""
    rows = prepare_memories(requests.withColumn("_at", F.col("created_at").cast("timestamp")), at_time("1970-01-01 00:00:00"))
    rows = rows.withColumns({"created_at": F.col("_at"), "session_id": F.coalesce("session_id", F.lit(""))}).drop("_at").withWatermark("created_at", watermark)
    columns = [c.split()[0] for c in STORE_SCHEMA.split(", ")]

    def judge(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["created_at", "id"], kind="stable")
        last, owner = state.get if state.exists else (None, None)
        kept, dup = [], []
        for t, i in zip(rows["created_at"], rows["id"], strict=True):
            micros = int(t.value // 1000)
            keep = last is None or micros - last >= window_secs * 1_000_000
            kept.append(keep)
            dup.append(None if keep else owner)
            if keep:
                last, owner = micros, i
        state.update((last, owner))
        state.setTimeoutTimestamp(max(last // 1000 + window_secs * 1000, state.getCurrentWatermarkMs()) + 1)
        yield rows.assign(kept=kept, dup_of=dup)[columns]

    keyed = rows.select(*[c for c in columns if c not in ("kept", "dup_of")]).groupBy("content_hash", "session_id")
    return keyed.applyInPandasWithState(judge, STORE_SCHEMA, "last long, owner string", "append", "EventTimeTimeout")


def stream_captures(notes: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Notes (id, project_id, captured_at, summary, context?) appended to the captures table at path."""
    rows = notes.select("id", "project_id", "captured_at", F.coalesce("context", F.lit("note")).alias("tool_name"), "summary", F.col("summary").alias("raw_data"), F.lit(None).cast("timestamp").alias("presented_at"))
    writer = rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

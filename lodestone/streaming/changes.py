"""The change queue, as batch expressions and as streams.

Changes are rows (project_id, file_path, event_type, queued_at). Watermarks and
late data are ours to choose: events later than the watermark are dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ["project_id", "file_path"]
CHANGE = "project_id long, file_path string, event_type string, queued_at timestamp"


def watch_files(spark: SparkSession, root: str, files_per_trigger: int = 256) -> DataFrame:
    """New files below root as a stream of modify events; back-pressure instead of drops. Deletions come from an events table."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(root)
    return files.select(F.lit(0).cast("long").alias("project_id"), F.col("path").alias("file_path"), F.lit("modify").alias("event_type"), F.col("modificationTime").alias("queued_at"))


def debounced(changes: DataFrame, gap: str = "500 milliseconds", watermark: str | None = None) -> DataFrame:
    """One row per file and burst of changes less than ``gap`` apart: the last event of it. Works on batches and streams."""
    rows = changes.withWatermark("queued_at", watermark) if watermark else changes
    window = F.session_window("queued_at", gap)
    out = rows.groupBy(*KEY, window.alias("w")).agg(F.max_by("event_type", "queued_at").alias("event_type"), F.count(F.lit(1)).alias("n_events"))
    return out.select(*KEY, "event_type", "n_events", F.col("w.start").alias("first_at"), F.col("w.end").alias("until"))


def coalesced(changes: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The queue the changes leave: per file the last event, by time and then by ``order``; an aggregate with map-side combine."""
    by = F.struct("queued_at", *(order or []))
    return changes.groupBy(*KEY).agg(F.max_by("event_type", by).alias("event_type"), F.max("queued_at").alias("queued_at"))


def oldest(queue: DataFrame, n: int = 1) -> DataFrame:
    """The next entries to work on."""
    return queue.orderBy("queued_at", *KEY).limit(n)


def start(changes: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs ``work`` on the coalesced changes of every micro-batch. A failed batch is tried again from the checkpoint, so nothing is lost; work must be idempotent."""

    def batch(rows: DataFrame, number: int) -> None:
        work(coalesced(rows), number)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def keyed_queue(changes: DataFrame) -> DataFrame:
    """The queue as a stream with keyed state: an update row per file with its last event. The state is one event per file."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        for pdf in batches:
            for t, e in zip(pdf["queued_at"], pdf["event_type"]):
                if last is None or t >= pd.Timestamp(last[1]):
                    last = (e, t.to_pydatetime())
        if last is not None:
            state.update(last)
            yield pd.DataFrame({"project_id": [key[0]], "file_path": [key[1]], "event_type": [last[0]], "queued_at": [pd.Timestamp(last[1])]})

    return changes.groupBy(*KEY).applyInPandasWithState(run, CHANGE, "event_type string, queued_at timestamp", "update", GroupStateTimeout.NoTimeout)


def limited(events: DataFrame, key: str, capacity: int = 60, per_seconds: float = 60.0, at: str = "ts", tie: str = "event_id") -> DataFrame:
    """events with ``allowed``: a token bucket per key, full at first, refilled at capacity / per_seconds.

    A bucket is sequential in time per key, so each key's events are folded in
    order by one expression. Keys are users; one user's events fit in a task.
    """
    seconds = F.unix_micros(F.col(at).cast("timestamp")) / F.lit(1e6)
    rows = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(seconds.alias("t"), F.col(tie).alias("id")))).alias("es"))
    zero = F.expr(f"named_struct('tokens', {float(capacity)}D, 'last', CAST(NULL AS DOUBLE), 'out', CAST(array() AS array<struct<id:bigint,allowed:boolean>>))")

    def step(acc, e):
        grown = F.least(F.lit(float(capacity)), acc["tokens"] + F.coalesce(e["t"] - acc["last"], F.lit(0.0)) * (capacity / per_seconds))
        ok = grown >= 1.0
        return F.struct(F.when(ok, grown - 1.0).otherwise(grown).alias("tokens"), e["t"].alias("last"), F.concat(acc["out"], F.array(F.struct(e["id"].alias("id"), ok.alias("allowed")))).alias("out"))

    return rows.select(key, F.explode(F.aggregate("es", zero, step)["out"]).alias("x")).select(key, F.col("x.id").alias(tie), F.col("x.allowed").alias("allowed"))

"""Structured Streaming over the event log: windowed counts, duplicates and the stateless cleaner, for any streaming source."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.operators.lines import clean_lines, settled
from docforge.sources.sinks import append_batch


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events by type and window; a window is final once the watermark has passed it."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def distinct_events(events: DataFrame, key: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key) if events.isStreaming else events.dropDuplicates(key)


def cleaned_lines(lines: DataFrame) -> DataFrame:
    """The line cleaner keeps no state, so it runs on a stream as it is."""
    return settled(clean_lines(lines), ["rule", "kept", "clean"]).where("kept")


def append_stream(events: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """A stream of events that goes to a log exactly once: a batch that is tried again replaces what it wrote, and a restart
    goes on behind the last batch that was committed. Returns the running query; it ends by itself with availableNow."""
    writer = events.writeStream.foreachBatch(lambda rows, batch: append_batch(rows, path, batch)).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


STALE = "chunk_id bigint, status string, since timestamp"


def stale_work(events: DataFrame, after: str = "30 minutes", late: str = "10 minutes", working: str = "PROCESSING", failed: str = "FAILED") -> DataFrame:
    """(chunk_id, failed, since) of chunks whose last event left them in work and that say nothing for ``after``.

    events: chunk_id, status, ts. State is two values a chunk: its newest event, and a timer while it is in work. The
    watermark fires timers, so a restarted stream fails the same chunks as one that never stopped, each once a stretch of
    work. A chunk that goes on after it was failed is in work again. Null ids and times are left out.
    """
    wait = int(events.sparkSession.sql(f"SELECT unix_seconds(timestamp_seconds(0) + INTERVAL {after})").first()[0]) * 1000

    def judge(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            since = state.get[0]
            state.remove()
            yield pd.DataFrame({"chunk_id": [key[0]], "status": [failed], "since": [pd.Timestamp(since, unit="us")]})
            return
        newest, status = state.get if state.exists else (-1, "")
        for frame in frames:
            for ts, now in zip(frame["ts"].astype("datetime64[us]").astype("int64"), frame["status"]):
                if (ts, now or "") > (newest, status):
                    newest, status = int(ts), now or ""
        state.update((newest, status))
        if status == working:
            state.setTimeoutTimestamp(max(newest // 1000 + wait, state.getCurrentWatermarkMs() + 1))

    rows = events.where("chunk_id IS NOT NULL AND ts IS NOT NULL").select("chunk_id", "status", "ts").withWatermark("ts", late)
    return rows.groupBy("chunk_id").applyInPandasWithState(judge, STALE, "newest bigint, status string", "append", "EventTimeTimeout")


def stale_chunks(events: DataFrame, until, after: str = "30 minutes", working: str = "PROCESSING", failed: str = "FAILED") -> DataFrame:
    """The same of a table, as of the watermark ``until``: chunks whose newest event by then left them in work too long."""
    newest = events.where("chunk_id IS NOT NULL AND ts IS NOT NULL").groupBy("chunk_id").agg(F.max(F.struct("ts", F.coalesce("status", F.lit("")).alias("status"))).alias("x"))
    return newest.where((F.col("x.status") == working) & (F.col("x.ts") + F.expr(f"INTERVAL {after}") < F.lit(until))).select("chunk_id", F.lit(failed).alias("status"), F.col("x.ts").alias("since"))

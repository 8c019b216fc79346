"""Structured Streaming forms: activity windows, deduplication, reading logs, hot-streak detection, sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_files(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; the checkpoint remembers which were read, as a cursor would."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def activity(events: DataFrame, route: Column, ts: Column, reads: Column, writes: Column, step: str = "60 seconds", grace: str = "2 minutes") -> DataFrame:
    """Windows of activity by route, sent once the watermark has passed them; later events are left out."""
    rows = events.select(route.alias("route_id"), ts.cast("timestamp").alias("ts"), reads.alias("r"), writes.alias("w")).withWatermark("ts", grace)
    counted = rows.groupBy(F.window("ts", step), "route_id").agg(F.sum("r").alias("reads"), F.sum("w").alias("writes"))
    return counted.select("route_id", F.col("window.end").alias("at"), "reads", "writes")


def deduplicate(messages: DataFrame, ts: str, keys: list[str], window: str = "5 minutes") -> DataFrame:
    """First message of each key within the watermark's window; bounded state. queues.deduplicate has the exact windows."""
    return messages.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, window).dropDuplicatesWithinWatermark(keys)


def hot_streaks(windows: DataFrame, threshold: float, least: int) -> DataFrame:
    """route_id, at, streak of windows (route_id, at in ms, score) at the threshold `least` times in a row or more; state per route."""

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        rows = []
        for pdf in frames:
            for r in pdf.sort_values("at").itertuples():
                streak = streak + 1 if r.score >= threshold else 0
                if streak >= least:
                    rows.append((key[0], int(r.at), streak))
        state.update((streak,))
        yield pd.DataFrame(rows, columns=["route_id", "at", "streak"])

    return windows.groupBy("route_id").applyInPandasWithState(step, "route_id string, at long, streak long", "streak long", "append", GroupStateTimeout.NoTimeout)


def dual_write(stream: DataFrame, primary: Callable[[DataFrame], None], secondary: Callable[[DataFrame], None], checkpoint: str, **trigger) -> StreamingQuery:
    """Each batch to two sinks; the second one's failure stops the query before the batch is committed."""

    def both(batch: DataFrame, epoch: int) -> None:
        kept = batch.persist()
        try:
            primary(kept)
            secondary(kept)
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drain(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a stream to Parquet, by default what is there now."""
    return stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

"""Resumable scoring: rows done are skipped, a bad row is a status, and a stream goes on from its checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from ..operators.relational import pending


def score_pending(df: DataFrame, done: DataFrame, key: str, status: Column) -> DataFrame:
    return pending(df, done, key).select(key, status.alias("status"))


def score_incremental(stream: DataFrame, score: Callable[[DataFrame], DataFrame], key: str, checkpoint: str, sink: str, ts: str | None = None, within: str | None = None):
    """Start a query that scores each key once and appends it.

    Keys that are done are the state of a streaming deduplication, which the checkpoint keeps over restarts, so a key of an earlier batch is not scored again. With ts and within,
    keys are remembered for that span of event time (the watermark) only, which bounds the state. A batch that is run again overwrites its own folder and leaves no second copy.
    """
    if ts is not None and within is not None:
        fresh = stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])
    else:
        fresh = stream.dropDuplicates([key])

    def write(batch: DataFrame, batch_id: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return fresh.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

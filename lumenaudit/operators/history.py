"""Analysis records: recovery, lifecycle, append and delete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE = "Analysis did not finish and was marked as failed."


def recover_stale(df: DataFrame, status: str, open_states: list[str], created: str, cutoff: Column) -> DataFrame:
    """df with status, recovered, explanation: records left open since before the cut-off have failed; others stay. Again is no change."""
    stale = F.col(status).isin(*open_states) & (F.col(created).isNull() | (F.col(created) <= cutoff))
    stale = F.coalesce(stale, F.lit(False))
    return df.withColumn("recovered", stale).withColumn("explanation", F.when(stale, STALE)).withColumn("status", F.when(stale, "failed").otherwise(F.col(status)))


def lifecycle(events: DataFrame, key: str, status: str, ts: str) -> DataFrame:
    """Latest status of each record and the time from its first event to its last."""
    return events.groupBy(key).agg(F.max_by(status, ts).alias("status"), F.min(ts).alias("a"), F.max(ts).alias("b")).select(key, "status", F.expr("cast(floor(unix_micros(cast(b as timestamp)) / 1000) - floor(unix_micros(cast(a as timestamp)) / 1000) as long)").alias("duration_ms"))


def append_rows(df: DataFrame, new: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    for c, v in defaults.items():
        if c not in new.columns:
            new = new.withColumn(c, v)
    return df.unionByName(new.select(*df.columns))


def delete_ids(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, ids that were not found)."""
    gone = ids.select(key).distinct()
    return df.join(gone, key, "left_anti"), gone.join(df.select(key), key, "left_anti")

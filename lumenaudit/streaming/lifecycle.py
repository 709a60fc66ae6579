"""Records over their status events, as one aggregation and as a stream with event-time timers that agree on any log.

A record opens with a `pending` event; a later `pending` starts it anew. Events are ordered by time and number, so that equal times leave nothing to chance. A record whose last
status is an end is completed then; one that is open for stale_s seconds after its start has failed at that moment, whatever came in between but an end. An event after that counts again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.history import STALE

#: The status that opens a record, those that end it, and the one given to stale ones; seconds until a record is stale.
OPENS, ENDS, FAILED = "pending", ("completed", "failed"), "failed"
STALE_S = 300.0

_COLUMNS = ["status", "started_at", "completed_at", "duration_ms", "recovered", "explanation"]


def _fate(last: Column, start: Column, at: Column, now: Column, stale_s: float) -> list[Column]:
    """Columns of a record in microseconds."""
    due = start + F.lit(int(stale_s * 1e6))
    ended = last.isin(*ENDS)
    stale = F.coalesce(~ended & (due <= now), F.lit(False))
    done = F.when(ended, at).when(stale, due)
    time = F.timestamp_micros
    return [
        F.when(stale, FAILED).otherwise(last).alias("status"), time(start).alias("started_at"), time(done).alias("completed_at"),
        F.floor((done - start) / 1000).cast("long").alias("duration_ms"), stale.alias("recovered"), F.when(stale, STALE).alias("explanation"),
    ]


def records(events: DataFrame, key: str, status: str, ts: str, number: str, now: Column, stale_s: float = STALE_S) -> DataFrame:
    """key, status, started_at, completed_at, duration_ms, recovered, explanation of every record as of now."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    place = F.struct(at.alias("at"), F.col(number).cast("long").alias("number"))
    # One pass, pre-aggregated: no record's events meet as rows.
    g = events.groupBy(key).agg(
        F.max(F.when(F.col(status) == OPENS, place)).alias("opened"), F.min(at).alias("first"), F.max(F.struct(place.alias("place"), F.col(status).alias("status"))).alias("last"),
    )
    start = F.coalesce("opened.at", "first")
    return g.select(key, *_fate(F.col("last.status"), start, F.col("last.place.at"), F.unix_micros(now.cast("timestamp")), stale_s))


def recovered(found: DataFrame) -> DataFrame:
    """One row: how many records were found stale."""
    return found.agg(F.count_if("recovered").alias("recovered"))


def record_stream(events: DataFrame, key: str, status: str, ts: str, number: str, stale_s: float = STALE_S, keep_s: float = 86_400.0) -> DataFrame:
    """The same rows over a stream with a watermark on ts, in update mode: one for a record with each batch that has events of it, and one when it goes stale.

    State is one row a record: its start, its first and its last event. An ended record is forgotten keep_s seconds after its end; an event that comes later than that begins a new one.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = events.schema[key].dataType.simpleString()
    out = f"{key} {kind}, status string, started_at timestamp, completed_at timestamp, duration_ms long, recovered boolean, explanation string"
    rows = events.select(key, F.col(status).alias("status"), F.col(ts).alias("event_time"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.col(number).cast("long").alias("number"))
    wait, keep = int(stale_s * 1e6), int(keep_s * 1e6)

    def shown(k, last: str, start: int, at: int, stale: bool) -> pd.DataFrame:
        done = start + wait if stale else at if last in ENDS else None
        stamp = lambda v: pd.Timestamp(v, unit="us", tz="UTC") if v is not None else pd.NaT
        row = [*k, FAILED if stale else last, stamp(start), stamp(done), None if done is None else (done - start) // 1000, stale, STALE if stale else None]
        frame = pd.DataFrame([row], columns=[key, *_COLUMNS])
        return frame.astype({"duration_ms": "Int64"})

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get if state.exists else None
        if state.hasTimedOut:
            opened, first, at, number_, last, stale = seen
            start = first if opened < 0 else opened
            if last in ENDS or stale:
                state.remove()
                return
            state.update((opened, first, at, number_, last, True))
            state.setTimeoutTimestamp(max((start + wait + keep) // 1000, state.getCurrentWatermarkMs() + 1))
            yield shown(k, last, start, at, True)
            return
        opened, first, at, number_, last, _ = seen or (-1, None, -1, -1, "", False)
        for pdf in batches:
            for s, t, n in zip(pdf["status"].tolist(), pdf["at"].tolist(), pdf["number"].tolist(), strict=True):
                first = t if first is None else min(first, t)
                if s == OPENS:
                    opened = max(opened, t)
                if (t, n) > (at, number_):
                    at, number_, last = t, n, s
        start = first if opened < 0 else opened
        stale = last not in ENDS and start + wait <= state.getCurrentWatermarkMs() * 1000
        state.update((opened, first, at, number_, last, stale))
        ends = (at + keep if last in ENDS else start + wait + keep if stale else start + wait) // 1000
        state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs() + 1))
        yield shown(k, last, start, at, stale)

    kept = "opened long, first long, at long, number long, last string, stale boolean"
    return rows.groupBy(key).applyInPandasWithState(run, out, kept, "update", GroupStateTimeout.EventTimeTimeout)

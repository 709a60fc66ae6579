"""Sliding-window admission: a request is rejected where its key has had max_n accepted within the window; rejected ones do not count."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Budget:
    """Accepted times of one key within the window: at most max_n."""

    def __init__(self, max_n: int, window: float, times=()):
        self.max_n, self.window, self.times = max_n, window, deque(times)

    def allow(self, at: float) -> bool:
        while self.times and self.times[0] <= at - self.window:
            self.times.popleft()
        if len(self.times) >= self.max_n:
            return False
        self.times.append(at)
        return True


def admit_batch(df: DataFrame, key: str, ts: str, row: str, max_n: int, window_s: float) -> DataFrame:
    """key, row, admitted. Rows stream through each task in the order of key and time, so that a key of any size needs only its budget."""
    kinds = f"{key} {df.schema[key].dataType.simpleString()}, {row} {df.schema[row].dataType.simpleString()}, admitted boolean"
    ordered = df.select(key, row, (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("at")).repartition(key).sortWithinPartitions(key, "at", row)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, budget = object(), None
        for pdf in it:
            out = []
            for k, at in zip(pdf[key], pdf["at"], strict=True):
                if k != last:
                    last, budget = k, Budget(max_n, window_s)
                out.append(budget.allow(at))
            yield pd.DataFrame({key: pdf[key], row: pdf[row], "admitted": out})

    return ordered.mapInPandas(run, kinds)


def admit_stream(stream: DataFrame, key: str, ts: str, row: str, max_n: int, window_s: float) -> DataFrame:
    """The same over a stream with a watermark on ts; the state of a key is its accepted times."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kinds = f"{key} {stream.schema[key].dataType.simpleString()}, {row} {stream.schema[row].dataType.simpleString()}, admitted boolean"

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        budget = Budget(max_n, window_s, state.get[0] if state.exists else ())
        newest = None
        for pdf in batches:
            pdf = pdf.sort_values([ts, row])
            times = pdf[ts].astype("int64") / 1e9
            newest = max(newest or 0, float(times.max()))
            yield pd.DataFrame({key: pdf[key], row: pdf[row], "admitted": [budget.allow(float(at)) for at in times]})
        state.update((list(budget.times),))
        if newest is not None:
            state.setTimeoutTimestamp(max(int((newest + window_s) * 1000), state.getCurrentWatermarkMs() + 1))

    return stream.groupBy(key).applyInPandasWithState(run, kinds, "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)

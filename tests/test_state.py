"""Records and scored keys as state of a stream: what the batch forms give, on logs that come in parts and out of order."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lumenaudit.streaming import incremental, lifecycle

START = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc)
EVENTS = "id long, status string, ts timestamp, n long"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def fates(df):
    return {r.id: (r.status, r.completed_at.timestamp() if r.completed_at else None, r.duration_ms, r.recovered) for r in df.collect()}


def test_records(spark):
    log = [
        (1, "pending", at(0), 1), (1, "processing", at(10), 2), (1, "completed", at(30), 3),  # done
        (2, "pending", at(0), 4), (2, "processing", at(10), 5),  # stale
        (3, "pending", at(900), 6),  # recent
        (4, "pending", at(0), 7), (4, "failed", at(9), 8), (4, "pending", at(800), 9), (4, "completed", at(850), 10),  # run again
        (5, "processing", at(5), 12), (5, "pending", at(5), 11),  # equal times: the number decides
        (6, "pending", at(0), 13), (6, "failed", at(40), 15), (6, "completed", at(40), 14),
    ]
    r = lifecycle.records(spark.createDataFrame(log, EVENTS), "id", "status", "ts", "n", F.lit(at(1000)))
    assert fates(r) == {
        1: ("completed", at(30).timestamp(), 30_000, False), 2: ("failed", at(300).timestamp(), 300_000, True), 3: ("pending", None, None, False), 4: ("completed", at(850).timestamp(), 50_000, False),
        5: ("failed", at(305).timestamp(), 300_000, True), 6: ("failed", at(40).timestamp(), 40_000, False),
    }
    assert lifecycle.recovered(r).first()[0] == 2
    assert r.where("recovered").select("explanation").distinct().count() == 1
    assert lifecycle.records(spark.createDataFrame([], EVENTS), "id", "status", "ts", "n", F.lit(at(1000))).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_stream_and_batch_agree_on_a_log(spark, tmp_path, seed):
    rnd = random.Random(seed)
    log, n = [], 0
    for key in range(30):
        t = rnd.randrange(600)
        for status in rnd.choice([["pending", "processing", "completed"], ["pending", "processing"], ["pending"], ["pending", "failed", "pending", "completed"], ["processing", "completed", "pending"]]):
            n += 1
            log.append((key, status, at(t), n))
            t += rnd.choice([0, 3, 40, 200])
    last = max(e[2] for e in log)
    log.append((-1, "completed", last + dt.timedelta(seconds=2000), n + 1))  # moves the watermark past every timer
    log.sort(key=lambda e: (e[2] + dt.timedelta(seconds=rnd.randrange(60)), e[3]))
    src, found = str(tmp_path / "src"), []
    query = None
    for part in range(4):
        spark.createDataFrame(log[part * len(log) // 4 : (part + 1) * len(log) // 4], EVENTS).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(EVENTS).parquet(src).withWatermark("ts", "90 seconds")
        rows = lifecycle.record_stream(stream, "id", "status", "ts", "n")
        keep = lambda batch, i: found.extend((i, r) for r in batch.collect())
        query = rows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()
    latest = {}
    for _, r in found:
        latest[r.id] = (r.status, r.completed_at.timestamp() if r.completed_at else None, r.duration_ms, r.recovered)
    now = last + dt.timedelta(seconds=2000 - 90)
    assert latest == fates(lifecycle.records(spark.createDataFrame(log, EVENTS), "id", "status", "ts", "n", F.lit(now)))


@pytest.mark.parametrize("bounded", [False, True])
def test_a_key_is_scored_once_over_batches_and_restarts(spark, tmp_path, bounded):
    src, sink = str(tmp_path / "src"), str(tmp_path / "sink")
    files = [[(1, at(0)), (1, at(1)), (2, at(2))], [(2, at(3)), (3, at(4))], [(1, at(5)), (3, at(6)), (4, at(7))]]
    for rows in files:
        spark.createDataFrame(rows, "id long, ts timestamp").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("id long, ts timestamp").parquet(src)
        more = {"ts": "ts", "within": "1 hour"} if bounded else {}
        incremental.score_incremental(stream, lambda b: b.select("id", F.lit("ok").alias("status")), "id", str(tmp_path / "cp"), sink, **more).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [1, 2, 3, 4]

"""Late rows, doubled events and streams over several batches."""

import datetime as dt
import os
import pathlib

from pyspark.sql import functions as F

from tessera.streaming.queries import run

T0 = dt.datetime(2024, 1, 1)


def _stream(spark, folder, batches):
    schema = "id long, user_id long, ts timestamp"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/b{i}")
        for path in pathlib.Path(f"{folder}/b{i}").glob("*.parquet"):
            os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))  # batches come by time of change
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/b*")


def _at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_late_rows_are_dropped(spark, tmp_path):
    batches = [[(1, 1, _at(5))], [(2, 1, _at(200))], [(5, 1, _at(201))], [(3, 1, _at(6)), (4, 1, _at(400))]]
    stream = _stream(spark, str(tmp_path), batches).withWatermark("ts", "10 minutes")
    found = run(stream.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("s"), "n"))
    # the last batch's early row is behind the watermark that the batch before the last one ran with
    assert {(r["s"], r["n"]) for r in found.collect()} == {(_at(0), 1), (_at(180), 2)}


def test_doubled_events_come_once(spark, tmp_path):
    batches = [[(1, 7, _at(1)), (2, 7, _at(1))], [(3, 7, _at(1)), (4, 8, _at(2))]]
    found = run(_stream(spark, str(tmp_path), batches).withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["user_id", "ts"]))
    assert sorted(r["user_id"] for r in found.collect()) == [7, 8]


def test_unmatched_rows_come_when_they_are_evicted(spark, tmp_path):
    """A left row without a partner comes once, when none can follow; one that is still open does not."""
    left = _stream(spark, str(tmp_path / "a"), [[(1, 1, _at(0)), (2, 2, _at(5))], [(3, 1, _at(300))], [(4, 1, _at(600))]])
    right = _stream(spark, str(tmp_path / "b"), [[(10, 1, _at(20))], [(11, 9, _at(300))], [(12, 9, _at(600))]])
    left = left.select("id", F.col("user_id").alias("u"), F.col("ts").alias("t")).withWatermark("t", "10 minutes")
    right = right.select(F.col("id").alias("rid"), F.col("user_id").alias("v"), F.col("ts").alias("s")).withWatermark("s", "10 minutes")
    found = run(left.join(right, F.expr("u = v and s >= t and s <= t + interval 1 hour"), "leftOuter").select("id", "rid"))
    assert sorted((r["id"], r["rid"]) for r in found.collect()) == [(1, 10), (2, None), (3, None)]

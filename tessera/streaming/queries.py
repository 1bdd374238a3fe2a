"""Structured Streaming: file streams, event-time windows, late rows, deduplication, joins and user state.

Builders run a stream over all that its source has (availableNow) and return the sink's rows. Sinks are Parquet in the
shared folder, so the driver holds no result; the memory sink has a query of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.registry import Registry
from tessera.sources.connectors import shared_folder
from tessera.sources.tables import table

R = Registry()
_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream; ts becomes a timestamp, which watermarks need. The pattern lets the table be a file or a folder."""
    return spark.readStream.schema(_SCHEMA).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All of the stream through a Parquet sink, read back."""
    spark = stream.sparkSession
    out = shared_folder(spark)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True)
    writer.format("parquet").start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def naive(column: str, alias: str | None = None):
    return F.col(column).cast("timestamp_ntz").alias(alias or column)


@R.query("SELECT event_id, ts, event_type FROM events WHERE event_type <> 'view'")
def stream_filter(spark, sf_dir):
    """A stateless stream from files to files."""
    return run(event_stream(spark, sf_dir).filter("event_type != 'view'").select("event_id", naive("ts"), "event_type"))


@R.query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_complete_memory(spark, sf_dir):
    """Complete mode in the memory sink: a row for each event type, whatever the input's size."""
    name = f"tessera_{uuid.uuid4().hex}"
    counted = event_stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"))
    counted.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


@R.query("""
    WITH d AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS opening, count(*) AS n FROM events GROUP BY 1)
    SELECT opening, n FROM d WHERE opening + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def stream_tumbling(spark, sf_dir):
    """Day windows that the watermark has closed."""
    w = event_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return run(w.select(naive("w.start", "opening"), "n"))


@R.query("SELECT min(event_id) AS event_id, user_id, ts FROM events GROUP BY user_id, ts")
def stream_dedup(spark, sf_dir):
    """One event for each user and time, with state dropped behind the watermark."""
    doubled = event_stream(spark, sf_dir)
    once = doubled.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["user_id", "ts"])
    return run(once.select("event_id", "user_id", naive("ts")))


@R.query("""
    SELECT a.event_id, b.event_id AS purchase_id FROM events a JOIN events b ON a.user_id = b.user_id
    AND a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 DAY""")
def stream_interval_join(spark, sf_dir):
    """Clicks with the user's purchases within a day, state bounded by both watermarks."""
    a = event_stream(spark, sf_dir).filter("event_type = 'click'").select("event_id", "user_id", F.col("ts").alias("clicked")).withWatermark("clicked", "1 hour")
    b = event_stream(spark, sf_dir).filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("buyer"), F.col("ts").alias("bought")).withWatermark("bought", "1 hour")
    return run(a.join(b, F.expr("user_id = buyer and bought >= clicked and bought <= clicked + interval 1 day")).select("event_id", "purchase_id"))


@R.query("""
    WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), b AS (SELECT event_id AS purchase_id, user_id, ts FROM events WHERE event_type = 'purchase'),
         w AS (SELECT date_trunc('milliseconds', least((SELECT max(ts) FROM a), (SELECT max(ts) FROM b))) - INTERVAL 1 HOUR AS passed),
         j AS (SELECT a.event_id, purchase_id, a.ts FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1 DAY)
    SELECT event_id, purchase_id FROM j, w WHERE purchase_id IS NOT NULL OR ts + INTERVAL 1 DAY < passed""")
def stream_outer_join(spark, sf_dir):
    """Clicks with the user's purchases within a day; a click without any comes once the watermark has evicted it, as none can follow then."""
    a = event_stream(spark, sf_dir).filter("event_type = 'click'").select("event_id", "user_id", F.col("ts").alias("clicked")).withWatermark("clicked", "1 hour")
    b = event_stream(spark, sf_dir).filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), F.col("user_id").alias("buyer"), F.col("ts").alias("bought")).withWatermark("bought", "1 hour")
    return run(a.join(b, F.expr("user_id = buyer and bought >= clicked and bought <= clicked + interval 1 day"), "leftOuter").select("event_id", "purchase_id"))


@R.query("SELECT event_type, count(*) AS n, CAST(max(event_id) AS BIGINT) AS last FROM events GROUP BY event_type")
def stream_update_upsert(spark, sf_dir):
    """Update mode through foreachBatch: a batch's changed rows replace the kept ones, one table version a batch, named by its number, so that a batch that is run again writes the same one."""
    out = shared_folder(spark)

    def upsert(batch: DataFrame, number: int) -> None:
        # the batch's own session, as it may differ from the caller's
        kept = batch.sparkSession.read.schema(batch.schema).parquet(f"{out}/version={number - 1}").join(batch, "event_type", "left_anti")
        kept.unionByName(batch).write.mode("overwrite").parquet(f"{out}/version={number}")

    counted = event_stream(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    # what is kept before the first batch
    spark.createDataFrame([], counted.schema).write.parquet(f"{out}/version=-1")
    counted.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("event_type string, n long, last long, version int").parquet(out)
    return rows.join(F.broadcast(rows.agg(F.max("version").alias("version"))), "version").drop("version")


@R.query("""
    WITH e AS (SELECT time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS closing, ts, event_id % 10 = 0 AS late FROM events),
         w AS (SELECT max(ts) FILTER (NOT late) - INTERVAL 1 HOUR AS before, max(ts) - INTERVAL 1 HOUR AS at_end FROM e)
    SELECT closing, count(*) AS n FROM e, w WHERE NOT (late AND closing <= before) AND closing <= at_end GROUP BY closing""")
def stream_late_rows(spark, sf_dir):
    """Every tenth event comes after all others: rows of windows that the watermark has closed by then are dropped."""
    source, out, state = (shared_folder(spark) for _ in range(3))
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    late = F.col("event_id") % 10 == 0
    for i, part in enumerate((events.filter(~late), events.filter(late))):
        part.write.parquet(f"{source}/part{i}")
        # a new run of the stream goes on from the state of the one before
        stream = spark.readStream.schema(events.schema).parquet(f"{source}/part*").withColumn("ts", F.col("ts").cast("timestamp"))
        counted = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n")).select(naive("w.end", "closing"), "n")
        counted.writeStream.outputMode("append").option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    return spark.read.schema(counted.schema).parquet(out)


class Totals(StatefulProcessor):
    """A user's running count and sum, kept in the state store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", "n long, total double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, total = self.state.get() if self.state.exists() else (0, 0.0)
        for frame in rows:
            n, total = n + len(frame), total + float(frame["value"].sum())
        self.state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [round(total, 4)]})

    def close(self) -> None:
        pass


@R.query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def stream_state(spark, sf_dir):
    """Arbitrary state per user; the last row that a user got is the total."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = event_stream(spark, sf_dir).select("user_id", "value").groupBy("user_id").transformWithStateInPandas(statefulProcessor=Totals(), outputStructType="user_id long, n long, total double", outputMode="Update", timeMode="None")
    out = shared_folder(spark)

    def save(batch: DataFrame, number: int) -> None:
        # a folder for each batch, so that one that is run again replaces what it wrote
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    try:
        stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", shared_folder(spark)).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)
    rows = spark.read.schema("user_id long, n long, total double, batch int").parquet(out)
    return rows.groupBy("user_id").agg(F.max("n").alias("n"), F.max_by("total", F.struct("batch", "n")).alias("total"))

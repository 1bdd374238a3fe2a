"""Window functions, frames, top-n per group, sessions and time windows over a batch."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.registry import Registry
from tessera.sources.tables import table

R = Registry()


@R.query("""
    SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place,
           rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS ranked,
           dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS dense FROM orders""")
def ranking(spark, sf_dir):
    by = Window.partitionBy("o_custkey")
    first, then = by.orderBy(F.desc("o_totalprice"), "o_orderkey"), by.orderBy("o_orderpriority")
    long = lambda c: c.cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", long(F.row_number().over(first)).alias("place"), long(F.rank().over(then)).alias("ranked"), long(F.dense_rank().over(then)).alias("dense"))


@R.query("""
    SELECT o_orderkey, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 9) AS share, round(cume_dist() OVER w, 9) AS upto
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)""")
def distribution(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 9).alias("share"), F.round(F.cume_dist().over(w), 9).alias("upto"))


@R.query("""
    SELECT event_id, lag(event_id) OVER w AS before, lead(event_type, 2, 'none') OVER w AS after, first_value(event_id) OVER w AS opening,
           last_value(event_id) OVER f AS closing, nth_value(event_id, 2) OVER f AS second
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
    f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def analytic(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    f = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.lag("event_id").over(w).alias("before"),
        F.lead("event_type", 2, "none").over(w).alias("after"),
        F.first_value("event_id").over(w).alias("opening"),
        F.last_value("event_id").over(f).alias("closing"),
        F.nth_value("event_id", 2).over(f).alias("second"),
    )


@R.query("SELECT event_id, count(*) OVER w AS n, max(value) OVER w AS high FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def rows_frame(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, Window.currentRow)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("n"), F.max("value").over(w).alias("high"))


@R.query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS n FROM events")
def range_frame(spark, sf_dir):
    second = F.unix_timestamp(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(second).rangeBetween(-3600, Window.currentRow)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("n"))


@R.query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 3")
def top_n_per_group(spark, sf_dir):
    """Spark limits each group before the shuffle too (WindowGroupLimit)."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(w)).filter("k <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


def sessions(events: DataFrame, key: str, at: str, gap: str) -> DataFrame:
    """events with a session number from 0: a new one after a gap longer than gap."""
    w = Window.partitionBy(key).orderBy(at)
    new = F.when(F.lag(at).over(w) < F.col(at) - F.expr(f"INTERVAL {gap}"), 1).otherwise(0)
    return events.withColumn("_new", new).withColumn("session", F.sum("_new").over(w)).drop("_new")


@R.query("""
    WITH m AS (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < ts - INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events),
         s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM m)
    SELECT user_id, session, count(*) AS n, min(ts) AS opening, max(ts) AS closing FROM s GROUP BY user_id, session""")
def sessionize(spark, sf_dir):
    found = sessions(table(spark, sf_dir, "events"), "user_id", "ts", "2 HOURS")
    return found.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("opening"), F.max("ts").alias("closing"))


@R.query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS opening, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_window(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("opening"), "event_type", "n")


@R.query("""
    SELECT time_bucket(INTERVAL 6 HOUR, ts) - k * INTERVAL 6 HOUR AS opening, count(*) AS n
    FROM events CROSS JOIN (SELECT unnest([0, 1]) AS k) GROUP BY ALL""")
def sliding_window(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "12 hours", "6 hours").alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("opening"), "n")


@R.query("""
    WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w <= ts - INTERVAL 2 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
         s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM m)
    SELECT user_id, min(ts) AS opening, max(ts) + INTERVAL 2 HOUR AS closing, count(*) AS n FROM s GROUP BY user_id, session""")
def session_window(spark, sf_dir):
    found = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("opening"), F.col("w.end").alias("closing"), "n")

"""Joins: equality, outer, semi, anti, inequality, range, as-of and lateral.

Small sides are left to Spark's own size check (autoBroadcastJoinThreshold, and AQE at run time); the only hints are on
region and nation, whose row counts are fixed.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.registry import Registry
from tessera.sources.tables import table

R = Registry()


def _orders_lines(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    return orders, lines


@R.query("SELECT o_orderkey, o_custkey, l_partkey, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def join_inner(spark, sf_dir):
    orders, lines = _orders_lines(spark, sf_dir)
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


def _outer(how: str):
    sql = f"SELECT o_orderkey, o_custkey, l_orderkey, l_quantity FROM orders {how.upper()} JOIN lineitem ON o_orderkey = l_orderkey"

    def build(spark, sf_dir):
        orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
        return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"), how)

    R.query(sql, name=f"join_{how}_outer")(build)


for _how in ("left", "right", "full"):
    _outer(_how)


@R.query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def join_semi_exists(spark, sf_dir):
    big = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(big, "o_orderkey", "left_semi")


@R.query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti_not_exists(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").join(lines, "o_orderkey", "left_anti")


@R.query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def join_not_in(spark, sf_dir):
    """NOT IN with its null rule: Spark plans a null-aware anti join."""
    return spark.sql("SELECT s_suppkey, s_name FROM {s} WHERE s_nationkey NOT IN (SELECT n_nationkey FROM {n} WHERE n_regionkey = 1)", s=table(spark, sf_dir, "supplier"), n=table(spark, sf_dir, "nation"))


@R.query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, sf_dir):
    """Both tables have a fixed number of rows."""
    return table(spark, sf_dir, "region").select("r_name").crossJoin(F.broadcast(table(spark, sf_dir, "nation").select("n_name")))


@R.query("SELECT c_custkey, n_nationkey FROM customer JOIN nation ON c_nationkey < n_nationkey")
def join_theta(spark, sf_dir):
    """An inequality alone; the side sent to all is nation, of 25 rows."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey")
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nation), F.col("c_nationkey") < F.col("n_nationkey")).drop("c_nationkey")


def range_join(left: DataFrame, right: DataFrame, key: str, at: str, low: str, high: str, width: str) -> DataFrame:
    """Rows of left whose at lies in [low, high) of a right row with the same key.

    Both sides are cut into buckets of width seconds, so that a key with many rows is spread over its buckets; a right
    row is copied to each bucket it touches.
    """
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    a = left.withColumn("_bucket", F.floor(seconds(at) / width))
    b = right.withColumn("_bucket", F.explode(F.sequence(F.floor(seconds(low) / width), F.floor(seconds(high) / width))))
    return a.join(b, [key, "_bucket"]).filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_bucket")


def interval_join(left: DataFrame, right: DataFrame, key: str, at: str, low: str, high: str) -> DataFrame:
    """Rows of left whose at lies in [low, high) of a right row with the same key, for intervals of any lengths together.

    Time is cut into blocks of 2^level microseconds. An interval is filed under the least level whose blocks are as long
    as itself, so under two blocks at most; a left row under its block of every level in use, of which there are 64 at
    most. So an interval of years costs as many copies as one of seconds, and what meets in a block is no more than a
    few times as far apart as the interval is long. Null keys, times and bounds match nothing, neither do intervals
    without length.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    b = right.filter(F.col(low) < F.col(high)).withColumn("_level", F.ceil(F.log2(micros(high) - micros(low))).cast("int"))
    levels = sorted(r[0] for r in b.select("_level").distinct().collect() if r[0] is not None)
    block = lambda t, level: F.call_function("shiftright", t, level)
    b = b.withColumn("_block", F.explode(F.sequence(block(micros(low), F.col("_level")), block(micros(high) - 1, F.col("_level")))))
    a = left.withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
    a = a.withColumn("_block", block(micros(at), F.col("_level")))
    return a.join(b, [key, "_level", "_block"]).filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("_level", "_block")


@R.query("""
    SELECT a.event_id, b.event_id AS purchase_id FROM events a JOIN events b
    ON a.user_id = b.user_id AND b.event_type = 'purchase' AND a.ts >= b.ts - INTERVAL 6 HOUR AND a.ts < b.ts""")
def join_range(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    right = events.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), (F.col("ts") - F.expr("INTERVAL 6 HOURS")).alias("low"), F.col("ts").alias("high"))
    return range_join(events.select("user_id", "event_id", "ts"), right, "user_id", "ts", "low", "high", 6 * 3600).select("event_id", "purchase_id")


@R.query("""
    WITH s AS (SELECT event_id AS state_id, user_id, ts AS low, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS high FROM events)
    SELECT event_id, state_id FROM events e JOIN s ON e.user_id = s.user_id AND e.ts >= s.low AND e.ts < s.high WHERE e.event_type = 'error'""")
def join_intervals(spark, sf_dir):
    """Errors with what the user's events of each type then said last, each valid until the next of its type: from seconds to weeks."""
    events = table(spark, sf_dir, "events")
    following = F.lead("ts").over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    states = events.select(F.col("event_id").alias("state_id"), "user_id", F.col("ts").alias("low"), following.alias("high"))
    errors = events.filter("event_type = 'error'").select("event_id", "user_id", "ts")
    return interval_join(errors, states, "user_id", "ts", "low", "high").select("event_id", "state_id")


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], tie: str, width: int = 7 * 86400) -> DataFrame:
    """Each left row with values of the last right row of its key at or before it (of several at one time, that with the greatest tie).

    Null keys and times match nothing. Time is cut into buckets of width seconds: a window finds the last right row
    within a bucket, and what earlier buckets leave is carried over by one row for each key and bucket. So a key with
    very many rows is spread over its buckets, and no task sorts more than one bucket of it.
    """
    packed = F.struct(*values)
    a = left.withColumn("_side", F.lit(1)).withColumn("_right", F.lit(None).cast(right.select(packed.alias("r")).schema["r"].dataType)).withColumn("_tie", F.lit(None).cast(right.schema[tie].dataType))
    b = right.select(F.col(key), F.col(at), packed.alias("_right"), F.col(tie).alias("_tie"), F.lit(0).alias("_side"))
    both = a.unionByName(b, allowMissingColumns=True).filter(F.col(key).isNotNull() & F.col(at).isNotNull())
    both = both.withColumn("_bucket", F.floor(F.unix_timestamp(F.col(at).cast("timestamp")) / width))
    within = Window.partitionBy(key, "_bucket").orderBy(at, "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.max_by("_right", F.when(F.col("_side") == 0, F.struct(at, "_tie"))).alias("_left")
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy(key, "_bucket").agg(last).withColumn("_left", F.last("_left", ignorenulls=True).over(earlier)).filter("_left is not null")
    found = both.withColumn("_here", F.last("_right", ignorenulls=True).over(within)).filter("_side = 1").join(carried, [key, "_bucket"], "left")
    found = found.withColumn("_last", F.coalesce("_here", "_left")).filter("_last is not null")
    return found.select(*left.columns, *[F.col(f"_last.{v}").alias(v) for v in values])


@R.query("""
    WITH p AS (SELECT user_id, ts, max(event_id) AS purchase_id FROM events WHERE event_type = 'purchase' GROUP BY ALL)
    SELECT e.event_id, e.user_id, p.purchase_id FROM events e ASOF JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def join_asof(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    purchases = events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"))
    return asof_join(events.select("event_id", "user_id", "ts"), purchases, "user_id", "ts", ["purchase_id"], "purchase_id").select("event_id", "user_id", "purchase_id")


@R.query("SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def join_broadcast(spark, sf_dir):
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))


@R.query("SELECT p_brand, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def join_merge(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand").hint("merge")
    return table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity").join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@R.query("""
    SELECT r_name, p_brand, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS quantity
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
    GROUP BY r_name, p_brand""")
def join_star(spark, sf_dir):
    t = lambda name, *c: table(spark, sf_dir, name).select(*c)
    place = t("nation", "n_nationkey", "n_regionkey").join(F.broadcast(t("region", "r_regionkey", "r_name")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    buyer = t("customer", "c_custkey", "c_nationkey").join(F.broadcast(place), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "r_name")
    order = t("orders", "o_orderkey", "o_custkey").join(buyer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "r_name")
    line = t("lineitem", "l_orderkey", "l_partkey", "l_quantity").join(t("part", "p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return line.join(order, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("r_name", "p_brand").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@R.query("SELECT o_orderkey, part FROM orders, LATERAL (SELECT unnest(string_split(o_orderpriority, '-')) AS part)")
def join_lateral(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return spark.sql("SELECT o_orderkey, part FROM {orders}, LATERAL explode(split(o_orderpriority, '-')) AS t(part)", orders=orders)


def top_of_each(outer: DataFrame, inner: DataFrame, outer_key: str, inner_key: str, order: list[Column], n: int) -> DataFrame:
    """Each outer row with its first n inner rows in some order, or with nulls if it has none: a correlated lateral subquery.

    Spark takes the correlation out: the subquery becomes a group limit on the inner key and an equality join, so no
    outer row scans the inner side.
    """
    matching = inner.where(F.col(inner_key) == F.col(outer_key).outer()).orderBy(*order).limit(n)
    return outer.lateralJoin(matching, how="left")


@R.query("""
    SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN LATERAL (
      SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 3) ON true""")
def join_lateral_top(spark, sf_dir):
    """Every customer's three dearest orders."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    found = top_of_each(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "o_custkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], 3)
    return found.select("c_custkey", "o_orderkey", "o_totalprice")


@R.query("""
    SELECT p_partkey, n, dearest FROM part, LATERAL (
      SELECT count(*) AS n, max(l_extendedprice) AS dearest FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 25)""")
def join_lateral_aggregate(spark, sf_dir):
    """For every part its lines of more than 25 pieces: a lateral aggregate, which has a row also where nothing matches. An inequality with an outer column would leave a nested loop; this has none."""
    part, line = table(spark, sf_dir, "part").select("p_partkey"), table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    matching = line.where((F.col("l_partkey") == F.col("p_partkey").outer()) & (F.col("l_quantity") > 25))
    return part.lateralJoin(matching.select(F.count("*").alias("n"), F.max("l_extendedprice").alias("dearest"))).select("p_partkey", "n", "dearest")

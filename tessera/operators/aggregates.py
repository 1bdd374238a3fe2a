"""Aggregations: grouped, distinct, grouping sets, statistics, percentiles and sketches."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.quantiles import exact_quantiles
from tessera.registry import Registry
from tessera.sources.tables import table

R = Registry()
_KEYS = ("l_returnflag", "l_linestatus")


@R.query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS total, avg(l_quantity) AS mean, min(l_tax) AS low, max(l_tax) AS high, count(*) AS n FROM lineitem GROUP BY ALL")
def group_by(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(*_KEYS).agg(F.sum("l_quantity").alias("total"), F.avg("l_quantity").alias("mean"), F.min("l_tax").alias("low"), F.max("l_tax").alias("high"), F.count("*").alias("n"))


@R.query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 10")
def having(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 10")


@R.query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def count_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@R.query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
def grouping_sets(spark, sf_dir):
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf_dir, "lineitem").groupingSets([[flag, status], [status], []], flag, status).agg(F.count("*").alias("n"))


@R.query("SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube(*_KEYS).agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


@R.query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup(*_KEYS).agg(F.count("*").alias("n"))


@R.query("""
    SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS deviation, round(var_pop(l_quantity), 6) AS variance,
           round(corr(l_quantity, l_extendedprice), 6) AS correlation, round(covar_samp(l_quantity, l_discount), 6) AS covariance,
           round(regr_slope(l_extendedprice, l_quantity), 4) AS slope
    FROM lineitem GROUP BY l_returnflag""")
def statistics(spark, sf_dir):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.round(F.stddev_samp(q), 6).alias("deviation"),
        F.round(F.var_pop(q), 6).alias("variance"),
        F.round(F.corr(q, p), 6).alias("correlation"),
        F.round(F.covar_samp(q, F.col("l_discount")), 6).alias("covariance"),
        F.round(F.regr_slope(p, q), 4).alias("slope"),
    )


@R.query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS quarter, round(median(l_extendedprice), 4) AS middle FROM lineitem GROUP BY l_returnflag")
def percentiles(spark, sf_dir):
    """By histograms, as percentile and median hold a group's values in one task."""
    found = exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.25, 0.5], whole=True)
    return found.select("l_returnflag", F.round("q0", 4).alias("quarter"), F.round("q1", 4).alias("middle"))


@R.query("""
    SELECT l_returnflag, l_quantity AS most FROM (
      SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_quantity) AS k
      FROM (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)) WHERE k = 1""")
def mode(spark, sf_dir):
    """The most frequent value, the least of several: counts first, then one row per group."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    return counts.groupBy("l_returnflag").agg(F.max_by("l_quantity", F.struct("n", -F.col("l_quantity"))).alias("most"))


@R.query("SELECT o_custkey, max_by(o_orderkey, (o_totalprice, o_orderkey)) AS dearest, min_by(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM orders GROUP BY o_custkey")
def arg_max_min(spark, sf_dir):
    by = F.struct("o_totalprice", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", by).alias("dearest"), F.min_by("o_orderkey", by).alias("cheapest"))


@R.query("SELECT o_orderstatus, count(*) FILTER (o_totalprice > 100000) AS dear, count(*) FILTER (o_orderpriority LIKE '1%') AS urgent FROM orders GROUP BY o_orderstatus")
def conditional_aggregate(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 100000).alias("dear"), F.count_if(F.col("o_orderpriority").like("1%")).alias("urgent"))


@R.query("SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, count(DISTINCT event_type) AS n FROM events GROUP BY user_id")
def collect_and_join(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"), F.count_distinct("event_type").alias("n"))


@R.query("SELECT user_id, string_agg(event_type, '>' ORDER BY event_id) AS path FROM events GROUP BY user_id")
def list_aggregate(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.expr("listagg(event_type, '>') WITHIN GROUP (ORDER BY event_id)").alias("path"))


@R.query()
def approximate_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


def distinct_estimates(rows: DataFrame, by: str, item: str, errors: list[float]) -> DataFrame:
    """For each value of by (null is one): exact, the number of distinct items, and for each standard error allowed whether the estimate is within four of it (within_0, within_1, ...).

    The pairs are made distinct first, for the exact number; what estimates see is the same with their repeats gone.
    Null items count nowhere; a group of nothing else has 0 and keeps every bound.
    """
    exact = F.count(F.col(item))
    near = [(F.abs(F.approx_count_distinct(item, e) - exact) <= F.lit(4 * e) * exact + 1).alias(f"within_{i}") for i, e in enumerate(errors)]
    return rows.select(by, item).distinct().groupBy(by).agg(exact.alias("exact"), *near)


@R.query("SELECT l_suppkey, count(DISTINCT l_partkey) AS exact, true AS within_0, true AS within_1 FROM lineitem GROUP BY l_suppkey")
def approximate_distinct_bounds(spark, sf_dir):
    """Every supplier's distinct parts, and whether estimates of two precisions keep their bounds."""
    return distinct_estimates(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey", [0.05, 0.02])


@R.query()
def sketches(spark, sf_dir):
    """Mergeable sketches: distinct counts by HLL and theta, quantiles."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey")).alias("hll"),
        F.theta_sketch_estimate(F.theta_sketch_agg("l_partkey")).alias("theta"),
        F.approx_percentile("l_extendedprice", [0.5, 0.9], 1000).alias("quantiles"),
    )


@R.query()
def count_min(spark, sf_dir):
    """A count-min sketch of part keys for each return flag, in its binary form."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_min_sketch("l_partkey", F.lit(0.01), F.lit(0.95), F.lit(7)).alias("sketch"))

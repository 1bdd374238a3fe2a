"""Projections, filters, conditional values, pivots and samples."""

from pyspark.sql import functions as F

from tessera.registry import Registry
from tessera.sources.tables import table

R = Registry()


@R.query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net, l_quantity + 1 AS more FROM lineitem")
def project_computed(spark, sf_dir):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", net.alias("net"), (F.col("l_quantity") + 1).alias("more"))


@R.query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 24 AND l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1996-01-01'")
def filter_range_and_equality(spark, sf_dir):
    day = F.lit("1996-01-01").cast("timestamp_ntz")
    return (
        table(spark, sf_dir, "lineitem")
        .filter((F.col("l_quantity") >= 10) & (F.col("l_quantity") < 24) & (F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= day))
        .select("l_orderkey", "l_partkey", "l_quantity")
    )


@R.query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size IN (1, 5, 9, 14) OR p_retailprice BETWEEN 900 AND 1100 OR p_name LIKE '%a%' OR regexp_matches(p_type, '^[A-M]')")
def filter_in_between_like_regex(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "part").filter(c("p_size").isin(1, 5, 9, 14) | c("p_retailprice").between(900, 1100) | c("p_name").like("%a%") | c("p_type").rlike("^[A-M]")).select("p_partkey", "p_brand", "p_size")


@R.query("SELECT o_orderkey, CASE WHEN o_totalprice < 1000 THEN 'low' WHEN o_totalprice < 100000 THEN 'mid' ELSE 'high' END AS band, coalesce(nullif(o_orderstatus, 'O'), 'open') AS status FROM orders")
def case_coalesce_nullif(spark, sf_dir):
    price = F.col("o_totalprice")
    band = F.when(price < 1000, "low").when(price < 100000, "mid").otherwise("high")
    return table(spark, sf_dir, "orders").select("o_orderkey", band.alias("band"), F.coalesce(F.nullif("o_orderstatus", F.lit("O")), F.lit("open")).alias("status"))


@R.query("""
    WITH a AS (SELECT o_orderkey AS k, nullif(o_orderstatus, 'F') AS s FROM orders),
         b AS (SELECT DISTINCT s FROM a)
    SELECT a.k, b.s FROM a JOIN b ON a.s IS NOT DISTINCT FROM b.s""")
def null_safe_equality(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.nullif("o_orderstatus", F.lit("F")).alias("s"))
    b = a.select(F.col("s").alias("t")).distinct()
    return a.join(b, F.col("s").eqNullSafe(F.col("t"))).select("k", F.col("t").alias("s"))


_TYPES = ["click", "error", "purchase", "signup", "view"]


@R.query(f"SELECT user_id, {', '.join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in _TYPES)} FROM events GROUP BY user_id")
def pivot_counts(spark, sf_dir):
    wide = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", _TYPES).count()
    return wide.na.fill(0)


@R.query("""
    SELECT l_orderkey, l_linenumber, l_partkey, measure, amount FROM (
      SELECT l_orderkey, l_linenumber, l_partkey, 'l_quantity' AS measure, l_quantity AS amount FROM lineitem
      UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax FROM lineitem)""")
def unpivot_measures(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_tax").unpivot(["l_orderkey", "l_linenumber", "l_partkey"], ["l_quantity", "l_tax"], "measure", "amount")


@R.query()
def sample_rows(spark, sf_dir):
    """A seeded Bernoulli sample of a tenth; sampling is the feature."""
    return table(spark, sf_dir, "lineitem").sample(fraction=0.1, seed=42)

"""Sorting, limits, set operations and subqueries."""

from pyspark.sql import functions as F

from tessera.registry import Registry
from tessera.sources.tables import table

R = Registry()


@R.query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment ASC NULLS LAST, c_acctbal DESC NULLS LAST")
def sort_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").orderBy(F.asc_nulls_last("c_mktsegment"), F.desc_nulls_last("c_acctbal"))


@R.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k(spark, sf_dir):
    """The limit is the feature: each task keeps its own hundred."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


@R.query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 25")
def offset_page(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(25).limit(50)


@R.query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(table(spark, sf_dir, "supplier").select("s_nationkey"))


@R.query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return union_all(spark, sf_dir).distinct()


@R.query("SELECT c_custkey AS id, c_name AS name, NULL::INTEGER AS size FROM customer UNION ALL BY NAME SELECT p_name AS name, p_partkey AS id, p_size AS size FROM part")
def union_by_name(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    parts = table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))
    return people.unionByName(parts, allowMissingColumns=True)


def _keys(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")), table(spark, sf_dir, "orders").filter("o_totalprice > 150000").select(F.col("o_orderkey").alias("k"))


_L, _O = "SELECT l_orderkey AS k FROM lineitem", "SELECT o_orderkey AS k FROM orders WHERE o_totalprice > 150000"


@R.query(f"{_L} INTERSECT {_O}")
def intersect(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.intersect(b)


@R.query(f"{_L} INTERSECT ALL {_O}")
def intersect_all(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.intersectAll(b)


@R.query(f"{_L} EXCEPT {_O}")
def except_distinct(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.subtract(b)


@R.query(f"{_L} EXCEPT ALL {_O}")
def except_all(spark, sf_dir):
    a, b = _keys(spark, sf_dir)
    return a.exceptAll(b)


@R.query("SELECT DISTINCT lang, source FROM documents")
def distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@R.query("SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY lang, source")
def drop_duplicates_by_key(spark, sf_dir):
    """One row for each key, the one with the least id."""
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id"))


@R.query("SELECT DISTINCT ON (lang, source) lang, source, doc_id, n_chars, text FROM documents ORDER BY lang, source, doc_id")
def drop_duplicate_rows(spark, sf_dir):
    """One whole row for each key, that with the least id: an aggregate with partial steps, where dropDuplicates would keep any row."""
    rest = F.struct("doc_id", "n_chars", "text")
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.min_by(rest, "doc_id").alias("r")).select("lang", "source", "r.*")


@R.query("SELECT o_orderkey, o_totalprice FROM orders o WHERE o_totalprice > (SELECT 1.2 * avg(o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)")
def correlated_scalar(spark, sf_dir):
    return spark.sql("SELECT o_orderkey, o_totalprice FROM {o} o WHERE o_totalprice > (SELECT 1.2 * avg(o_totalprice) FROM {o} i WHERE i.o_custkey = o.o_custkey)", o=table(spark, sf_dir, "orders"))


@R.query("SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def uncorrelated_subqueries(spark, sf_dir):
    return spark.sql("SELECT c_custkey FROM {c} WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {c}) AND c_nationkey IN (SELECT n_nationkey FROM {n} WHERE n_regionkey = 2)", c=table(spark, sf_dir, "customer"), n=table(spark, sf_dir, "nation"))


@R.query("""
    WITH RECURSIVE d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1),
         c(day, last) AS (SELECT min(day), max(day) FROM d UNION ALL SELECT CAST(day + INTERVAL 1 DAY AS DATE), last FROM c WHERE day < last)
    SELECT c.day, coalesce(n, 0) AS n FROM c LEFT JOIN d USING (day)""")
def recursive_cte(spark, sf_dir):
    """A calendar that grows day by day from the first event's to the last one's, with each day's events; days without any are there too."""
    return spark.sql(
        """
        WITH RECURSIVE d AS (SELECT to_date(ts) AS day, count(*) AS n FROM {e} GROUP BY 1),
             c(day, last) AS (SELECT min(day), max(day) FROM d UNION ALL SELECT date_add(day, 1), last FROM c WHERE day < last)
        SELECT c.day, coalesce(n, 0) AS n FROM c LEFT JOIN d ON c.day = d.day""",
        e=table(spark, sf_dir, "events"),
    )

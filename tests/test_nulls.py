"""Null keys and empty tables."""

from tessera import catalogue
from tessera.sources.connectors import round_trip

QUERIES = catalogue.queries()


def test_joins_with_null_keys(spark, tmp_path):
    spark.createDataFrame([(1, 10, "O", 1e6, None, "1-A"), (None, 11, "F", 1e6, None, "2-B")], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, 5, 50.0), (None, 6, 50.0)], "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    n = lambda name: QUERIES[name](spark, str(tmp_path)).count()
    assert n("join_inner") == 1 and n("join_left_outer") == 2 and n("join_full_outer") == 3
    assert n("join_semi_exists") == 1 and n("join_anti_not_exists") == 1
    assert n("null_safe_equality") == 2


def test_empty_tables(spark, tmp_path):
    for name in ("orders", "lineitem", "events", "customer", "nation"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("join_inner", "group_by", "ranking", "sessionize", "join_asof", "top_k", "pivot_counts", "array_basics"):
        assert QUERIES[name](spark, str(tmp_path)).count() == 0, name


def test_round_trips_keep_nulls(spark):
    df = spark.createDataFrame([(1, "a", 1.5), (2, None, None)], "i long, s string, d double")
    for kind in ("parquet", "json", "orc"):
        assert sorted(map(tuple, round_trip(df, kind).collect())) == sorted(map(tuple, df.collect())), kind

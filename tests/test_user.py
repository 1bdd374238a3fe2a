"""A table function over whole ordered partitions."""

import pytest
from pyspark.sql import functions as F

from tessera.functions.user import Runs, runs


def test_runs(spark):
    rows = [(k, t, v) for k, word in ((1, "aabbba"), (2, "c"), (None, "xyy")) for t, v in enumerate(word)] + [(3, 0, None), (3, 1, None), (3, 2, "z")]
    df = spark.createDataFrame(rows, "k int, t int, v string").repartition(4)
    found = runs(df, "k", ["t"], "v", "t")
    assert found.dtypes == [("k", "int"), ("v", "string"), ("n", "bigint"), ("opening", "int"), ("closing", "int")]
    want = [(1, "a", 2, 0, 1), (1, "b", 3, 2, 4), (1, "a", 1, 5, 5), (2, "c", 1, 0, 0), (None, "x", 1, 0, 0), (None, "y", 2, 1, 2), (3, None, 2, 0, 1), (3, "z", 1, 2, 2)]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert runs(df.limit(0), "k", ["t"], "v", "t").count() == 0


def test_schema_follows_the_columns(spark):
    df = spark.createDataFrame([("a", 1.5, True)], "k string, t double, v boolean")
    assert runs(df, "k", ["t"], "v", "t").dtypes == [("k", "string"), ("v", "boolean"), ("n", "bigint"), ("opening", "double"), ("closing", "double")]


def test_wrong_names_are_told_before_anything_runs(spark):
    df = spark.createDataFrame([(1, 2, "a")], "k int, t int, v string")
    with pytest.raises(Exception, match="names of its columns"):
        F.udtf(Runs)(df.asTable().partitionBy("k").orderBy("t"), F.lit("k"), F.lit("nothing"), F.lit("t"))

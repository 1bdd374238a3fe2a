"""Samples by hash: sizes, layout, and shares drawn in proportion."""

from pyspark.sql import functions as F

from tessera.operators.sampling import stratified_sample, uniform, weighted_sample


def test_layout_does_not_matter(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 7 + 1).cast("double").alias("w"), (F.col("id") % 3).alias("g"))
    for draw in (lambda d, n: weighted_sample(d, ["id"], "w", n), lambda d, n: stratified_sample(d, ["g"], ["id"], n)):
        one, two, more = draw(rows.repartition(1), 50), draw(rows.repartition(7, "id"), 50), draw(rows, 80)
        assert {r["id"] for r in one.collect()} == {r["id"] for r in two.collect()} < {r["id"] for r in more.collect()}


def test_sizes(spark):
    rows = spark.createDataFrame([(i, None if i % 10 == 0 else float(i % 4 - 1), "a" if i < 5 else None) for i in range(100)], "id int, w double, g string")
    drawn = weighted_sample(rows, ["id"], "w", 1000).collect()
    assert len(drawn) == sum(1 for i in range(100) if i % 10 and i % 4 > 1)
    counts = {r["g"]: r["count"] for r in stratified_sample(rows, ["g"], ["id"], 10).groupBy("g").count().collect()}
    assert counts == {"a": 5, None: 10}
    assert weighted_sample(rows.limit(0), ["id"], "w", 5).count() == stratified_sample(rows.limit(0), ["g"], ["id"], 5).count() == 0


def test_weights_and_uniformity(spark):
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    drawn = weighted_sample(rows, ["id"], "w", 3000)
    share = drawn.filter("w = 3").count() / 3000
    assert 0.71 < share < 0.78  # three to one, less what is drawn already
    u = rows.select(uniform(["id"], "x").alias("u")).agg(F.min("u"), F.max("u"), F.avg("u"), F.stddev("u")).first()
    assert 0 < u[0] < 0.001 < 0.999 < u[1] < 1 and abs(u[2] - 0.5) < 0.005 and abs(u[3] - 12**-0.5) < 0.005


def test_partial_top_k(spark):
    rows = spark.range(100).select("id", F.lit(1.0).alias("w"), (F.col("id") % 3).alias("g"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan(weighted_sample(rows, ["id"], "w", 5))
    assert "WindowGroupLimit" in plan(stratified_sample(rows, ["g"], ["id"], 5))

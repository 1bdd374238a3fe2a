"""Stored sketches: days written apart and merged, days replaced, set operations and count-min lookups."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.operators import sketches as S

D = [dt.datetime(2024, 3, i) for i in (1, 2, 3)]


def _rows(spark, per_day):
    rows = [(D[d], "x", u, float(u)) for d, users in per_day.items() for u in users]
    return spark.createDataFrame(rows, "ts timestamp_ntz, kind string, user long, v double")


def test_days_are_replaced_one_by_one(spark, tmp_path):
    path = str(tmp_path / "t")
    args = ("ts", "kind", "user", "v")
    S.store(_rows(spark, {0: range(100), 1: range(50, 150), 2: range(10)}), path, *args)
    S.store(_rows(spark, {2: range(400, 420)}), path, *args)
    table = S.stored(spark, path)
    assert sorted((str(r["day"]), r["n"]) for r in table.collect()) == [("2024-03-01", 100), ("2024-03-02", 100), ("2024-03-03", 20)]
    told = S.merged(table, "group").select("n", F.hll_sketch_estimate("hll").alias("h"), F.theta_sketch_estimate("theta").alias("t"), F.kll_sketch_get_quantile_double("kll", F.lit(0.5)).alias("q")).first()
    assert told["n"] == 220 and abs(told["h"] - 170) <= 4 and told["t"] == 170 and 70 <= told["q"] <= 100
    first = table.filter("day <= date'2024-03-02'")
    assert "PartitionFilters: [isnotnull(day" in first._jdf.queryExecution().executedPlan().toString()
    a, b = (S.merged(table.filter(F.col("day") == F.lit(d.date())), "group").select(F.col("theta").alias(n)) for d, n in ((D[0], "a"), (D[1], "b")))
    both, left, all_ = a.crossJoin(b).select(*[x.cast("int") for x in S.overlap(F.col("a"), F.col("b"))]).first()
    assert (both, left, all_) == (50, 50, 150)


def test_merged_days_tell_what_one_pass_tells(spark, tmp_path):
    rows = _rows(spark, {0: range(0, 30_000), 1: range(20_000, 50_000), 2: range(0, 50_000, 7)})
    path = str(tmp_path / "t")
    S.store(rows, path, "ts", "kind", "user", "v")
    merged = S.merged(S.stored(spark, path), "group")
    once = rows.agg(F.hll_sketch_estimate(F.hll_sketch_agg("user", S.SIZE)).alias("h")).first()["h"]
    told = merged.select(F.hll_sketch_estimate("hll").alias("h"), F.theta_sketch_estimate("theta").alias("t")).first()
    assert abs(told["h"] - once) < 0.01 * once and abs(told["t"] - 50_000) < S.DISTINCT_BOUND * 50_000


def test_count_min_is_never_too_low(spark):
    rows = spark.range(20_000).select(F.lit("g").alias("g"), (F.col("id") % 700).alias("item"), (F.col("id") % 3).alias("day"))
    rows = rows.unionByName(spark.createDataFrame([("g", None, 0)], rows.schema))
    days = S.count_min_cells(rows, ["day", "g"], "item", 256, 4)
    month = days.groupBy("g", "row", "cell").agg(F.sum("n").alias("n"))
    whole = S.count_min_cells(rows, ["g"], "item", 256, 4)
    assert month.exceptAll(whole.select(*month.columns)).count() == 0
    asked = spark.range(705).select(F.lit("g").alias("g"), F.col("id").alias("item")).unionByName(spark.createDataFrame([("other", 1)], "g string, item long"))
    found = {(r["g"], r["item"]): r["estimate"] for r in S.count_min_lookup(month, asked, ["g"], "item", 256, 4).collect()}
    true = {r["item"]: r["count"] for r in rows.filter("item is not null").groupBy("item").count().collect()}
    assert all(found["g", i] >= n for i, n in true.items()) and found["other", 1] == 0
    # the bound e / cells of all rows holds for all but e ** -depth of them
    over = [found["g", i] - n > 2.72 / 256 * 20_000 for i, n in true.items()]
    assert sum(over) <= 0.05 * len(over)


def test_distinct_estimates_edges(spark):
    from tessera.operators.aggregates import distinct_estimates

    rows = [("a", i % 700) for i in range(2000)] + [("b", None), ("b", None), (None, 1), (None, 1), ("c", 5), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    found = {r["k"]: tuple(r)[1:] for r in distinct_estimates(df, "k", "v", [0.05, 0.01]).collect()}
    assert found == {"a": (700, True, True), "b": (0, True, True), None: (1, True, True), "c": (1, True, True)}
    assert distinct_estimates(df.limit(0), "k", "v", [0.05]).count() == 0

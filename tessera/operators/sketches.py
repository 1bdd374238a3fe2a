"""A stored table of partial sketches by day, merged up to any set of days, and what such sketches can tell.

`store` writes for each day and group the row count and the sketches of that day's rows: HyperLogLog and theta
sketches of distinct ids, a KLL sketch of a measure. A day is one folder of the table, so a day that changed is
written anew and no other is read. Longer spans are merges of days: no row is read again. Theta sketches also give
intersections and differences. A count-min sketch is a table of its own here, a row for each cell, so that days merge
by a sum and a lookup is a join and a minimum; its cells come from md5, so any engine finds the same ones.

Estimates differ from the truth by bounded shares: the queries tell the exact value and whether each estimate keeps to
its bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import Registry
from tessera.sources.connectors import shared_folder
from tessera.sources.tables import table

R = Registry()
#: Base-two logarithm of the size of the distinct-count sketches; k of the quantile sketch; cells and rows of a count-min sketch.
SIZE, KLL, CELLS, DEPTH = 12, 200, 1024, 4
#: Bounds as shares: about four standard errors of 1.04 / sqrt(2 ** SIZE), and of the rank error of KLL.
DISTINCT_BOUND, RANK_BOUND = 0.065, 0.04


def partials(rows: DataFrame, day: str, group: str, item: str, measure: str) -> DataFrame:
    """A row for each day and group: day, group, n, hll, theta and kll. Null items and measures are in no sketch."""
    return rows.groupBy(F.to_date(day).alias("day"), F.col(group).alias("group")).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(item, SIZE).alias("hll"),
        F.theta_sketch_agg(item, SIZE).alias("theta"),
        F.kll_sketch_agg_double(F.col(measure).cast("double"), KLL).alias("kll"),
    )


def store(rows: DataFrame, path: str, day: str, group: str, item: str, measure: str) -> None:
    """Write the partial sketches of the days that rows have; these days are replaced, the others stay."""
    partials(rows, day, group, item, measure).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


_TABLE = "group string, n long, hll binary, theta binary, kll binary, day date"


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The table of partials; a filter on day reads these days' folders only."""
    return spark.read.schema(_TABLE).parquet(path)


def merged(sketches: DataFrame, *by: str) -> DataFrame:
    """Partials merged to one row for each value of by: n, hll, theta and kll."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("hll").alias("hll"), F.theta_union_agg("theta", SIZE).alias("theta"), F.kll_merge_agg_double("kll", KLL).alias("kll"))


def overlap(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """Estimates of how many distinct items are in both of two theta sketches, in the first only, and in either."""
    return F.theta_sketch_estimate(F.theta_intersection(a, b)), F.theta_sketch_estimate(F.theta_difference(a, b)), F.theta_sketch_estimate(F.theta_union(a, b, SIZE))


def _near(estimate: Column, exact: Column, of: Column, bound: float) -> Column:
    return F.abs(estimate - exact) <= F.lit(bound) * of + 1


def _event_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' sketches, written day by day and read back."""
    path = shared_folder(spark)
    store(table(spark, sf_dir, "events"), path, "ts", "event_type", "user_id", "value")
    return stored(spark, path)


@R.query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS hll_within, true AS theta_within FROM events GROUP BY event_type")
def sketch_distinct(spark, sf_dir):
    """Distinct users of each event type over all days, merged from the days' sketches, beside the exact number."""
    found = merged(_event_sketches(spark, sf_dir), "group").withColumnRenamed("group", "event_type")
    exact = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    hll, theta = F.hll_sketch_estimate("hll"), F.theta_sketch_estimate("theta")
    told = found.join(exact, "event_type")
    return told.select("event_type", "n", "users", _near(hll, F.col("users"), F.col("users"), DISTINCT_BOUND).alias("hll_within"), _near(theta, F.col("users"), F.col("users"), DISTINCT_BOUND).alias("theta_within"))


@R.query("""
    WITH u AS (SELECT event_type, user_id, bool_or(ts < TIMESTAMP '2024-01-16') AS early, bool_or(ts >= TIMESTAMP '2024-01-16') AS late FROM events GROUP BY ALL)
    SELECT event_type, count(*) FILTER (early AND late) AS users_in_both, count(*) FILTER (early AND NOT late) AS users_of_first, count(*) AS users, true AS both_within, true AS first_within, true AS all_within
    FROM u GROUP BY event_type HAVING bool_or(early) AND bool_or(late)""")
def sketch_overlap(spark, sf_dir):
    """Users of both halves of the month, and of its first half only, by set operations on merged sketches."""
    days = _event_sketches(spark, sf_dir)
    split = F.col("day") < F.to_date(F.lit("2024-01-16"))
    a = merged(days.filter(split), "group").select(F.col("group").alias("event_type"), F.col("theta").alias("a"))
    b = merged(days.filter(~split), "group").select(F.col("group").alias("event_type"), F.col("theta").alias("b"))
    users = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.bool_or(F.to_date("ts") < F.to_date(F.lit("2024-01-16"))).alias("early"), F.bool_or(F.to_date("ts") >= F.to_date(F.lit("2024-01-16"))).alias("late"))
    exact = users.groupBy("event_type").agg(F.count_if(F.col("early") & F.col("late")).alias("users_in_both"), F.count_if(F.col("early") & ~F.col("late")).alias("users_of_first"), F.count("*").alias("users"))
    # what two sketches share is known to within a share of what either has
    both, first, all_ = (_near(x, F.col(c), F.col("users"), DISTINCT_BOUND) for x, c in zip(overlap(F.col("a"), F.col("b")), ("users_in_both", "users_of_first", "users"), strict=True))
    told = a.join(b, "event_type").join(exact, "event_type")
    return told.select("event_type", "users_in_both", "users_of_first", "users", both.alias("both_within"), first.alias("first_within"), all_.alias("all_within"))


@R.query("SELECT event_type, count(value) AS n, q, true AS within FROM events, (SELECT unnest([CAST(0.1 AS DOUBLE), CAST(0.5 AS DOUBLE), CAST(0.99 AS DOUBLE)]) AS q) GROUP BY event_type, q")
def sketch_quantiles(spark, sf_dir):
    """Quantiles from merged sketches: whether the share of values up to each is within the sketch's bound of what was asked."""
    shares = F.array(*map(F.lit, (0.1, 0.5, 0.99)))
    found = merged(_event_sketches(spark, sf_dir), "group").select(F.col("group").alias("event_type"), F.map_from_arrays(shares, F.kll_sketch_get_quantile_double("kll", shares)).alias("at"))
    found = found.select("event_type", F.explode("at").alias("q", "at"))
    # the table of quantiles has three rows for each group; values are counted in one pass
    values = table(spark, sf_dir, "events").select("event_type", "value").filter("value is not null").join(found, "event_type")
    told = values.groupBy("event_type", "q").agg(F.count("*").alias("n"), F.count_if(F.col("value") <= F.col("at")).alias("up_to"), F.count_if(F.col("value") < F.col("at")).alias("below"))
    low, high = F.col("below") / F.col("n"), F.col("up_to") / F.col("n")
    return told.select("event_type", "n", "q", ((low <= F.col("q") + RANK_BOUND) & (high >= F.col("q") - RANK_BOUND)).alias("within"))


def cell(item: Column, row: Column, cells: int = CELLS) -> Column:
    """An item's cell in a row of a count-min sketch: the first eight digits of an md5 as a number, modulo the cells."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", row.cast("string"), item.cast("string"))), 1, 8), 16, 10).cast("long") % cells).cast("int")


def count_min_cells(rows: DataFrame, by: list[str], item: str, cells: int = CELLS, depth: int = DEPTH) -> DataFrame:
    """The sketch of each value of by: a row for each cell in use (by, row, cell, n). Null items count nowhere. Sums of n merge sketches."""
    counts = rows.filter(F.col(item).isNotNull()).groupBy(*by, item).agg(F.count("*").alias("n"))
    spread = counts.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    return spread.groupBy(*by, "row", cell(F.col(item), F.col("row"), cells).alias("cell")).agg(F.sum("n").alias("n"))


def count_min_lookup(sketch: DataFrame, asked: DataFrame, by: list[str], item: str, cells: int = CELLS, depth: int = DEPTH) -> DataFrame:
    """asked (by, item) with estimate: never less than the true count, more by what shares an item's cells in every row."""
    named = asked.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1)))).withColumn("cell", cell(F.col(item), F.col("row"), cells))
    return named.join(sketch, [*by, "row", "cell"], "left").groupBy(*by, item).agg(F.coalesce(F.min(F.coalesce("n", F.lit(0))), F.lit(0)).cast("long").alias("estimate"))


@R.query(f"""
    WITH c AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL),
         r AS (SELECT *, unnest(range({DEPTH})) AS row FROM c),
         k AS (SELECT *, CAST(('0x' || substr(md5(row || ':' || user_id), 1, 8)) AS BIGINT) % {CELLS} AS cell FROM r),
         s AS (SELECT event_type, row, cell, sum(n) AS total FROM k GROUP BY ALL)
    SELECT event_type, user_id, any_value(n) AS n, CAST(min(total) AS BIGINT) AS estimate FROM k JOIN s USING (event_type, row, cell) GROUP BY event_type, user_id""")
def count_min_estimates(spark, sf_dir):
    """How often each user has each event type, by lookups in count-min sketches of days merged to the whole month, beside the true number."""
    events = table(spark, sf_dir, "events").select("event_type", "user_id", F.to_date("ts").alias("day"))
    path = shared_folder(spark)
    count_min_cells(events, ["day", "event_type"], "user_id").write.partitionBy("day").parquet(path)
    days = spark.read.schema("event_type string, row int, cell int, n long, day date").parquet(path)
    month = days.groupBy("event_type", "row", "cell").agg(F.sum("n").alias("n"))
    true = events.groupBy("event_type", "user_id").agg(F.count("*").alias("true"))
    return count_min_lookup(month, true.select("event_type", "user_id"), ["event_type"], "user_id").join(true, ["event_type", "user_id"]).select("event_type", "user_id", F.col("true").alias("n"), "estimate")

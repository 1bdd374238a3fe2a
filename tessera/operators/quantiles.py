"""Exact quantiles by repeated histograms: no task ever holds a group's rows.

Each wanted order statistic of a group starts as the whole range of the group's values. A round counts the values of
that range in BUCKETS, by partial aggregation, and goes on with the bucket that holds the wanted one, from its least to
its greatest value. Buckets are of equal width where the ends of a range are within a factor of four, else of equal
width in the logarithm, so half a dozen rounds find any double. A range of one value is an answer, which most are after
two or three. The rows are read again each round, columns pruned; those
outside all ranges drop out before the shuffle, and what is shuffled is a row for each task, range and bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.registry import Registry
from tessera.sources.connectors import shared_folder
from tessera.sources.tables import table

R = Registry()
BUCKETS = 4096
#: The greatest finite double; a range with an infinite end is cut into buckets up to it.
_MOST = 1.7976931348623157e308


def _written(df: DataFrame) -> DataFrame:
    """df in the shared folder: the lineage of the rounds ends there."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _share(v: str, low: str, high: str) -> Column:
    """How far v is from low to high, from 0 to 1; never less for a greater v."""
    finite = lambda c: F.greatest(F.least(F.col(c), F.lit(_MOST)), F.lit(-_MOST))
    # exponents from 1 on, below zero for negative values, in the order of the values
    scale = lambda c: F.when(F.col(c) == 0, 0.0).otherwise(F.signum(c) * (F.log2(F.abs(finite(c))) + 1075))
    part = lambda f: (f(v) - f(low)) / (f(high) - f(low))
    even = (F.signum(low) == F.signum(high)) & (F.greatest(F.abs(finite(low)), F.abs(finite(high))) / 4 <= F.least(F.abs(finite(low)), F.abs(finite(high))))
    # not the same number: an end that is not finite
    return F.when(even & (finite(low) != finite(high)), part(finite)).when(~even, part(scale)).otherwise(0.0)


def order_statistics(df: DataFrame, keys: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """wanted (keys, rank from 0) with the value (double) of that rank in its group. Null and NaN values do not count; null keys are a group; a rank that a group has not gives no row."""
    named = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.col(value).cast("double").alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull() & ~F.isnan("_v")).withColumn("_v", F.col("_v") + F.lit(0.0))  # no negative zero

    def same(a: DataFrame, b: DataFrame):
        on = F.lit(True)
        for n in named:
            on = on & a[n].eqNullSafe(b[n])
        return on

    whole = rows.groupBy(*named).agg(F.min("_v").alias("_low"), F.max("_v").alias("_high"), F.count("*").alias("_n"))
    asked = wanted.select(*[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)], F.col("rank").cast("long").alias("_rank")).distinct()
    ranges = asked.join(whole, same(asked, whole)).filter("_rank >= 0 and _rank < _n").select(*[asked[n] for n in named], "_rank", F.col("_rank").alias("_left"), "_low", "_high")
    ranges, found = _written(ranges), None
    while True:
        done = ranges.filter("_low = _high").select(*named, "_rank", F.col("_low").alias("_value"))
        found = done if found is None else found.unionByName(done)
        open_ = ranges.filter("_low < _high")
        if open_.isEmpty():
            break
        spans = open_.select(*named, "_low", "_high").distinct()
        inside = rows.join(spans, same(rows, spans)).filter("_v >= _low and _v <= _high").select(*[rows[n] for n in named], "_v", "_low", "_high")
        bucket = F.when(F.col("_v") == F.col("_low"), 0).when(F.col("_v") == F.col("_high"), BUCKETS + 1).otherwise(1 + F.least(F.floor(_share("_v", "_low", "_high") * BUCKETS), F.lit(BUCKETS - 1)))
        counts = inside.withColumn("_b", bucket).groupBy(*named, "_low", "_high", "_b").agg(F.count("*").alias("_n"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
        # a range has a row for each of its buckets here
        before = Window.partitionBy(*named, "_low", "_high").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        hit = open_.join(counts, same(open_, counts) & (open_["_low"] == counts["_low"]) & (open_["_high"] == counts["_high"]) & (open_["_left"] >= F.col("_before")) & (open_["_left"] < F.col("_before") + F.col("_n")))
        ranges = _written(hit.select(*[open_[n] for n in named], "_rank", (F.col("_left") - F.col("_before")).alias("_left"), F.col("_from").alias("_low"), F.col("_to").alias("_high")))
    return found.select(*[F.col(n).alias(k) for n, k in zip(named, keys, strict=True)], F.col("_rank").alias("rank"), F.col("_value").alias("value"))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], whole: bool = False) -> DataFrame:
    """keys, n (values that count) and q0, q1, ... for the shares, interpolated between neighbours.

    With whole, NaN counts as the greatest value, as in SQL, and a group without values has n 0 and nulls.
    """
    nan = F.isnan(F.col(value).cast("double"))
    rows = df if whole else df.filter(F.col(value).isNotNull() & ~nan)
    counted = rows.groupBy(*keys).agg(F.count(value).alias("n"), F.count_if(F.col(value).isNotNull() & ~nan).alias("numbers"))
    counted = _written(counted)
    place = lambda q: F.lit(q) * (F.col("n") - 1)
    ranks = F.array_distinct(F.array(*[c for q in shares for c in (F.floor(place(q)), F.ceil(place(q)))]))
    told = order_statistics(df, keys, value, counted.select(*keys, F.explode(ranks).alias("rank")))
    # a group's few ranks meet in a map
    maps = told.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at"))
    on = F.lit(True)
    for k in keys:
        on = on & counted[k].eqNullSafe(maps[k])
    both = counted.join(maps, on, "left").select(*[counted[k] for k in keys], "n", "numbers", "at")

    def quantile(q: float):
        at = lambda rank: F.when(rank < F.col("numbers"), F.try_element_at("at", rank)).otherwise(F.lit(float("nan")))
        low, high = at(F.floor(place(q))), at(F.ceil(place(q)))
        part = place(q) - F.floor(place(q))
        return F.when(F.col("n") > 0, F.when(low == high, low).otherwise(low * (1 - part) + high * part))

    return both.select(*keys, "n", *[quantile(q).alias(f"q{i}") for i, q in enumerate(shares)])


@R.query("""
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(quantile_cont(l_extendedprice, 0.01), 4) AS low, round(median(l_extendedprice), 4) AS middle, round(quantile_cont(l_extendedprice, 0.999), 4) AS high
    FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def quantiles_by_histogram(spark, sf_dir):
    """Exact quantiles of groups that each hold a sixth of all rows."""
    found = exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.01, 0.5, 0.999])
    return found.select("l_returnflag", "l_linestatus", "n", F.round("q0", 4).alias("low"), F.round("q1", 4).alias("middle"), F.round("q2", 4).alias("high"))


@R.query("SELECT count(*) AS n, quantile_disc(o_totalprice, 0.5) AS middle, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders")
def order_statistics_of_all(spark, sf_dir):
    """The least, middle and greatest of a whole table, which is one group."""
    orders = table(spark, sf_dir, "orders").select(F.lit(0).alias("g"), "o_totalprice")
    n = orders.groupBy("g").agg(F.count("o_totalprice").alias("n"))
    ranks = n.select("g", "n", F.explode(F.array(F.lit(0).cast("long"), F.ceil(F.col("n") / 2) - 1, F.col("n") - 1)).alias("rank"))
    told = order_statistics(orders, ["g"], "o_totalprice", ranks)
    at = told.join(ranks.distinct(), ["g", "rank"]).groupBy("n").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.max(F.when(F.col("rank") == F.ceil(F.col("n") / 2) - 1, F.col("value"))).alias("middle"))
    return at.select("n", "middle", "least", "most")

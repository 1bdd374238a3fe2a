"""User code: vectorised scalar, grouped and table functions, grouped maps, cogroups and batch maps."""

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tessera.registry import Registry
from tessera.sources.tables import table

R = Registry()


@R.query("SELECT event_id, value * 1.5 + 1 AS scaled FROM events")
def scalar_udf(spark, sf_dir):
    @F.arrow_udf("double")
    def scaled(x: pa.Array) -> pa.Array:
        return pc.add(pc.multiply(x, 1.5), 1.0)

    return table(spark, sf_dir, "events").select("event_id", scaled("value").alias("scaled"))


@R.query("SELECT event_id, value * 2 AS twice FROM events")
def scalar_pandas_udf(spark, sf_dir):
    @F.pandas_udf("double")
    def twice(x: pd.Series) -> pd.Series:
        return x * 2

    return table(spark, sf_dir, "events").select("event_id", twice("value").alias("twice"))


@R.query("SELECT event_type, max(value) - min(value) AS spread FROM events GROUP BY event_type")
def grouped_udaf(spark, sf_dir):
    """Spread by type. A grouped UDF has no partial form, so each (type, user) is cut down first and the second step sees users' extremes only."""

    @F.pandas_udf("double")
    def spread(low: pd.Series, high: pd.Series) -> float:
        return high.max() - low.min()

    part = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return part.groupBy("event_type").agg(spread("low", "high").alias("spread"))


@R.query("SELECT n_nationkey, CAST(k AS INTEGER) AS k, n_nationkey * k AS product FROM nation, LATERAL (SELECT unnest([1, 2, 3]) AS k)")
def table_udf(spark, sf_dir):
    @F.udtf(returnType="k int, product int")
    class Multiples:
        def eval(self, n: int):
            for k in (1, 2, 3):
                yield k, n * k

    spark.udtf.register("tessera_multiples", Multiples)
    return spark.sql("SELECT n_nationkey, k, product FROM {n}, LATERAL tessera_multiples(n_nationkey)", n=table(spark, sf_dir, "nation"))


class Runs:
    """Unbroken runs of one value in a table's rows as they are ordered: the partition column, the value, the rows, and the first and last of another column.

    Takes a TABLE argument with PARTITION BY and ORDER BY, and the names of the three columns; the result's types are those of
    the columns. A run is all that is kept in memory.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, column: AnalyzeArgument, at: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        fields = {f.name: f for f in rows.dataType.fields}
        for name in (key, column, at):
            if name.dataType != T.StringType() or not name.isConstantExpression or name.value not in fields:
                raise ValueError("the others are names of its columns")
        of = lambda a: fields[a.value].dataType
        return AnalyzeResult(T.StructType().add(key.value, of(key)).add(column.value, of(column)).add("n", T.LongType()).add("opening", of(at)).add("closing", of(at)))

    def __init__(self):
        self.run = None

    def eval(self, row, key: str, column: str, at: str):
        value, now = row[column], row[at]
        if self.run is not None and self.run[1] == value:
            self.run = (*self.run[:2], self.run[2] + 1, self.run[3], now)
            return
        if self.run is not None:
            yield self.run
        self.run = (row[key], value, 1, now, now)

    def terminate(self):
        if self.run is not None:
            yield self.run


def runs(df: DataFrame, key: str, order: list[str], column: str, at: str) -> DataFrame:
    """key, column, n, opening and closing (first and last at) of every run of one value of column among the rows of each key."""
    return F.udtf(Runs)(df.select(*dict.fromkeys([key, *order, column, at])).asTable().partitionBy(key).orderBy(*order), F.lit(key), F.lit(column), F.lit(at))


@R.query("""
    WITH g AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh FROM events),
         s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM g)
    SELECT user_id, event_type, count(*) AS n, min(event_id) AS opening, max(event_id) AS closing FROM s GROUP BY user_id, run, event_type""")
def table_udf_of_table(spark, sf_dir):
    """Runs of one event type in each user's events, by a table function that reads a whole ordered partition row by row."""
    return runs(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", "event_id")


@R.query("SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda s, x: 0.9 * s + 0.1 * x), 6) AS smooth FROM events GROUP BY user_id")
def grouped_map(spark, sf_dir):
    """A user's exponentially smoothed value at the end: each step needs the one before."""

    def smooth(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ordered = rows.sort_values(["ts", "event_id"])["value"]
        return pd.DataFrame({"user_id": [key[0]], "smooth": [round(ordered.ewm(alpha=0.1, adjust=False).mean().iloc[-1], 6)]})

    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandas(smooth, "user_id long, smooth double")


@R.query("""
    SELECT k, CAST(coalesce(c.n, 0) AS BIGINT) AS customers, CAST(coalesce(s.n, 0) AS BIGINT) AS suppliers FROM
      (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) c FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) s USING (k)""")
def cogrouped_map(spark, sf_dir):
    def both(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "customers": [pc.sum(a.column("n")).as_py() or 0 if len(a) else 0], "suppliers": [pc.sum(b.column("n")).as_py() or 0 if len(b) else 0]})

    a = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n"))
    b = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n"))
    return a.groupBy("k").cogroup(b.groupBy("k")).applyInArrow(both, "k int, customers long, suppliers long")


@R.query("SELECT doc_id, CAST(length(text) AS BIGINT) AS size FROM documents")
def batch_map_arrow(spark, sf_dir):
    def size(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.utf8_length(batch.column(1)).cast(pa.int64())], names=["doc_id", "size"])

    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(size, "doc_id long, size long")


@R.query("SELECT event_id, upper(event_type) AS kind FROM events")
def batch_map_pandas(spark, sf_dir):
    def upper(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"event_id": frame["event_id"], "kind": frame["event_type"].str.upper()})

    return table(spark, sf_dir, "events").select("event_id", "event_type").mapInPandas(upper, "event_id long, kind string")

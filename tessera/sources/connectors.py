"""Sources and sinks: Parquet, partitioned Parquet, ORC, CSV, JSON and text, written to the shared folder and read back."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry import Registry
from tessera.sources.tables import table

R = Registry()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one in spark.checkpoint.dir. Where that is unset, a local one in local mode, as in tests; an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/{uuid.uuid4().hex}"


def round_trip(df: DataFrame, kind: str, partition: list[str] | None = None, **options) -> DataFrame:
    """Write df in a format and read it with its own schema."""
    path = shared_folder(df.sparkSession)
    writer = df.write.format(kind).options(**options)
    (writer.partitionBy(*partition) if partition else writer).save(path)
    return df.sparkSession.read.format(kind).options(**options).schema(df.schema).load(path).select(*df.columns)


@R.query("SELECT r_regionkey, r_name FROM region")
def parquet_scan(spark, sf_dir):
    return table(spark, sf_dir, "region").select("r_regionkey", "r_name")


TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@R.query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES))
def parquet_scan_all(spark, sf_dir):
    """Row counts of all tables."""
    counts = [table(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in TABLES]
    return functools.reduce(DataFrame.union, counts)


@R.query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def parquet_partitioned(spark, sf_dir):
    """Partitions are pruned on reading."""
    found = round_trip(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "parquet", ["o_orderstatus"])
    return found.filter(F.col("o_orderstatus") == "F")


_ORDERS = "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders"


def _format(kind: str, **options):
    def build(spark, sf_dir):
        return round_trip(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), kind, **options)

    R.query(_ORDERS, name=f"{kind}_round_trip")(build)


_format("csv", header="true")
_format("json")
_format("orc")


@R.query("SELECT c_name AS value FROM customer")
def text_round_trip(spark, sf_dir):
    return round_trip(table(spark, sf_dir, "customer").select(F.col("c_name").alias("value")), "text")


def read_permissive(lines: DataFrame, kind: str, schema: str, **options) -> DataFrame:
    """A column of lines, written as text and read as CSV or JSON: the schema's columns, null where a field cannot be read, and broken, the whole line of such a row (null for a sound one). No row is lost."""
    path = shared_folder(lines.sparkSession)
    lines.write.text(path)
    return lines.sparkSession.read.format(kind).schema(f"{schema}, broken string").options(mode="PERMISSIVE", columnNameOfCorruptRecord="broken", **options).load(path)


_DAMAGED = "SELECT o_orderkey, CASE WHEN o_orderkey % 97 <> 0 THEN o_custkey END AS o_custkey, o_orderpriority, o_orderkey % 97 = 0 AS damaged FROM orders"


def _damaged_orders(spark: SparkSession, sf_dir: str):
    """The orders, and their customer as text, which is no number for some."""
    orders = table(spark, sf_dir, "orders")
    return orders, F.when(F.col("o_orderkey") % 97 == 0, F.lit("?")).otherwise(F.col("o_custkey").cast("string"))


@R.query(_DAMAGED)
def csv_permissive(spark, sf_dir):
    orders, customer = _damaged_orders(spark, sf_dir)
    lines = orders.select(F.concat_ws("|", "o_orderkey", customer, "o_orderpriority").alias("value"))
    read = read_permissive(lines, "csv", "o_orderkey long, o_custkey long, o_orderpriority string", sep="|")
    return read.select("o_orderkey", "o_custkey", "o_orderpriority", F.col("broken").isNotNull().alias("damaged"))


@R.query(_DAMAGED)
def json_permissive(spark, sf_dir):
    orders, customer = _damaged_orders(spark, sf_dir)
    lines = orders.select(F.to_json(F.struct("o_orderkey", F.when(customer == "?", "?").alias("odd"), "o_custkey", "o_orderpriority")).alias("value"))
    # the damaged ones have a text where a number is asked for
    lines = lines.select(F.regexp_replace("value", '"odd":"[?]","o_custkey":[0-9]+', '"o_custkey":"?"').alias("value"))
    read = read_permissive(lines, "json", "o_orderkey long, o_custkey long, o_orderpriority string")
    return read.select("o_orderkey", "o_custkey", "o_orderpriority", F.col("broken").isNotNull().alias("damaged"))

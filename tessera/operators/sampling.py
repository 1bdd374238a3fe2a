"""Samples without replacement that depend on rows alone: the same for any layout, order or engine.

A row's number u between 0 and 1 comes from the md5 of its key and a salt. Rows with the least keys are the sample, so
every task sends on no more rows than the sample has, and a larger sample holds every smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.registry import Registry
from tessera.sources.tables import table

R = Registry()


def uniform(key: list[str], salt: str) -> Column:
    """A number above 0 and below 1 for each key, of 52 bits: the first thirteen digits of an md5."""
    named = F.concat_ws(":", F.lit(salt), *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in key])
    return (F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def weighted_sample(df: DataFrame, key: list[str], weight: str, n: int, salt: str = "0") -> DataFrame:
    """n rows of df without replacement, each next one drawn by its share of the weight that is left.

    The rows with the least -ln(u) / weight (exponential clocks). Rows with a null, zero or negative weight are never
    drawn; rows with equal keys and weights tie and are told apart by nothing else.
    """
    clock = -F.ln(uniform(key, salt)) / F.col(weight)
    return df.filter(F.col(weight) > 0).orderBy(clock, *key).limit(n)


def stratified_sample(df: DataFrame, strata: list[str], key: list[str], n: int, salt: str = "0") -> DataFrame:
    """n rows of each stratum, all of a smaller one; null strata are one. Each task keeps n rows of a stratum at most before the shuffle."""
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(uniform(key, salt), *key))
    return df.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")


_U = "((CAST('0x' || substr(md5('{salt}:' || {key}), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)"


@R.query(f"SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0 ORDER BY -ln({_U.format(salt='w', key='o_orderkey')}) / o_totalprice, o_orderkey LIMIT 500")
def sample_weighted(spark, sf_dir):
    """500 orders by their price; the number is the feature."""
    return weighted_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], "o_totalprice", 500, "w")


@R.query(f"SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_U.format(salt='s', key='o_orderkey')}, o_orderkey) <= 100")
def sample_stratified(spark, sf_dir):
    """100 orders of each priority; the number is the feature."""
    return stratified_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"], ["o_orderkey"], 100, "s")

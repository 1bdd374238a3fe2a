"""The corpus pipeline: language ID, quality rules, near-duplicate removal, passage removal, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. run()
writes each result to the shared folder and reads it again for the next stage.

Edge cases follow the operators' docstrings: a null text has no language and goes in the first stage; extra columns
pass through to the last stage; an empty table stays empty to the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard, language_id, packing, quality, suffix_dedup
from tessera.llm.common import keep, prepare


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that their text and source bear out."""
    found = language_id.identify(docs, "text", "lang", None, "source")
    return found.filter(F.col(found.columns[-1])).select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the quality classifier keep."""
    prepare(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = quality.score(docs, model)
    return found.filter(F.col(found.columns[-1])).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return jaccard.one_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that a document with a smaller id has; whole characters only. n_chars follows."""
    found = suffix_dedup.remove_repeats(docs, whole_characters=True)
    left = F.when(F.col("text").isNotNull(), F.col(found.columns[-2]).cast("string"))
    out = found.withColumn("text", left).select(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids, with the ids."""
    return packing.pack(docs)


STAGES = [("language ID", language), ("quality rules", rules), ("n-gram Jaccard join", near_duplicates), ("suffix-array dedup", passages), ("packing", sequences)]
#: SQL has neither the trained stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a scale folder."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

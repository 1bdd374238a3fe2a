"""The queries of the text operators, opN_<name> for operator N, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import oracles
from tessera.llm.alignment import op11_cross_tokenizer
from tessera.llm.ann import op6_nearest_neighbours
from tessera.llm.bpe import op5_byte_bpe
from tessera.llm.chat import op4_chat_formatting
from tessera.llm.clusters import op12_centroid_clustering
from tessera.llm.jaccard import op10_jaccard_join
from tessera.llm.language_id import op1_language_id
from tessera.llm.licenses import op9_license_scans
from tessera.llm.lm_scoring import op2_lm_scoring
from tessera.llm.packing import op3_packing
from tessera.llm.quality import op8_quality_rules
from tessera.llm.simhash import op13_simhash_dedup
from tessera.llm.suffix_dedup import op7_suffix_dedup

_OPERATORS = (op1_language_id, op2_lm_scoring, op3_packing, op4_chat_formatting, op5_byte_bpe, op6_nearest_neighbours, op7_suffix_dedup, op8_quality_rules, op9_license_scans, op10_jaccard_join, op11_cross_tokenizer, op12_centroid_clustering, op13_simhash_dedup)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline from language ID to packing."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return {f.__name__: f for f in _OPERATORS} | {"pipeline": pipeline}


def oracle_sql():
    return {"op6_nearest_neighbours": oracles.NEAREST_NEIGHBOURS, "op7_suffix_dedup": oracles.SUFFIX_DEDUP, "op10_jaccard_join": oracles.JACCARD_JOIN, "op12_centroid_clustering": oracles.CENTROID_CLUSTERING}

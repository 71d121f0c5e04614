"""A training-data pipeline: toxicity, quality rules, exact duplicates, near copies, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; the driver, and :func:`run`, write it as
Parquet and read it again for the next. All stages but the last keep the columns of documents.

Defined results. Null and empty texts, and those of fewer than 50 words, go with the quality rules. Without labels nothing is toxic. Of rows with equal
texts one stays, whatever their ids; rows with a null id stay among near copies. Very long texts are taken whole. An empty table gives no
sequence.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loadloom.llm import exact_dedup, jaccard_join, packing, quality_rules, toxicity
from loadloom.llm.common import Shelf, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below the threshold stay."""
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep(docs)


def drop_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, the document of the least id stays."""
    return jaccard_join.dedup(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality_rules", drop_poor), ("exact_dedup", drop_equal), ("ngram_jaccard", drop_near), ("packing", pack)]

#: The stages aren't expressible in SQL; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), Shelf(spark)
    for name, stage in STAGES:
        after = Shelf(spark)
        docs = after.put(stage(spark, docs, sf_dir), f"stage-{name}")
        before.clear()  # of what a stage took only its result is needed on
        before = after
    return docs

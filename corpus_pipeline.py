"""From documents to packed training sequences: quality, language, near duplicates, packing.

``STAGES`` names the stages in order. Each takes (spark, docs, sf_dir) and returns a DataFrame,
which is written and reread as the next one's docs; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veritab.llm import jaccard, langid, pack, quality
from veritab.llm.common import bounded_batches, materialize
from veritab.llm.queries import fold, tokenizer_path

#: The stages train, filter and pack by fitted models and hashed sets, which SQL cannot state.
ORACLE_SQL = None


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 0 go."""
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels, fold(labels["doc_id"], 3) != 1)
    return quality.keep_good(docs, model)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, and those between two languages, go."""
    bounded_batches(spark)
    model = langid.train(docs, fold(docs["doc_id"], 5) != 0)
    return langid.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, similarity 0.8) the smallest id stays."""
    bounded_batches(spark)
    return jaccard.keep_one(docs, size=5, percent=80)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, tokenized and packed."""
    bounded_batches(spark)
    return pack.pack(docs, tokenizer_path())


STAGES = [
    ("quality", drop_low_quality),
    ("language", drop_unidentified),
    ("near duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

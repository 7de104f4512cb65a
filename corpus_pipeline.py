"""A training-data pipeline over ``documents``: filter by quality, drop near copies, hide personal data, mix, encode.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of documents;
the last returns doc_id, n_tokens, ids and round_trip. Repeated rows pass like others, an empty table gives an empty
one, and further columns, whatever their names, pass through all stages but the last. ``run`` writes each stage to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoledger.llm.mixing import mixed_documents
from chronoledger.llm.near_dedup import keep_first
from chronoledger.llm.pii import pseudonymised, secret_key
from chronoledger.llm.quality import keep_quality
from chronoledger.llm.sentencepieces import encoded
from chronoledger.session import ship
from chronoledger.storage import written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on ``labels``, does not reject; null and empty texts are scored as empty ones."""
    ship(spark)
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; rows without words or doc_id stand for themselves."""
    ship(spark)
    return keep_first(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in place of personal values; null and empty texts stay."""
    return pseudonymised(docs, secret_key(spark))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, shard by shard; those without words are not taken."""
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix; empty texts have none."""
    ship(spark)
    return encoded(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("sentencepiece", sentencepiece)]

#: SQL expresses neither the classifier nor the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

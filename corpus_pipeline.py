"""A training corpus from `documents`, stage by stage, each over all that the one before kept.

Every stage's rows are written as Parquet in the shared folder and read again as the next one's
documents; what a stage wrote besides, and the documents that only it read, are then deleted.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard_join, mixing, packing, pii, quality
from tidemark.llm.common import discard, read_documents, scratch, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by word shingles, five words and 0.75, the smallest id stays."""
    return jaccard_join.keep_one(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to marks of their kind."""
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return pii.redact_documents(docs).withColumn("n_chars", length)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: texts repeat, are cut or go."""
    return mixing.take_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("personal_data", personal_data_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier, the tokenizer and the hash orders have no SQL; tests compare each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = read_documents(spark, sf_dir), None
    for name, stage in STAGES:
        with scratch() as made:
            docs = written(stage(spark, docs, sf_dir), name)
            made.remove(docs)
        if last is not None:
            discard(last)
        last = docs
    return docs

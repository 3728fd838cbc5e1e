"""Documents in, packed training windows out: quality rules, two kinds of deduplication, masking, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from forecourt.functions.lineage import delete_folder, new_folder, shared_folder
from forecourt.llm import exact_dedup, packing, pii, quality, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; boilerplate lines of the others are removed."""
    return quality.keep_good(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays."""
    return simhash.drop_near_duplicates(docs, shingle_words=3, max_bits=2)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is replaced by its kind."""
    return pii.mask_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("simhash_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", pack),
]

# SQL can express neither the fingerprints nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each is written to shared storage as Parquet and read again by the next.

    A stage's checkpoints lie in a folder of their own and go when it is written, and so does the result of the stage
    before: what a finished pipeline leaves is its own result.
    """
    context, docs = spark.sparkContext, spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before, checkpoints = new_folder(spark, "corpus-pipeline"), None, context.getCheckpointDir()
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        context.setCheckpointDir(f"{path}-checkpoints")
        try:
            stage(spark, docs, sf_dir).write.parquet(path)
        finally:
            delete_folder(spark, f"{path}-checkpoints")
            context.setCheckpointDir(checkpoints or shared_folder(spark))
        if before:
            delete_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs

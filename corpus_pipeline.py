"""The corpus pipeline: five stages over `documents`, each written as Parquet before the next reads it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from claimwright.llm import decontam, minhash, mixing, secret_scan, toxicity
from claimwright.llm.scratch import shared_folder


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return minhash.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    return secret_scan.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; documents of which it takes none go."""
    return mixing.mix(docs).filter("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", without_toxic),
    ("near_dedup", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("mixing", mixed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over `documents`; what lies between goes to the shared checkpoint folder.

    Every stage takes null texts, ids and sources, repeated rows, other columns and an
    empty table: a null text is clean, near only to other empty ones and takes no words
    of the mix.  The written stages stay until the folder is cleared, as rows are read
    from the last.
    """
    work = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{work}/{k}_{name}")
        docs = spark.read.parquet(f"{work}/{k}_{name}")
    return docs

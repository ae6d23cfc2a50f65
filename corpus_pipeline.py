"""The corpus pipeline: from raw documents to token ids, each stage written before the next reads it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tramline.llm import bpe, common, language_id, mixing, secret_scan, simhash


def language_id_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no clear language, go."""
    return language_id.keep_known(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates by five-word shingles the document with the smallest id stays: the trie join's links, once checked, and those beyond its 3 bits."""
    return simhash.keep_one(docs, simhash.near_duplicates)


def secret_scan_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; all documents stay."""
    return secret_scan.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's target weight asks for."""
    return mixing.mix(docs)


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, with digests of the ids and of the bytes they decode to."""
    return bpe.encode(docs, keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id_stage),
    ("simhash_near_dedup", simhash_stage),
    ("secret_scan", secret_scan_stage),
    ("mixing", mixing_stage),
    ("byte_bpe", byte_bpe_stage),
]

#: Learned models, near-duplicates and tokens are beyond SQL; the tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents in sf_dir; what each stage leaves is written to the shared folder and read again.

    A stage's folder goes once the next stage's is written. The last one's is what the result reads: the caller deletes
    it (the result's inputFiles() tell it) when it is no longer needed.
    """
    common.shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            common.remove(spark, before)
        before = out
    return docs

"""A training-data pipeline: each stage reads the Parquet of the one before and works on all that it kept.

toxicity drops documents that the classifier rejects; exact_dedup keeps the largest doc_id of equal texts;
simhash_near_dedup keeps the smallest doc_id of each group of near-duplicates; secret_scan replaces secrets in the
texts and corrects n_chars; packing returns the pieces of training sequences. All stages but the last return the
columns of documents. Null texts count as empty throughout; an empty table passes through. run() removes what a stage wrote
once the next has written; the last stage's table stays, since the result reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact, packing, secret_scan, simhash, toxicity
from tessera.llm.common import delete, shared_folder, table
from tessera.llm.queries import END_ID, tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_filter(docs, table(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.keep_one(docs, keep="largest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json").decode(), END_ID)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("simhash_near_dedup", drop_near_copies), ("secret_scan", redact_secrets), ("packing", pack)]

#: Classification, SimHash and tokenisation have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    done = None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if done:
            delete(spark, done)
        done = path
    return docs

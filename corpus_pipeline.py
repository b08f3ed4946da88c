"""A training-data pipeline over documents: each stage reads what the one before wrote.

Every stage but the last returns the columns of documents. None of its decisions is undone later.

Defined cases: the stages take nulls in any column, empty and very long texts, ties, repeated rows, empty tables and
further columns as their operators do. A document with a null or empty text gets the classifier's score of an empty text;
if it stays, it is no duplicate of any other, is never tainted and has no tokens. Of rows that repeat one stays. An empty
table passes through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, decontaminate, minhash, pii, quality
from tidemill.llm.common import drop_folder, shared_dir, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return minhash.keep_one(docs)


def untainted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes placeholders; n_chars is the new text's."""
    return pii.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, n_tokens, ids (little-endian unsigned 32-bit integers) and decoded_sha256 of each document."""
    import public_tokenizers

    done = bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return done.select("doc_id", "source", "lang", "n_tokens", "ids", "decoded_sha256")


STAGES = [("quality", good), ("near_duplicates", distinct), ("decontamination", untainted), ("personal_data", private), ("tokens", tokens)]

#: Compression, MinHash and byte-pair merges can't be said in SQL; tests hold run() against the stages by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents; every stage's are written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    base, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_folder(spark, before)  # it has been read for the last time
        docs, before = spark.read.parquet(path), path
    return docs

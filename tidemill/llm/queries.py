"""The queries of this subpackage, by name; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.common import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm import decontaminate as d

    return d.digest(d.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm import chat

    return chat.digest(table(spark, sf_dir, "conversations"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm import fingerprint

    return fingerprint.digest(table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm import pii

    return pii.digest(table(spark, sf_dir, "documents"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemill.llm import bpe

    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm import minhash

    return minhash.digest(table(spark, sf_dir, "documents"))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm import repeats

    return repeats.digest(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm import toxicity

    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm import quality

    return quality.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemill.llm import paragraphs

    return paragraphs.digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}

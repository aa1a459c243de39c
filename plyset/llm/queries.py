"""Thin queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plyset.llm import decontaminate, divergence, embedding_dedup, extraction, langid, line_dedup, lm, near_dedup, packing, quality, secrets, warc
from plyset.llm.common import table


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_by_fold(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), mod=3, held=1)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), n=2)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find(table(spark, sf_dir, "documents")))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_by_fold(table(spark, sf_dir, "documents"), mod=4, held=2)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_by_fold(table(spark, sf_dir, "documents"), mod=7, held=2)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "removed_words", "removed_chunks", "text")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))

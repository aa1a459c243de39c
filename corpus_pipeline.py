"""The corpus pipeline: stages that each apply one operator to what the one before kept.

Every stage but the last returns documents with the columns it got, fewer or changed:

1. language ID drops what it rejects: texts without a letter, and those whose language it scores
   below ``REJECT`` (it learns from all given rows that have a language, on a bounded sample);
2. line dedup removes repeated passages, and documents of which nothing is left;
3. near-dedup keeps one document of each group, on shingles of five words;
4. decontamination drops documents that leak a test item;
5. packing returns the pieces of all that is left, with their places in sequences.

Rows with a null id pass stages 1, 2 and 4 by their text; stage 3 can't name a group by them and
keeps them. Run over an empty table, every stage returns no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plyset.llm import decontaminate, langid, line_dedup, near_dedup, packing
from plyset.llm.common import drop_staged, staged, table, without
from plyset.llm.queries import tokenizer_file

REJECT = 0.2
WORDS = 5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    typed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    out = langid.predict(docs, langid.learn(typed))
    return out.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= REJECT)).select("row.*")


def line_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = line_dedup.cleaned(docs)
    left = (F.col("removed_words") == 0) | F.col("text").rlike(r"[^\x09-\x0D\x20]")
    out = out.filter(F.coalesce(left, F.lit(True)))

    def column(c: str):
        kind = docs.schema[c].dataType
        if c == "text":
            return F.col("text").cast(kind).alias(c)
        if c == "n_chars":  # follows the text
            return F.when(F.col("removed_words") > 0, F.char_length("text").cast(kind)).otherwise(F.col("row.n_chars")).alias(c)
        return F.col(f"row.`{c}`").alias(c)

    return out.select(*(column(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_dedup.near_duplicates(docs, n=WORDS).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("key")).distinct()
    return without(docs, F.col("doc_id").cast("long"), staged(gone, "gone"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_chunks),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: Stages 1, 2, 3 (bands of hashes) and 5 (search) can't be said in SQL; tests check what each stage keeps by plain readings.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written as Parquet and read again; what no stage reads any more is deleted."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            drop_staged(before)
    return docs

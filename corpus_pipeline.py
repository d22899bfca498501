"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Stage by stage: documents that the quality model rejects go; of equal texts the smallest id stays; of each group of near
duplicates (five-word shingles, similarity 0.8 or more) the smallest id stays; personal data becomes a placeholder; what is
left is tokenized and packed. Every stage works on all that its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import exact_dedup, near_join, packing, pii, quality
from loomspark.llm.common import staged, table
from loomspark.llm.queries import WORD_MODEL

SHINGLE_WORDS, SIMILAR_PERCENT, GOOD = 5, 80, 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.keep_good(docs, quality.fitted(docs, labels, ~quality.held_out()), GOOD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.without_near_copies(docs, words=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType)) if "n_chars" in clean.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, WORD_MODEL)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("pii", redact_personal_data),
    ("packing", pack),
]

#: SQL cannot express a fitted model or the tokenizer; tests hold the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs

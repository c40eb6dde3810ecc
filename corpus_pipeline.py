"""The training-data pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.llm.common import documents, own_folder
from sedimark.llm.exact_dedup import exact_dedup
from sedimark.llm.langid import in_known_languages
from sedimark.llm.packing import best_fit_packing
from sedimark.llm.pii import redact
from sedimark.llm.simhash import similar_surplus
from sedimark.shipping import ship


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the numbered rows; a stage's input is a written table, so numbers are the same in every reading."""
    own = f"row_{uuid.uuid4().hex}"
    numbered = docs.withColumn(own, F.monotonically_increasing_id())
    return numbered.join(rows.select(F.col("row").alias(own)), own, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language stay, and have it as their lang.

    Null, empty and letterless texts have no language and go; repeated rows stay, however long.  Without a single labelled
    row no language is known, and every document goes.
    """
    return in_known_languages(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z in lower case, null as empty) the row with the largest doc_id stays, null ids last, one of rows that repeat."""
    return _without(docs, exact_dedup(docs, F.monotonically_increasing_id()).where("NOT kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts alike to 0.8 or more by five-word shingles, the row with the smallest doc_id stays.

    Texts without a word are alike, and like no other; of equal or null ids the first row stays.  Texts shorter than a
    shingle are one shingle.
    """
    return _without(docs, similar_surplus(docs, F.monotonically_increasing_id()))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows.  Every row stays; null and empty texts stay as they are."""
    masked = redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, packed into sequences of 4096 tokens; null and empty texts are their end token alone."""
    return best_fit_packing(docs)


STAGES = [("language", language), ("exact", exact), ("near", near), ("personal", personal), ("packing", packing)]

#: No SQL: language profiles, radix classes and fingerprints aren't SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    ship(spark)
    df = documents(spark, sf_dir)
    folder = own_folder(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if i < len(STAGES) - 1:
            df.write.parquet(f"{folder}/{name}")
            df = spark.read.parquet(f"{folder}/{name}")
    return df

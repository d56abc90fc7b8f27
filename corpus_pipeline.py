"""From raw documents to packed training sequences.

STAGES in order: (name, function of (spark, docs, sf_dir)). Each takes what the one before kept, as Parquet written and read
again, and all but the last give the columns of `documents`. Every stage works on all its rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duploscope.llm import decontamination, near_dedup, packing, pii, quality
from duploscope.llm.columns import table
from duploscope.session import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from all labelled documents of its input, up to its sample.

    Texts stay as they are; null and empty ones have the score of a text without words.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs.select("doc_id", "text"), labels)
    given = docs.select(*COLUMNS, F.col("text").isNull().alias("_null"))
    scored = quality.score(given, model, ("doc_id", "lang", "source", "n_chars", "_null")).filter(F.col("score") >= quality.ACCEPTED)
    return scored.withColumn("text", F.when(~F.col("_null"), F.col("text"))).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five words, 0.8), the one with the smallest doc_id; rows that repeat a
    doc_id stay or go together."""
    dropped = (
        near_dedup.near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias("_dropped")).distinct()
    )
    dropped = materialize(dropped)
    return docs.join(dropped, docs["doc_id"] == dropped["_dropped"], "left_anti").select(*COLUMNS)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (five words, 0.8 of its shingles)."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars is that of the new text where the text changed."""
    hidden = pii.redact(docs.select(*COLUMNS, F.col("text").alias("_before")))
    changed = ~F.col("text").eqNullSafe(F.col("_before"))
    return hidden.withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("personal_data", hide_personal_data),
    ("packing", pack),
]
ORACLE_SQL = None  # classifier, search and vocabulary are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

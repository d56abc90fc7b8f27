"""Small column helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str) -> Column:
    """The text; a null counts as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as decimal text, modulo `folds`: the folds that the queries fix. A null id falls into fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(0))


def bounded_batches(spark: SparkSession) -> None:
    """Sets smaller Arrow batches where the session has Spark's defaults: rows here are whole texts or sets, and a batch is held
    several times on its way between the JVM and a worker."""
    for key, default, value in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"),
        ("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20), str(8 << 20)),
    ):
        current = spark.conf.get(key, None)
        if current in (None, default, f"{default}b", "64MB", "64m", "67108864b"):
            spark.conf.set(key, value)

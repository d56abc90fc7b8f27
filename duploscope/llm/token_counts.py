"""Exact token counts from a histogram of document lengths.

Method: documents are counted by encoded length, in each task and then over all; sums over that
histogram answer totals, quantiles and truncated totals for every context limit. The histogram has one
row per distinct length, so it is bounded by the longest document and not by their number.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duploscope.llm.columns import text_or_empty
from duploscope.llm.tokens import VOCABULARY, encoder
from duploscope.session import materialize

BLOCK = 512  # lengths whose running sums are made together


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    encode = encoder(path).ids
    counts: Counter[int] = Counter()
    for batch in batches:
        counts.update(len(encode(text.as_py())) for text in batch.column("text"))
    yield pa.RecordBatch.from_arrays(
        [pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], names=["n_tokens", "documents"]
    )


def length_histogram(docs: DataFrame, tokenizer: str = VOCABULARY) -> DataFrame:
    """(n_tokens, documents) over the column text; null and empty texts have no tokens. Repeated rows count each."""
    parts = docs.select(text_or_empty("text").alias("text")).mapInArrow(
        lambda batches: _counted(batches, tokenizer), "n_tokens long, documents long"
    )
    return parts.groupBy("n_tokens").agg(F.sum("documents").alias("documents"))


def _running(histogram: DataFrame) -> DataFrame:
    """Adds the documents and tokens of shorter and equal lengths and of all; blocks of lengths first, then inside a block."""
    histogram = materialize(histogram)  # which is small, and read twice below
    blocked = histogram.withColumn("_block", F.floor(F.col("n_tokens") / BLOCK)).withColumn(
        "_tokens", F.col("n_tokens") * F.col("documents")
    )
    totals = blocked.groupBy("_block").agg(F.sum("documents").alias("_d"), F.sum("_tokens").alias("_t"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_block",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_d", "_t")],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in ("_d", "_t")],
    )
    upto = Window.partitionBy("_block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    return blocked.join(offsets, "_block").select(
        "n_tokens", "documents",
        (F.col("_d_before") + F.sum("documents").over(upto)).alias("documents_up_to"),
        (F.col("_t_before") + F.sum("_tokens").over(upto)).alias("tokens_up_to"),
        F.col("_d_all").alias("all_documents"), F.col("_t_all").alias("all_tokens"),
    )


def _truncated(limit: Column) -> Column:
    return F.col("tokens_up_to") + limit * (F.col("all_documents") - F.col("documents_up_to"))


def length_table(histogram: DataFrame) -> DataFrame:
    """Per length that occurs: documents, longer_documents, tokens_up_to (of documents of at most that length),
    truncated_tokens (all documents cut at that length), quantile (share of documents of at most that length), all_tokens."""
    return _running(histogram).select(
        "n_tokens", "documents",
        (F.col("all_documents") - F.col("documents_up_to")).alias("longer_documents"),
        "tokens_up_to",
        _truncated(F.col("n_tokens")).alias("truncated_tokens"),
        (F.col("documents_up_to") / F.col("all_documents")).alias("quantile"),
        "all_tokens",
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_tokens, cut_documents) for any limits of at least 0, also ones that no document has."""
    tokens, documents = F.col("n_tokens"), F.col("documents")
    answers = [
        F.struct(
            F.lit(int(limit)).cast("long").alias("context_limit"),
            F.coalesce(F.sum(F.least(tokens, F.lit(int(limit))) * documents), F.lit(0)).alias("truncated_tokens"),
            F.coalesce(F.sum(F.when(tokens > limit, documents)), F.lit(0)).alias("cut_documents"),
        )
        for limit in limits
    ]
    return histogram.agg(F.array(*answers).alias("_answers")).select(F.inline("_answers"))


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the smallest length that at least `share` of the documents do not exceed; null without documents."""
    answers = [
        F.struct(
            F.lit(float(share)).alias("share"),
            F.min(F.when(F.col("quantile") >= float(share), F.col("n_tokens"))).alias("n_tokens"),
        )
        for share in shares
    ]
    return length_table(histogram).agg(F.array(*answers).alias("_answers")).select(F.inline("_answers"))

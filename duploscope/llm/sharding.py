"""Contiguous shards of nearly equal bytes.

Method: global prefix sums of the documents' sizes from the totals of each partition, cut at equal targets.
Rows of (id, size, checksum) are dealt out in ranges of the id; each range is summed where it is, and only
one row for each range meets in one task. Text stays in the scan that measures it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duploscope.functions.ranking import with_blocks
from duploscope.llm.columns import text_or_empty
from duploscope.session import materialize

OVERHEAD = 16  # bytes that every document counts besides its text


def balanced_shards(docs: DataFrame, shards: int) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): documents in order of doc_id, cut where the sizes before a document's middle
    pass the next equal share.

    `docs` has doc_id and text. A size is the text's UTF-8 bytes and OVERHEAD; a null text has none and its checksum is
    that of no bytes. Shards differ from the equal share by less than one document. Null ids come first;
    rows that repeat an id stand together, by size and checksum. slot counts from 0 within the shard. Equal texts are not
    kept together: one of them may fill more than a shard. An empty table gives no rows.
    """
    text = text_or_empty("text")
    measured = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
    )
    order = [F.col("doc_id").asc_nulls_first(), F.col("size"), F.col("text_crc32")]
    blocked = with_blocks(measured, order)
    totals = blocked.groupBy("_block").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_block",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_bytes_before"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_rows_before"),
        F.sum("_bytes").over(whole).alias("_all"),
    )
    inside = Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("_bytes_before") + F.sum("size").over(inside) - F.expr("size div 2")
    placed = materialize(
        blocked.join(offsets, "_block").select(
            "doc_id", "size", "text_crc32",
            (F.col("_rows_before") + F.count(F.lit(1)).over(inside) - 1).alias("_place"),
            F.least(F.floor(middle / F.col("_all") * shards), F.lit(shards - 1)).cast("int").alias("shard"),
        )
    )
    firsts = placed.groupBy("shard").agg(F.min("_place").alias("_first"))
    return placed.join(firsts, "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_place") - F.col("_first")).alias("slot")
    )

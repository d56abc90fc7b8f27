"""Document fingerprints: threshold-scaled sketches, in DataFrame functions only.

Method: of the hashes of a text's distinct shingles (five words; fewer words make one shingle of them
all), every one below a fixed fraction of the hash range is retained, whatever the text's length. Such
sketches merge by union and give containment between texts of very unequal length, because both
sides are complete below the same limit. Texts of which fewer than FLOOR hashes lie below the limit
keep their FLOOR smallest ones (or all they have), so that short texts can be told apart as well; the
sketch is then complete up to its largest hash.

A sketch is a sorted array of 64-bit hashes; the fingerprint is the same as text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duploscope.functions.ranking import with_blocks
from duploscope.llm.columns import text_or_empty
from duploscope.session import materialize

WIDTH = 5
FRACTION = 16  # one hash in so many is retained
FLOOR = 32
LIMIT = -(1 << 63) + (1 << 64) // FRACTION  # hashes are signed
NO_ID = -(1 << 63)  # stands for a null id, which thereby comes last in descending order

_SPACES = " \t\n\x0b\x0c\r"


def with_sketch(docs: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the sketch of a text column. A null text counts as empty; an empty sketch is that of a text without words."""
    trimmed = F.btrim(text_or_empty(text), F.lit(_SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))
    last = F.greatest(F.size("_words") - WIDTH, F.lit(0))

    def shingle(i: Column) -> Column:
        return F.xxhash64(*[F.get("_words", i + step) for step in range(WIDTH)])  # nulls beyond the end do not count

    hashes = F.when(F.size("_words") > 0, F.transform(F.sequence(F.lit(0), last), shingle))
    below = F.array_distinct(F.filter(F.col("_hashes"), lambda h: h < LIMIT))
    smallest = F.slice(F.sort_array(F.array_distinct("_hashes")), 1, FLOOR)
    sketch = F.when(F.size("_below") >= FLOOR, F.sort_array("_below")).otherwise(smallest)
    return (
        docs.withColumn("_words", words)
        .withColumn("_hashes", F.coalesce(hashes, F.array().cast("array<long>")))
        .withColumn("_below", below)
        .withColumn(name, sketch)
        .drop("_words", "_hashes", "_below")
    )


def fingerprint(sketch: str | Column) -> Column:
    """The sketch as text: its hashes in hexadecimal, in order."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ",")


def merged(first: str, second: str) -> Column:
    """Sketch of the texts together, of two sketches."""
    union = F.sort_array(F.array_union(first, second))
    below = F.filter(union, lambda h: h < LIMIT)
    return F.when(F.size(below) >= FLOOR, below).otherwise(F.slice(union, 1, FLOOR))


def likeness(first: str, second: str) -> Column:
    """Estimated containment of the smaller text in the larger, from 0 to 1.

    Compared are the hashes up to which both sketches are complete. Equal sketches, also two empty ones, give 1;
    where nothing is left to compare, 0.
    """

    def complete_to(sketch: str) -> Column:
        kept = F.greatest(F.element_at(sketch, -1), F.lit(LIMIT - 1))
        return F.when(F.size(sketch) >= FLOOR, kept).otherwise(F.lit((1 << 63) - 1))

    limit = F.least(complete_to(first), complete_to(second))
    left, right = (F.filter(sketch, lambda h: h <= limit) for sketch in (first, second))
    smaller = F.least(F.size(left), F.size(right))
    common = F.size(F.array_intersect(left, right))
    return (
        F.when(F.col(first) == F.col(second), 1.0)
        .when(smaller == 0, 0.0)
        .otherwise(common.cast("double") / smaller)
    )


def _donors(docs: DataFrame) -> DataFrame:
    """(_key, _prev, _take) of each id: the id that precedes it in descending order, and a third of that one's length.

    Ids are dealt out in ranges; only the ranges' first ids, one for each partition, meet in one task.
    """
    lengths = docs.groupBy("_key").agg(F.max(F.char_length("text")).alias("_n"))
    order = [F.col("_key").desc()]
    blocked = with_blocks(lengths, order)
    heads = blocked.groupBy("_block").agg(F.max("_key").alias("_head"))
    onward = Window.orderBy("_block")
    whole = onward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("_block", F.coalesce(F.lead("_head").over(onward), F.first("_head").over(whole)).alias("_head"))
    inside = Window.partitionBy("_block").orderBy(*order)
    linked = blocked.withColumn("_next", F.lead("_key").over(inside)).join(heads, "_block")
    return materialize(
        linked.select(
            F.coalesce("_next", "_head").alias("_key"), F.col("_key").alias("_prev"), F.floor(F.col("_n") / 3).alias("_take")
        )
    )


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole documents and of edited ones, and how alike they are.

    `docs` has doc_id and text. A document's next one is that of the next smaller doc_id, after the smallest the
    largest; its edited text has the last floor(n/3) of its n code points replaced by the first as many (or all) of the next one's.
    Null and empty texts are documents without characters. A null doc_id counts as smaller than all others. Rows that repeat a
    doc_id share their next document (by the longest of them), and where the next doc_id repeats, the row whose beginning
    comes first in order counts. A single document is its own next one. Columns: doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.
    """
    given = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_key"), text_or_empty("text").alias("text")
    )
    donors = _donors(given)
    sketched = with_sketch(given, "text", "_sketch")
    next_ones = (
        sketched.join(donors, "_key")
        .select("_prev", F.struct(F.expr("substring(text, 1, _take)").alias("prefix"), F.col("_sketch").alias("sketch")).alias("_next"))
        .groupBy(F.col("_prev").alias("_key"))
        .agg(F.min("_next").alias("_next"))
    )
    n_chars = F.char_length("text")
    edited = F.concat(
        F.expr("substring(text, 1, char_length(text) - floor(char_length(text) / 3))"),
        F.expr("substring(_next.prefix, 1, floor(char_length(text) / 3))"),
    )
    both = (
        sketched.join(next_ones, "_key")
        .select("_key", n_chars.cast("long").alias("n_chars"), "_sketch", F.col("_next.sketch").alias("_next_sketch"), edited.alias("_edited"))
    )
    compared = with_sketch(both, "_edited", "_edited_sketch")
    return compared.select(
        F.when(F.col("_key") != NO_ID, F.col("_key")).alias("doc_id"),
        "n_chars",
        F.sha2("_edited", 256).alias("edited_sha256"),
        fingerprint("_sketch").alias("fingerprint"),
        fingerprint("_edited_sketch").alias("edited_fingerprint"),
        likeness("_sketch", "_edited_sketch").alias("near_edited"),
        likeness("_sketch", "_next_sketch").alias("near_next"),
    )

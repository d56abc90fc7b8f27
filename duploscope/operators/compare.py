"""Comparison of a master folder with target folders, all targets in one job.

Items matched by content can be many on both sides. Their pairs are not written out: a moved master
item points to its match set (target, length, content_key), whose items are one row each.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duploscope.functions import paths
from duploscope.session import materialize

# Statuses in their sort order.
STATUSES = ("Identical", "Different", "OnlyInMaster", "OnlyInTarget", "MovedRenamedExactMatch")
SET_KEY = ("target", "length", "content_key")


class Comparison(NamedTuple):
    rows: DataFrame
    match_sets: DataFrame
    summary: DataFrame


def _side(items: DataFrame, prefix: str) -> DataFrame:
    return items.select(
        "target",
        paths.relative_path("root", "path").alias("relative"),
        *[F.col(name).alias(f"{prefix}_{name}") for name in ("path", "length", "modified_at", "content_key")],
    )


def target_list(master_root: str, targets: Sequence[str]) -> list[str]:
    """Distinct targets without the master itself, sorted."""
    distinct: dict[str, str] = {}
    for target in targets:
        trimmed = target.rstrip("/\\")
        if trimmed.upper() != master_root.rstrip("/\\").upper():
            distinct.setdefault(trimmed.upper(), trimmed)
    return sorted(distinct.values())


def match_same_path(master: DataFrame, targets: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Both sides by (target, relative path), unmatched rows of either side included.

    Items carry root, path, length, modified_at and a proved content_key, null where unreadable.
    """
    left = master.withColumn("target", F.explode(F.array(*[F.lit(root) for root in roots])))
    known = F.create_map(*[F.lit(name) for root in roots for name in (root.upper(), root)])
    right = targets.withColumn("target", F.try_element_at(known, F.upper(paths.trim_separators("root")))).filter("target IS NOT NULL")
    return _side(left, "master").join(_side(right, "compared"), ["target", "relative"], "full_outer")


def compare_master(master: DataFrame, targets: DataFrame, master_root: str, roots: Sequence[str]) -> Comparison:
    """Status of every relative path for each target, the match sets of moved items, and a summary per target."""
    roots = target_list(master_root, roots)
    both = materialize(match_same_path(master, targets, roots))
    matched = compare_same_path(both)
    lost = both.filter("compared_path is null").withColumns(
        {"length": F.col("master_length"), "content_key": F.col("master_content_key")}
    )
    extra = both.filter("master_path is null").withColumns(
        {"length": F.col("compared_length"), "content_key": F.col("compared_content_key")}
    )
    sets = extra.filter("content_key is not null").groupBy(*SET_KEY).agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(F.struct("relative", "compared_path", "compared_length", "compared_modified_at")).alias("_first"),
    )
    found = lost.drop("compared_path", "compared_length", "compared_modified_at", "compared_content_key").join(
        sets, list(SET_KEY), "left"
    )
    of_master = _rows(
        found.withColumns({f"compared_{name}": F.col(f"_first.compared_{name}") for name in ("path", "length", "modified_at")}),
        F.when(F.col("_n").isNull(), F.lit("OnlyInMaster")).otherwise(F.lit("MovedRenamedExactMatch")),
        F.coalesce("_n", F.lit(0)),
        F.col("_n").isNotNull(),
    )
    used = lost.filter("content_key is not null").select(*SET_KEY).distinct()
    match_sets = extra.join(used, list(SET_KEY), "left_semi").select(
        *SET_KEY, F.col("relative").alias("compared_relative"), "compared_path"
    )
    of_target = _rows(extra.join(used, list(SET_KEY), "left_anti"), F.lit("OnlyInTarget"), F.lit(1), F.lit(False))
    rows = matched.unionByName(of_master).unionByName(of_target)
    return Comparison(rows, match_sets, compare_summary(rows, both, roots))


def compare_same_path(both: DataFrame) -> DataFrame:
    """Identical or Different for paths on both sides; content that could not be compared counts as Different."""
    equal = (F.col("master_length") == F.col("compared_length")) & (
        F.col("master_content_key") == F.col("compared_content_key")
    )
    status = F.when(F.coalesce(equal, F.lit(False)), F.lit("Identical")).otherwise(F.lit("Different"))
    return _rows(both.filter("master_path is not null and compared_path is not null"), status, F.lit(1), F.lit(False))


def _rows(df: DataFrame, status, compared_count, has_set) -> DataFrame:
    set_key = (
        F.when(has_set, F.struct(F.col("master_length").alias("length"), F.col("master_content_key").alias("content_key")))
    )
    return df.select(
        "target",
        "relative",
        status.alias("status"),
        "master_path",
        F.col("master_length").alias("master_size"),
        F.col("master_modified_at").alias("master_modified"),
        "compared_path",
        F.col("compared_length").alias("compared_size"),
        F.col("compared_modified_at").alias("compared_modified"),
        compared_count.cast("long").alias("compared_count"),
        set_key.alias("match_set"),
    )


def sort_compare_rows(rows: DataFrame) -> DataFrame:
    """By target, relative path and status."""
    ordinal = F.array_position(F.array(*[F.lit(status) for status in STATUSES]), F.col("status"))
    return rows.orderBy("target", "relative", ordinal)


def compare_summary(rows: DataFrame, both: DataFrame, roots: Sequence[str]) -> DataFrame:
    """Per target, also one without any file: files on both sides, count of each status, bytes of identical files."""
    files = both.groupBy("target").agg(
        F.count("master_path").alias("master_files"), F.count("compared_path").alias("target_files")
    )
    counts = rows.groupBy("target").agg(
        F.count_if(F.col("status") == "Identical").alias("identical"),
        F.count_if(F.col("status") == "Different").alias("different"),
        F.count_if(F.col("status") == "OnlyInMaster").alias("only_in_master"),
        F.count_if(F.col("status") == "OnlyInTarget").alias("only_in_target"),
        F.count_if(F.col("status") == "MovedRenamedExactMatch").alias("moved"),
        F.coalesce(F.sum(F.when(F.col("status") == "Identical", F.col("master_size"))), F.lit(0)).alias("identical_bytes"),
    )
    targets = rows.sparkSession.createDataFrame([(root,) for root in roots], "target string")
    return targets.join(files, "target", "left").join(counts, "target", "left").na.fill(0)


def filter_compare_rows(rows: DataFrame, status: str | None = None, search: str | None = None) -> DataFrame:
    kept = rows.filter(paths.search_match((search or "").strip(), "relative"))
    return kept.filter(F.col("status") == status) if status else kept

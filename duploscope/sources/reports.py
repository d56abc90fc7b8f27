"""Reports as tables, CSV and text.

Rows keep the order columns they are sorted by, so that a written report is a sorted table of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duploscope.functions import formats, paths
from duploscope.operators.compare import SET_KEY, STATUSES
from duploscope.operators.exact import path_order


def duplicate_report_rows(
    members: DataFrame, indexed_groups: DataFrame, visible: DataFrame | None = None
) -> DataFrame:
    """The nine columns of the duplicate report, for all members or those of a filtered view.

    `members` carry `selected`; `indexed_groups` come from `with_group_index`.
    """
    if visible is not None:
        members = members.join(visible.select("group_id", "item_id"), ["group_id", "item_id"], "left_semi")
    numbered = members.join(
        indexed_groups.select("group_id", (F.col("group_index") + 1).alias("Group")), "group_id"
    )
    return numbered.orderBy("Group", *path_order()).select(
        "Group",
        F.col("file_name").alias("Filename"),
        F.col("path").alias("Full path"),
        F.col("length").alias("Size bytes"),
        formats.format_bytes("length").alias("Formatted size"),
        formats.iso_utc("modified_at").alias("Modified"),
        F.col("extension").alias("Extension"),
        paths.review_type("extension").alias("Type"),
        F.when(F.col("selected"), F.lit("Yes")).otherwise(F.lit("No")).alias("Selected candidate"),
    )


def duplicate_report_summary(
    groups: DataFrame, members: DataFrame, selection: DataFrame, scope: str = "All results"
) -> DataFrame:
    """One row of totals. Groups and members are those in scope, the selected figures those of all groups."""
    in_scope = groups.agg(
        F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable")
    ).withColumn("scope", F.lit(scope))
    shown = members.agg(F.count(F.lit(1)).alias("members")).withColumn("scope", F.lit(scope))
    chosen = selection.agg(
        F.count_if("selected").alias("selected"),
        F.coalesce(F.sum(F.when(F.col("selected"), F.col("length"))), F.lit(0)).alias("selected_bytes"),
    ).withColumn("scope", F.lit(scope))
    return in_scope.join(shown, "scope").join(chosen, "scope")


def duplicate_report_text(report_rows: DataFrame) -> DataFrame:
    """(Group, path, line_no, line): five readable lines per row of `duplicate_report_rows`."""
    lines = F.array(
        F.format_string("Group %d: %s", "Group", "Filename"),
        F.concat(F.lit("  Path: "), F.col("Full path")),
        F.format_string("  Size: %d bytes (%s)", "Size bytes", "Formatted size"),
        F.concat(F.lit("  Modified: "), F.col("Modified")),
        F.format_string("  Type: %s; selected candidate: %s", "Type", "Selected candidate"),
    )
    return report_rows.select("Group", F.col("Full path").alias("path"), F.posexplode(lines).alias("line_no", "line"))


def folder_report_rows(results: DataFrame, indexed_groups: DataFrame, own_metrics: DataFrame) -> DataFrame:
    """One row per member folder: its own figures from `folder_metrics`, and the bytes its group could free."""
    numbered = results.select("group_folder", "folder", "reclaimable").join(
        indexed_groups.select("group_folder", (F.col("group_index") + 1).alias("Group")), "group_folder"
    )
    return (
        numbered.join(own_metrics, "folder")
        .orderBy("Group", "folder")
        .select(
            "Group",
            F.col("folder").alias("Folder root"),
            F.col("logical_files").alias("Logical file count"),
            F.col("distinct_identities").alias("Independent physical files"),
            F.col("total_bytes").alias("Total logical bytes"),
            F.col("reclaimable").alias("Potential reclaimable bytes"),
        )
    )


def folder_report_text(groups: DataFrame, members: DataFrame, indexed_groups: DataFrame) -> DataFrame:
    """(Group, part, folder, line_no, line): a head per group, a line per folder and a blank line."""
    numbered = groups.join(
        indexed_groups.select("group_folder", (F.col("group_index") + 1).alias("Group")), "group_folder"
    )
    head = numbered.select(
        "Group",
        F.lit(0).alias("part"),
        F.lit("").alias("folder"),
        F.posexplode(
            F.array(
                F.format_string("Group %d", "Group"),
                F.format_string("Logical files: %d", "logical_files"),
                F.format_string("Independent physical files: %d", "distinct_identities"),
                F.format_string("Potential reclaimable bytes: %d", "reclaimable"),
            )
        ).alias("line_no", "line"),
    )
    of_folder = members.join(numbered.select("group_folder", "Group"), "group_folder").select(
        "Group", F.lit(1).alias("part"), "folder", F.lit(0).alias("line_no"), F.concat(F.lit("  "), "folder").alias("line")
    )
    blank = numbered.select(
        "Group", F.lit(2).alias("part"), F.lit("").alias("folder"), F.lit(0).alias("line_no"), F.lit("").alias("line")
    )
    return head.unionByName(of_folder).unionByName(blank)


def _compared_cell() -> Column:
    """The compared path. A moved item has a set of them: the first, and how many more `comparison_report_moved` lists."""
    more = F.when(F.col("compared_count") > 1, F.format_string(" (+%d)", F.col("compared_count") - 1)).otherwise("")
    return F.concat("compared_path", more)


def comparison_report_moved(match_sets: DataFrame) -> DataFrame:
    """One row per compared path of a match set, for the rows of the report that have several: a set is named by its target, size and
    content and has its paths once, however many master items point to it."""
    return match_sets.select(
        F.col("target").alias("Target"), F.col("length").cast("string").alias("Size"), F.col("content_key").alias("Content"),
        F.col("compared_relative").alias("Relative path"), F.col("compared_path").alias("Compared path"),
    )


def comparison_report_rows(rows: DataFrame) -> DataFrame:
    """The nine columns of the comparison report and the content of a moved item's match set; missing values are empty."""
    text = lambda column: F.coalesce(column.cast("string"), F.lit(""))
    ordinal = F.array_position(F.array(*[F.lit(status) for status in STATUSES]), F.col("status"))
    return (
        rows.withColumn("compared", _compared_cell())
        .orderBy("target", "relative", ordinal)
        .select(
            F.col("target").alias("Target"),
            F.col("status").alias("Status"),
            F.col("relative").alias("Relative path"),
            text(F.col("master_path")).alias("Master path"),
            text(F.col("compared")).alias("Compared path"),
            text(F.col("master_size")).alias("Master size"),
            text(F.col("compared_size")).alias("Compared size"),
            text(formats.iso_utc("master_modified")).alias("Master modified UTC"),
            text(formats.iso_utc("compared_modified")).alias("Compared modified UTC"),
            text(F.col("match_set.content_key")).alias("Match set"),
        )
    )


def comparison_report_head(summary: DataFrame, master_root: str) -> DataFrame:
    """(target, line_no, line): the lines before the rows of a target."""
    lines = F.array(F.lit(f"Master: {master_root}"), F.concat(F.lit("Compared: "), "target"), F.lit(""))
    return summary.select("target", F.posexplode(lines).alias("line_no", "line"))


def comparison_report_text(rows: DataFrame) -> DataFrame:
    """(target, relative, status, line_no, line): three readable lines per row."""
    or_none = lambda name: F.coalesce(F.col(name), F.lit("(none)"))
    lines = F.array(
        F.concat_ws(" | ", "status", "relative"),
        F.concat(F.lit("  Master: "), or_none("master_path")),
        F.concat(F.lit("  Compared: "), or_none("compared")),
    )
    return rows.withColumn("compared", _compared_cell()).select(
        "target", "relative", "status", F.posexplode(lines).alias("line_no", "line")
    )


def write_quoted_csv(rows: DataFrame, path: str) -> None:
    """Every field in quotes, inner quotes doubled."""
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_plain_csv(rows: DataFrame, path: str) -> None:
    """Quotes only where needed, inner quotes doubled, empty fields left empty."""
    rows.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_text(lines: DataFrame, path: str, *order: Column | str) -> None:
    lines.orderBy(*order).select("line").write.text(path)

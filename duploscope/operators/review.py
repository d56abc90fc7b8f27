"""Views on found groups: filters, sorts and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duploscope.functions import formats, paths

SORTS = {
    "reclaimable": lambda: F.col("reclaimable"),
    "file_size": lambda: F.col("length"),
    "copy_count": lambda: F.col("members"),
    "name": lambda: F.upper(paths.file_name("first_path")),
    "path": lambda: F.upper("first_path"),
    "modified": lambda: F.col("first_modified_at"),
}


def members_view(members: DataFrame, groups: DataFrame, roots: Sequence[str] = ()) -> DataFrame:
    """Members with type, location, folder, and the name their group is shown under."""
    shown = groups.select("group_id", paths.file_name("first_path").alias("display_name"))
    return (
        members.join(shown, "group_id")
        .withColumn("type", paths.review_type("extension"))
        .withColumn("location", paths.resolve_location("path", roots))
        .withColumn("folder", paths.containing_folder("path"))
    )


def member_filter(
    search: str | None = None,
    file_type: str | None = None,
    size: str | None = None,
    location: str | None = None,
    min_bytes: int = 0,
    max_bytes: int | None = None,
) -> Column:
    """All given conditions on a row of `members_view`; size "Custom" uses the inclusive byte bounds."""
    condition = paths.search_match(search, "file_name", "extension", "path")
    if file_type:
        condition = condition & (F.col("type") == file_type)
    if size == "Custom":
        condition = condition & (F.col("length") >= min_bytes)
        if max_bytes is not None:
            condition = condition & (F.col("length") <= max_bytes)
    elif size:
        condition = condition & (formats.size_bucket("length") == size)
    if location:
        condition = condition & (F.upper("location") == location.upper())
    return condition


def filter_members(view: DataFrame, **conditions) -> DataFrame:
    return view.filter(member_filter(**conditions))


def visible_groups(groups: DataFrame, visible_members: DataFrame) -> DataFrame:
    """Groups with a visible member; their sizes and totals stay those of the whole group."""
    return groups.join(visible_members.select("group_id").distinct(), "group_id", "left_semi")


def only_selected_groups(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Groups with a selected member."""
    return visible_groups(groups, members.filter("selected"))


def group_order(by: str = "reclaimable", descending: bool = True) -> list[Column]:
    """The order of a sort option; equal groups by their first path, ascending."""
    key = SORTS[by]()
    return [key.desc() if descending else key.asc(), F.upper("first_path"), F.col("first_path")]


def sort_groups(groups: DataFrame, by: str = "reclaimable", descending: bool = True, top: int | None = None) -> DataFrame:
    """Groups in order. With `top`, only the first rows are kept and moved."""
    ordered = groups.orderBy(*group_order(by, descending))
    return ordered if top is None else ordered.limit(top)


def locations(members: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Distinct locations to filter by: the scanned roots, or the path roots of the members."""
    source = (
        roots.select("root") if roots is not None else members.select(paths.path_root("path").alias("root"))
    )
    return (
        source.filter(F.trim("root") != "")
        .groupBy(F.upper("root").alias("_key"))
        .agg(F.min("root").alias("location"))
        .select("location")
    )


def result_summary(groups: DataFrame, *skipped: DataFrame) -> DataFrame:
    """One row: groups, members, reclaimable bytes, skipped items of all stages."""
    totals = groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("members"), F.lit(0)).alias("members"),
        F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable"),
    ).withColumn("skipped", F.lit(0).cast("long"))
    parts = [totals]
    for rejects in skipped:
        zero = F.lit(0).cast("long")
        parts.append(
            rejects.agg(F.count(F.lit(1)).alias("skipped")).select(
                zero.alias("groups"), zero.alias("members"), zero.alias("reclaimable"), "skipped"
            )
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.agg(*[F.sum(name).alias(name) for name in totals.columns])


def selection_summary(members: DataFrame, per_group: bool = False) -> DataFrame:
    """Selected count and bytes, in total or for each group."""
    totals = [
        F.count_if("selected").alias("selected"),
        F.coalesce(F.sum(F.when(F.col("selected"), F.col("length"))), F.lit(0)).alias("selected_bytes"),
    ]
    return members.groupBy("group_id").agg(*totals) if per_group else members.agg(*totals)

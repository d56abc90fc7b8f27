"""Queries on review, selection and reports of exact duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duploscope.functions import ranking
from duploscope.operators import exact, review, selection
from duploscope.plans import bindings
from duploscope.plans.registry import FORMAT_BYTES, GROUPS, ISO, REVIEW_TYPE, query
from duploscope.plans.scanning import exact_result
from duploscope.sources import reports

ROOTS = tuple(f"/src{n}" for n in range(20))
VISIBLE = {"search": "doc-", "file_type": "Photos", "size": "Custom", "min_bytes": 100, "max_bytes": 9_000}
VISIBLE_SQL = "contains(upper(path), 'DOC-') AND lower(extension) = '.jpg' AND length BETWEEN 100 AND 9000"


def reviewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups, members with nothing selected, and the items that were skipped."""
    found = exact_result(spark, sf_dir)
    view = review.members_view(found.members, found.groups, ROOTS)
    return found.groups, selection.clear_selection(view), found.skipped


@query("review_members", GROUPS + f"""
SELECT group_id, item_id, {REVIEW_TYPE.format('extension')} AS type, root AS location, root || '/' || lang AS folder,
       regexp_extract(first_path, '[^/]*$') AS display_name FROM mem""")
def review_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviewed(spark, sf_dir)[1].select("group_id", "item_id", "type", "location", "folder", "display_name")


@query("filtered_members", GROUPS + f"SELECT group_id, item_id FROM mem WHERE {VISIBLE_SQL} AND root <> '/src1'")
def filtered_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = reviewed(spark, sf_dir)[1]
    inside = review.filter_members(view, **VISIBLE)
    return inside.filter(~review.member_filter(location="/SRC1")).select("group_id", "item_id")


@query("review_filtered_groups", GROUPS + f"""
SELECT group_id, members, reclaimable FROM grps WHERE group_id IN (SELECT group_id FROM mem WHERE {VISIBLE_SQL})""")
def review_filtered_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, view, _ = reviewed(spark, sf_dir)
    return review.visible_groups(groups, review.filter_members(view, **VISIBLE)).select("group_id", "members", "reclaimable")


@query("size_class_groups", GROUPS + """
SELECT group_id FROM grps WHERE group_id IN (SELECT group_id FROM mem WHERE length < 1048576 AND root = '/src3')""")
def size_class_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, view, _ = reviewed(spark, sf_dir)
    return review.visible_groups(groups, review.filter_members(view, size="LessThan1Mb", location="/src3")).select("group_id")


def _placed_sql(order: str) -> str:
    return GROUPS + f"""
SELECT row_number() OVER (ORDER BY {order}, upper(first_path), first_path) AS place, group_id, reclaimable FROM grps"""


def _placed(spark: SparkSession, sf_dir: str, by: str, descending: bool) -> DataFrame:
    groups = exact_result(spark, sf_dir).groups
    placed = ranking.global_rank(groups, review.group_order(by, descending), "place")
    return placed.select((F.col("place") + 1).alias("place"), "group_id", "reclaimable")


@query("review_sorted_topk", _placed_sql("reclaimable DESC"))
def review_sorted_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir, "reclaimable", True)


@query("sorted_by_size", _placed_sql("length"))
def sorted_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir, "file_size", False)


@query("sorted_by_copies", _placed_sql("members DESC"))
def sorted_by_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir, "copy_count", True)


@query("sorted_by_name", _placed_sql("upper(regexp_extract(first_path, '[^/]*$'))"))
def sorted_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir, "name", False)


@query("sorted_by_path", _placed_sql("upper(first_path) DESC"))
def sorted_by_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir, "path", True)


@query("sorted_by_modified", _placed_sql("first_modified_at DESC"))
def sorted_by_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir, "modified", True)


@query("review_locations", r"SELECT DISTINCT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS location FROM pages")
def review_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.locations(bindings.page_items(spark, sf_dir))


@query("result_summary", GROUPS + """
SELECT count(*) AS groups, CAST(coalesce(sum(members), 0) AS BIGINT) AS members, CAST(coalesce(sum(reclaimable), 0) AS BIGINT) AS reclaimable,
       (SELECT count(*) FROM docs WHERE hidden) AS skipped FROM grps""")
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _, skipped = reviewed(spark, sf_dir)
    hidden = bindings.docs(spark, sf_dir, with_labels=True).filter(F.array_contains("attributes", "Hidden"))
    return review.result_summary(groups, skipped, hidden)


ORDER_SQL = "modified_at, upper(path), doc_id"
NEWEST = GROUPS + f""",
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY {ORDER_SQL}) AS age,
                  count(*) OVER (PARTITION BY group_id) AS n FROM mem),
newest AS (SELECT * FROM ranked WHERE age < n)
"""


@query("keep_newest", NEWEST + "SELECT group_id, item_id FROM newest")
def keep_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.propose(reviewed(spark, sf_dir)[1], "keep_newest").select("group_id", "item_id")


@query("keep_oldest", NEWEST + "SELECT group_id, item_id FROM ranked WHERE age > 1")
def keep_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.propose(reviewed(spark, sf_dir)[1], "keep_oldest").select("group_id", "item_id")


PREFERRED = GROUPS + f""",
kept AS (SELECT group_id, arg_min(item_id, (modified_at, upper(path), doc_id)) AS keeper_id FROM mem WHERE root = '/src1' GROUP BY group_id)
SELECT group_id, item_id FROM mem JOIN kept USING (group_id) WHERE item_id <> keeper_id"""


@query("prefer_location", PREFERRED)
def prefer_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.propose(reviewed(spark, sf_dir)[1], "prefer_location", "/src1").select("group_id", "item_id")


@query("select_outside_location", PREFERRED)
def select_outside_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.propose(reviewed(spark, sf_dir)[1], "select_outside_location", "/SRC1").select("group_id", "item_id")


@query("proposal_summary", NEWEST + f"""
SELECT 'all' AS scope, count(*) AS proposed, CAST(coalesce(sum(length), 0) AS BIGINT) AS proposed_bytes, count(DISTINCT group_id) AS affected_groups FROM newest
UNION ALL SELECT 'visible', count(*), CAST(coalesce(sum(length), 0) AS BIGINT), count(DISTINCT group_id) FROM newest
WHERE group_id IN (SELECT group_id FROM mem WHERE {VISIBLE_SQL})""")
def proposal_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, view, _ = reviewed(spark, sf_dir)
    visible = review.visible_groups(groups, review.filter_members(view, **VISIBLE))
    summary = lambda scope, name: selection.proposal_summary(selection.propose(view, "keep_newest", scope=scope)).withColumn("scope", F.lit(name))
    return summary(None, "all").unionByName(summary(visible, "visible"))


def _start(view: DataFrame) -> DataFrame:
    """Some members selected beforehand: those of groups whose size is a multiple of three bytes, but the first."""
    return view.withColumn("selected", (F.col("length") % 3 == 0) & (F.col("item_id") != F.col("group_id")))


START_SQL = "(length % 3 = 0 AND item_id <> group_id)"


@query("applied_selection", NEWEST + f"""
SELECT item_id, CASE WHEN group_id IN (SELECT group_id FROM mem WHERE {VISIBLE_SQL}) THEN age < n ELSE {START_SQL} END AS applied,
       {START_SQL} AS undone FROM ranked""")
def applied_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, view, _ = reviewed(spark, sf_dir)
    visible = review.visible_groups(groups, review.filter_members(view, **VISIBLE))
    before = _start(view)
    applied = selection.apply_proposal(before, selection.propose(before, "keep_newest", scope=visible))
    undone = selection.undo(applied.members, applied.previous).select("item_id", F.col("selected").alias("undone"))
    return applied.members.select("item_id", F.col("selected").alias("applied")).join(undone, "item_id")


@query("guarded_selection", GROUPS + f""",
asked AS (SELECT *, doc_id % 4 <> 1 AS requested, {START_SQL} AS selected, (doc_id * 7) % 1000 AS request_no FROM mem),
counted AS (SELECT *, row_number() OVER (PARTITION BY group_id, requested AND NOT selected ORDER BY request_no, item_id) AS turn,
                   count(*) FILTER (NOT selected) OVER (PARTITION BY group_id) AS free FROM asked)
SELECT item_id, selected OR (requested AND turn < free) AS selected, NOT selected AND requested AND turn >= free AS refused FROM counted""")
def guarded_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _start(reviewed(spark, sf_dir)[1])
    doc = F.col("identity.id_low")
    requests = before.filter(doc % 4 != 1).select("item_id", ((doc * 7) % 1000).alias("request_no"))
    guarded = selection.guard_survivor(before, requests)
    refused = guarded.refused.select("item_id", F.lit(True).alias("refused"))
    return guarded.members.join(refused, "item_id", "left").select(
        "item_id", "selected", F.coalesce("refused", F.lit(False)).alias("refused")
    )


@query("selection_totals", GROUPS + f"""
SELECT group_id, count(*) FILTER ({START_SQL}) AS selected, CAST(coalesce(sum(length) FILTER ({START_SQL}), 0) AS BIGINT) AS selected_bytes
FROM mem GROUP BY group_id
UNION ALL SELECT -1, count(*) FILTER ({START_SQL}), CAST(coalesce(sum(length) FILTER ({START_SQL}), 0) AS BIGINT) FROM mem""")
def selection_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _start(reviewed(spark, sf_dir)[1])
    total = review.selection_summary(members).withColumn("group_id", F.lit(-1).cast("long"))
    return review.selection_summary(members, per_group=True).unionByName(total)


@query("selected_groups", GROUPS + f"SELECT group_id, members FROM grps WHERE group_id IN (SELECT group_id FROM mem WHERE {START_SQL})")
def selected_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, view, _ = reviewed(spark, sf_dir)
    return review.only_selected_groups(groups, _start(view)).select("group_id", "members")


def _report_sql(condition: str) -> str:
    return GROUPS + f""",
report AS (SELECT g.group_index + 1 AS "Group", m.file_name AS "Filename", m.path AS "Full path", m.length AS "Size bytes",
       {FORMAT_BYTES.format('m.length')} AS "Formatted size", {ISO.format('m.modified_at')} AS "Modified",
       m.extension AS "Extension", {REVIEW_TYPE.format('m.extension')} AS "Type",
       CASE WHEN m.length % 3 = 0 AND m.item_id <> m.group_id THEN 'Yes' ELSE 'No' END AS "Selected candidate"
FROM mem m JOIN indexed g USING (group_id) WHERE {condition})
"""


@query("report_rows", _report_sql("true") + "SELECT * FROM report")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, view, _ = reviewed(spark, sf_dir)
    return reports.duplicate_report_rows(_start(view), exact.with_group_index(groups))


SCOPED = VISIBLE_SQL.replace("path", "m.path").replace("extension", "m.extension").replace("length", "m.length")


@query("report_rows_filtered", _report_sql(SCOPED) + "SELECT * FROM report")
def report_rows_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, view, _ = reviewed(spark, sf_dir)
    visible = review.filter_members(view, **VISIBLE)
    return reports.duplicate_report_rows(_start(view), exact.with_group_index(groups), visible)


@query("report_text", _report_sql("true") + """
SELECT "Group", "Full path" AS path, CAST(i - 1 AS BIGINT) AS line_no, lines[i] AS line
FROM (SELECT "Group", "Full path", unnest(range(1, 6)) AS i,
        ['Group ' || "Group" || ': ' || "Filename", '  Path: ' || "Full path", '  Size: ' || "Size bytes" || ' bytes (' || "Formatted size" || ')',
         '  Modified: ' || "Modified", '  Type: ' || "Type" || '; selected candidate: ' || "Selected candidate"] AS lines FROM report)""")
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = reports.duplicate_report_text(report_rows(spark, sf_dir))
    return lines.withColumn("line_no", F.col("line_no").cast("long"))


@query("report_summary", GROUPS + f"""
SELECT 'Current filtered results' AS scope, (SELECT count(*) FROM vis) AS groups, (SELECT CAST(coalesce(sum(reclaimable), 0) AS BIGINT) FROM vis) AS reclaimable,
       (SELECT count(*) FROM mem WHERE {VISIBLE_SQL}) AS members, count(*) FILTER ({START_SQL}) AS selected,
       CAST(coalesce(sum(length) FILTER ({START_SQL}), 0) AS BIGINT) AS selected_bytes
FROM mem""".replace("SELECT 'Current", ", vis AS (SELECT * FROM grps WHERE group_id IN (SELECT group_id FROM mem WHERE " + VISIBLE_SQL + "))\nSELECT 'Current"))
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, view, _ = reviewed(spark, sf_dir)
    inside = review.filter_members(view, **VISIBLE)
    return reports.duplicate_report_summary(
        review.visible_groups(groups, inside), inside, _start(view), "Current filtered results"
    )

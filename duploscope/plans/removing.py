"""Queries on removal plans, revalidation and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duploscope.functions import formats
from duploscope.operators import exact, removal, selection
from duploscope.plans import bindings
from duploscope.plans.registry import GROUPS, query
from duploscope.plans.reviewing import NEWEST, reviewed
from duploscope.plans.scanning import MIRROR_RIGHT, same_identities
from duploscope.session import materialize


def _newest_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Groups, members and the identities proposed by keep-newest in a scope: the groups of an even length."""
    groups, view, _ = reviewed(spark, sf_dir)
    chosen = selection.propose(view, "keep_newest", scope=groups.filter("length % 2 = 0")).select("identity")
    return groups, view, chosen


PLAN = NEWEST + """,
plan AS (SELECT *, CASE WHEN age < n THEN 'candidate' ELSE 'keeper' END AS role FROM ranked WHERE length % 2 = 0)
"""


@query("plan_roles", PLAN + "SELECT group_id, item_id, role FROM plan")
def plan_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members, chosen = _newest_plan(spark, sf_dir)
    return removal.build_plan(members, chosen).select("group_id", "item_id", "role")


@query("plan_review", PLAN + """
SELECT group_index + 1 AS group_number, path, p.length FROM plan p JOIN indexed USING (group_id) WHERE role = 'candidate'""")
def plan_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, members, chosen = _newest_plan(spark, sf_dir)
    return removal.plan_review(removal.build_plan(members, chosen), exact.with_group_index(groups))


@query("plan_totals", PLAN + """
SELECT count(*) AS candidates, CAST(coalesce(sum(length), 0) AS BIGINT) AS candidate_bytes, count(DISTINCT group_id) AS affected_groups
FROM plan WHERE role = 'candidate'""")
def plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, members, chosen = _newest_plan(spark, sf_dir)
    return removal.plan_totals(removal.build_plan(members, chosen))


@query("plan_issues", GROUPS + """,
spoiled AS (SELECT *, CASE WHEN doc_id % 9 = 0 THEN '//' || substr(path, 2) ELSE path END AS new_path FROM mem),
doubled AS (SELECT * FROM mem WHERE doc_id % 10 = 0)
SELECT 'InvalidVerifiedGroup' AS reason, new_path AS path FROM spoiled WHERE doc_id % 8 = 0 OR doc_id % 9 = 0
UNION ALL SELECT 'UnsupportedPath', new_path FROM spoiled WHERE doc_id % 9 = 0
UNION ALL SELECT 'SnapshotArithmeticMismatch', NULL FROM grps WHERE group_id % 5 = 0
UNION ALL SELECT 'SnapshotArithmeticMismatch', NULL FROM (SELECT 1 FROM grps HAVING sum(CASE WHEN group_id % 5 = 0 THEN 1 ELSE 0 END) > 0)
UNION ALL SELECT 'UnknownSelectedIdentity', NULL FROM documents d WHERE doc_id % 50 = 7 AND doc_id NOT IN (SELECT doc_id FROM mem)""")
def plan_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result spoiled in several ways: hidden members, network paths, wrong sums, unknown selections."""
    found = exact.find_exact_duplicates(bindings.docs(spark, sf_dir), bindings.docs_content(spark, sf_dir))
    doc = F.col("identity.id_low")
    members = found.members.withColumns(
        {
            "path": F.when(doc % 9 == 0, F.concat(F.lit("/"), "path")).otherwise(F.col("path")),
            "attributes": F.when(doc % 8 == 0, F.array(F.lit("Hidden"))).otherwise(F.col("attributes")),
        }
    )
    groups = found.groups.withColumn(
        "reclaimable", F.col("reclaimable") + F.when(F.col("group_id") % 5 == 0, 1).otherwise(0)
    )
    inventory = bindings.docs(spark, sf_dir)
    chosen = inventory.filter(doc % 50 == 7).select("identity").distinct()
    return removal.plan_issues(groups, members, chosen, inventory, exact.total_reclaimable(found.groups))


@query("plan_edge_issues", GROUPS + """,
turned AS (SELECT *, CAST(group_id // 2 AS BIGINT) % 6 AS turn FROM grps WHERE length > 0)
SELECT 'InvalidVerifiedGroup' AS reason, CAST(NULL AS VARCHAR) AS path FROM turned WHERE turn < 4
UNION ALL SELECT 'SnapshotArithmeticMismatch', NULL FROM turned WHERE turn = 1
UNION ALL SELECT 'SnapshotArithmeticMismatch', NULL FROM (SELECT 1 FROM mem JOIN turned USING (group_id) WHERE turn = 5 HAVING count(*) > 1)""")
def plan_edge_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups at the edges: negative lengths, a first member of another length, a single member, none, no times, and
    selected bytes beyond 64 bits."""
    groups, members, _ = reviewed(spark, sf_dir)
    groups, members = groups.filter("length > 0"), members.filter("length > 0")
    turn = F.floor(F.col("group_id") / 2) % 6
    huge = F.lit(1 << 62).cast("long")

    def length(own: Column) -> Column:
        odd_first = (turn == 1) & (F.col("item_id") == F.col("group_id"))
        return F.when(turn == 0, -own).when(odd_first, own + 1).when(turn == 5, huge).otherwise(own)

    changed = members.withColumns(
        {"length": length(F.col("length")), "modified_at": F.when(turn != 4, F.col("modified_at"))}
    )
    left = changed.filter((turn != 3) & ((turn != 2) | (F.col("item_id") == F.col("group_id"))))
    stored = F.when(turn == 0, -F.col("reclaimable")).when(turn == 5, F.try_multiply(F.col("members") - 1, huge))
    groups = groups.withColumn("reclaimable", F.coalesce(stored, F.when(turn != 5, F.col("reclaimable"))))
    chosen = left.filter((turn == 5)).select("identity")
    return removal.plan_issues(groups, left, chosen, changed)


@query("plan_duplicates", GROUPS + """,
again AS (SELECT doc_id, path, upper(first_path) AS g, upper(path) AS p FROM mem
          UNION ALL SELECT doc_id, upper(path), upper(first_path), upper(path) FROM mem WHERE doc_id % 3 = 0)
SELECT reason, path FROM (
  SELECT 'DuplicatePhysicalIdentity' AS reason, path, row_number() OVER (PARTITION BY doc_id ORDER BY g, p, path) AS turn FROM again
  UNION ALL SELECT 'DuplicatePath', path, row_number() OVER (PARTITION BY p ORDER BY g, p, path) FROM again) WHERE turn > 1""")
def plan_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members listed a second time in capitals: every occurrence after the first is reported."""
    groups, members, _ = reviewed(spark, sf_dir)
    again = members.filter(F.col("identity.id_low") % 3 == 0).withColumn("path", F.upper("path"))
    doubled = members.unionByName(again)
    return removal.duplicate_identities(doubled, groups).unionByName(removal.duplicate_paths(doubled, groups))


@query("plan_all_selected", GROUPS + """
SELECT 'AllMembersSelected' AS reason, CAST(NULL AS VARCHAR) AS path FROM grps
WHERE group_id IN (SELECT group_id FROM mem GROUP BY group_id HAVING bool_and(length % 3 <> 0))""")
def plan_all_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clean result of which some groups are selected whole."""
    groups, members, _ = reviewed(spark, sf_dir)
    chosen = members.filter("length % 3 <> 0").select("identity")
    return removal.plan_issues(groups, members, chosen, bindings.docs(spark, sf_dir), exact.total_reclaimable(groups))


@query("plan_check", PLAN + """
, kept AS (SELECT * FROM plan WHERE NOT (doc_id % 10 = 0)),
roles AS (SELECT group_id, count(*) FILTER (role = 'candidate') AS c, count(*) FILTER (role = 'keeper') AS k FROM kept GROUP BY group_id)
SELECT 'NoSurvivorOrCandidate' AS problem, group_id FROM roles WHERE c = 0 OR k = 0
UNION ALL SELECT DISTINCT 'GroupMemberMissing', group_id FROM plan WHERE doc_id % 10 = 0 AND group_id IN (SELECT group_id FROM kept)
UNION ALL SELECT DISTINCT 'MemberNotInGroup', group_id FROM kept WHERE doc_id % 6 = 1
UNION ALL SELECT DISTINCT 'GroupMemberMissing', group_id FROM kept WHERE doc_id % 6 = 1
  AND group_id NOT IN (SELECT group_id FROM plan WHERE doc_id % 10 = 0)""")
def plan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan that lost some members and holds others in a changed state."""
    _, members, chosen = _newest_plan(spark, sf_dir)
    doc = F.col("identity.id_low")
    tampered = removal.build_plan(members, chosen).filter(doc % 10 != 0)
    tampered = tampered.withColumn("length", F.col("length") + F.when(doc % 6 == 1, 1).otherwise(0))
    return removal.check_plan(tampered, members)


def _mirror_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A keep-oldest plan over /a, and a later state of it: the /b side under the same names."""
    before, after = bindings.mirror(spark, sf_dir)
    content = bindings.mirror_content(spark, sf_dir)
    found = exact.find_exact_duplicates(before, content)
    chosen = selection.propose(found.members, "keep_oldest").select("identity")
    plan = materialize(removal.build_plan(found.members, chosen))
    doc = F.floor(F.col("identity.id_low") / 4)
    fresh = exact.verify_content(after, content)
    fresh = same_identities(
        fresh.withColumns(
            {
                "link_count": F.when(doc % 23 == 0, 2).otherwise(1),
                "attributes": F.when(doc % 19 == 0, F.array(F.lit("System"))).otherwise(F.col("attributes")),
            }
        )
    )
    return plan, fresh.withColumn("path", F.concat(F.lit("/a/"), F.expr("substring(path, 4)")))


MIRROR_PLAN = MIRROR_RIGHT + """,
left_side AS (SELECT doc_id AS item_id, doc_id, text, strlen(text) AS length, (doc_id * 37) % 1000 AS hour,
    '/a/' || source || '/' || lang || '/doc-' || doc_id || '.' || (['txt', 'JPG', 'mp3', 'mkv', 'zip', 'blend'])[doc_id % 6 + 1] AS path FROM documents),
grps AS (SELECT text, arg_min(item_id, upper(path)) AS group_id FROM left_side GROUP BY text HAVING count(*) > 1),
plan AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY group_id ORDER BY hour, upper(path), doc_id) = 1 THEN 'keeper' ELSE 'candidate' END AS role
         FROM left_side JOIN grps USING (text)),
now AS (SELECT * FROM right_side WHERE place = 0),
checked AS (SELECT p.*, {links} AS status
            FROM plan p LEFT JOIN now n ON n.doc_id = p.doc_id),
keepers AS (SELECT group_id, count(*) FILTER (role <> 'candidate' AND status = 'Valid') AS valid FROM checked GROUP BY group_id),
outcomes AS (SELECT c.*, k.valid, CASE WHEN k.valid = 0 THEN '{none}' ELSE CASE c.status WHEN 'Missing' THEN 'SkippedMissing'
        WHEN 'Changed' THEN 'SkippedChanged' WHEN 'PolicyRejected' THEN 'SkippedPolicy' WHEN 'AmbiguousHardLinks' THEN 'SkippedAmbiguousHardLinks' ELSE 'Recycled' END END AS outcome
        FROM checked c JOIN keepers k USING (group_id) WHERE c.role = 'candidate')
"""
STATUS_SQL = """CASE WHEN n.doc_id IS NULL THEN 'Missing' WHEN n.doc_id % 19 = 0 THEN 'PolicyRejected'
   WHEN n.doc_id % 23 = 0 AND {who} THEN '{links}' WHEN n.changed THEN 'Changed' ELSE 'Valid' END"""
EXACT_RUN = MIRROR_PLAN.format(
    links=STATUS_SQL.format(who="p.role = 'candidate'", links="PolicyRejected"), none="SkippedKeeperUnavailable"
)
SIMILAR_RUN = MIRROR_PLAN.format(
    links=STATUS_SQL.format(who="true", links="AmbiguousHardLinks"), none="SkippedSurvivorUnavailable"
)


@query("revalidation_status", EXACT_RUN + "SELECT group_id, item_id, role, status FROM checked")
def revalidation_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, fresh = _mirror_plan(spark, sf_dir)
    return removal.revalidate(plan, fresh).select("group_id", "item_id", "role", "status")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, fresh = _mirror_plan(spark, sf_dir)
    return removal.candidate_outcomes(removal.revalidate(plan, fresh))


@query("candidate_outcomes", EXACT_RUN + """
SELECT item_id, outcome, valid AS valid_survivors, CASE outcome WHEN 'Recycled' THEN 'CleanupOutcomeMoved' WHEN 'SkippedMissing' THEN 'CleanupOutcomeMissing'
   WHEN 'SkippedChanged' THEN 'CleanupOutcomeChanged' WHEN 'SkippedPolicy' THEN 'CleanupOutcomePolicy' ELSE 'CleanupOutcomeKeeper' END AS message_key,
   CASE outcome WHEN 'Recycled' THEN 'Success' ELSE 'Skipped' END AS tone
FROM outcomes""")
def candidate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = _outcomes(spark, sf_dir).withColumn("_label", formats.outcome_category("outcome"))
    return labelled.select("item_id", "outcome", "valid_survivors", "_label.message_key", "_label.tone")


ROLLUP = """
SELECT group_id, count(*) AS requested, count(*) FILTER (outcome = 'Recycled') AS removed, count(*) FILTER (outcome <> 'Recycled') AS skipped,
       CAST(0 AS BIGINT) AS failed, max(valid) AS survivors, CAST(coalesce(sum(length) FILTER (outcome = 'Recycled'), 0) AS BIGINT) AS reclaimed
FROM outcomes GROUP BY group_id"""
TOTALS = """
SELECT count(*) AS requested, count(*) FILTER (outcome = 'Recycled') AS removed, count(*) FILTER (outcome <> 'Recycled') AS skipped,
       CAST(0 AS BIGINT) AS failed, CAST(coalesce(sum(length) FILTER (outcome = 'Recycled'), 0) AS BIGINT) AS reclaimed FROM outcomes"""


@query("cleanup_rollup", EXACT_RUN + ROLLUP)
def cleanup_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal.group_results(_outcomes(spark, sf_dir))


@query("cleanup_totals", EXACT_RUN + TOTALS)
def cleanup_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal.cleanup_result(removal.group_results(_outcomes(spark, sf_dir)))


@query("survivors", EXACT_RUN + """
SELECT item_id, path FROM left_side WHERE item_id NOT IN (SELECT item_id FROM outcomes WHERE outcome = 'Recycled')""")
def survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, _ = bindings.mirror(spark, sf_dir)
    return removal.surviving_items(before, _outcomes(spark, sf_dir)).select("item_id", "path")


def _tiered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Exact groups in the shape of similar groups: a representative and a tier by number of copies."""
    groups, members, _ = reviewed(spark, sf_dir)
    tier = F.when(F.col("members") >= 3, F.lit("VerySimilar")).otherwise(F.lit("Similar"))
    return groups.withColumns({"representative_id": F.col("group_id"), "tier": tier}), members


def _marks(members: DataFrame) -> DataFrame:
    """Marked: in groups of an odd length, all but the representative."""
    return members.filter("length % 2 = 1 and item_id <> group_id").select("identity")


SIMILAR_PLAN = GROUPS + """,
plan AS (SELECT m.*, CASE WHEN g.members >= 3 THEN 'VerySimilar' ELSE 'Similar' END AS tier,
                CASE WHEN m.item_id = m.group_id THEN 'survivor' ELSE 'candidate' END AS role
         FROM mem m JOIN grps g USING (group_id) WHERE m.length % 2 = 1)
"""


@query("similar_plan_roles", SIMILAR_PLAN + "SELECT group_id, item_id, role, tier FROM plan")
def similar_plan_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, members = _tiered(spark, sf_dir)
    return removal.build_similar_plan(groups, members, _marks(members)).select("group_id", "item_id", "role", "tier")


@query("similar_plan_issues", GROUPS + """
SELECT 'DuplicateCandidateIntent' AS reason, CAST(NULL AS VARCHAR) AS path FROM (SELECT 1 FROM mem WHERE length % 2 = 1 AND item_id <> group_id AND doc_id % 4 = 0 LIMIT 1)
UNION ALL SELECT 'InvalidGroup', NULL FROM grps WHERE group_id % 7 = 0
UNION ALL SELECT 'InvalidGroup', path FROM mem WHERE group_id % 7 <> 0 AND doc_id % 8 = 0
UNION ALL SELECT 'UnknownCandidate', NULL FROM mem WHERE length % 2 = 1 AND item_id <> group_id AND group_id % 7 = 0
UNION ALL SELECT 'UnknownCandidate', NULL FROM mem WHERE length % 2 = 1 AND item_id <> group_id AND group_id % 7 = 0 AND doc_id % 4 = 0""")
def similar_plan_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks given twice, groups without their representative, hidden members."""
    groups, members = _tiered(spark, sf_dir)
    doc = F.col("identity.id_low")
    marks = _marks(members)
    twice = marks.unionByName(marks.filter(doc % 4 == 0))
    lost = groups.withColumn(
        "representative_id", F.when(F.col("group_id") % 7 == 0, F.lit(-1)).otherwise(F.col("representative_id"))
    )
    hidden = members.withColumn("attributes", F.when(doc % 8 == 0, F.array(F.lit("Hidden"))).otherwise(F.col("attributes")))
    return removal.similar_plan_issues(lost, hidden, twice)


@query("similar_plan_check", SIMILAR_PLAN + """
SELECT DISTINCT 'TierMismatch' AS problem, group_id FROM plan WHERE group_id % 6 = 0
UNION ALL SELECT 'TotalsMismatch', NULL FROM (SELECT count(*) AS n FROM plan) WHERE n > 0""")
def similar_plan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan with some wrong tiers, and stored totals that are one byte off."""
    groups, members = _tiered(spark, sf_dir)
    plan = removal.build_similar_plan(groups, members, _marks(members))
    stored = removal.plan_totals(plan).withColumn("candidate_bytes", F.col("candidate_bytes") + 1)
    wrong = plan.withColumn("tier", F.when(F.col("group_id") % 6 == 0, F.lit("LooselySimilar")).otherwise(F.col("tier")))
    return removal.check_similar_plan(wrong, groups, members, stored)


@query("similar_outcomes", SIMILAR_RUN + "SELECT item_id, outcome, valid AS valid_survivors FROM outcomes")
def similar_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _similar_run(spark, sf_dir).select("item_id", "outcome", "valid_survivors")


@query("similar_result", SIMILAR_RUN + TOTALS)
def similar_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal.cleanup_result(removal.group_results(_similar_run(spark, sf_dir)))


def _similar_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan, fresh = _mirror_plan(spark, sf_dir)
    plan = plan.withColumn("role", F.when(F.col("role") == "keeper", F.lit("survivor")).otherwise(F.col("role")))
    return removal.similar_outcomes(removal.revalidate_similar(plan, fresh))


@query("similar_review_summary", SIMILAR_PLAN + """
SELECT count(DISTINCT group_id) AS affected_groups, count(*) FILTER (role = 'candidate') AS removing, count(*) FILTER (role = 'survivor') AS remaining,
       CAST(coalesce(sum(length) FILTER (role = 'candidate'), 0) AS BIGINT) AS selected_bytes,
       count(DISTINCT root || '/' || lang) FILTER (role = 'candidate') AS folders FROM plan""")
def similar_review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, members = _tiered(spark, sf_dir)
    return removal.similar_review_summary(removal.build_similar_plan(groups, members, _marks(members)))

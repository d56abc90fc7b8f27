"""Removal plans: checks before, revalidation against a fresh inventory, and the account of outcomes.

Any issue means no plan. Every group of a plan keeps at least one survivor. Nothing here deletes; the
result of a run is the table of items that remain.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duploscope.functions import paths
from duploscope.operators.exact import path_order
from duploscope.session import materialize

# Attributes that rule an item out, and what a failed revalidation of a candidate becomes.
UNSAFE_ATTRIBUTES = ("Directory", "ReparsePoint", "Device", "Offline", "System", "Hidden", "Encrypted", "RecallOnOpen",
                     "RecallOnDataAccess")
CANDIDATE_OUTCOMES = {
    "Missing": "SkippedMissing",
    "IdentityMismatch": "SkippedIdentityMismatch",
    "Changed": "SkippedChanged",
    "PolicyRejected": "SkippedPolicy",
    "Unavailable": "SkippedVerificationFailed",
}
SIMILAR_OUTCOMES = {
    "Missing": "SkippedMissing",
    "IdentityMismatch": "SkippedIdentityMismatch",
    "Changed": "SkippedChanged",
    "PolicyRejected": "SkippedPolicy",
    "AmbiguousHardLinks": "SkippedAmbiguousHardLinks",
    "Unavailable": "FailedPlatform",
}
REMOVED = "Recycled"
FAILED = ("FailedRecycleBin", "FailedPlatform")

SNAPSHOT = ("path", "file_name", "extension", "length", "modified_at", "changed_at", "identity", "attributes")


def supported_path(path: Column | str = "path") -> Column:
    """Absolute, on no network share, and written without empty, `.` or `..` segments."""
    path = F.col(path) if isinstance(path, str) else path
    absolute = path.rlike(r"^([A-Za-z]:[/\\]|/(?!/))")
    odd = path.rlike(r"[/\\](\.{1,2})?[/\\]|[/\\]\.{1,2}$")
    return F.coalesce((F.trim(path) != "") & absolute & ~odd, F.lit(False))


def unsafe_attributes(attributes: Column | str = "attributes") -> Column:
    attributes = F.col(attributes) if isinstance(attributes, str) else attributes
    return F.arrays_overlap(attributes, F.array(*[F.lit(name) for name in UNSAFE_ATTRIBUTES]))


def _no_identity() -> Column:
    return F.col("identity").isNull() | (
        (F.col("identity.volume") == 0) & (F.col("identity.id_low") == 0) & (F.col("identity.id_high") == 0)
    )


def _issue(df: DataFrame, reason: str, path: Column | None = None) -> DataFrame:
    path = F.lit(None).cast("string") if path is None else path
    return df.select(F.lit(reason).alias("reason"), path.alias("path"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def invalid_groups(
    groups: DataFrame, members: DataFrame, reason: str = "InvalidVerifiedGroup", equal_lengths: bool = True
) -> DataFrame:
    """Groups of fewer than two members, also of none, or with a negative length or different lengths."""
    counted = members.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("_n"), F.min("length").alias("_low"), F.max("length").alias("_high")
    )
    checked = counted.join(groups.select("group_id").distinct(), "group_id", "full_outer")
    bad = F.coalesce("_n", F.lit(0)) < 2
    if equal_lengths:
        bad = bad | (F.col("_low") < 0) | (F.col("_low") != F.col("_high"))
    return _issue(checked.filter(bad), reason)


def _without_equal(rows: DataFrame, others: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows that no other row equals in all the columns; a null equals a null."""
    known = others.select(*[F.col(name).alias(f"_known_{name}") for name in names]).distinct()
    equal = [F.col(name).eqNullSafe(F.col(f"_known_{name}")) for name in names]
    return rows.join(known, reduce(Column.__and__, equal), "left_anti")


def overflowing_selection(members: DataFrame, selection: DataFrame) -> DataFrame:
    """One finding if the bytes of the selected members do not fit into 64 bits."""
    chosen = members.join(selection.select("identity").distinct(), "identity", "left_semi")
    total = chosen.agg(F.try_sum("length").alias("_sum"), F.count("length").alias("_n"))
    return _issue(total.filter("_n > 0 AND _sum IS NULL"), "SnapshotArithmeticMismatch")


def invalid_members(
    members: DataFrame, inventory: DataFrame | None, reason: str = "InvalidVerifiedGroup", negative_lengths: bool = False
) -> DataFrame:
    """Members without identity, with a name that is not the end of the path, with an unsafe attribute, or
    that the inventory does not hold in just this state. Each is reported once."""
    wrong = (
        _no_identity()
        | (F.col("file_name") != paths.file_name("path"))
        | unsafe_attributes()
        | (F.lit(negative_lengths) & (F.col("length") < 0))
    )
    bad = members.filter(wrong).select("group_id", "item_id", "path")
    if inventory is not None:
        bad = bad.unionByName(_without_equal(members, inventory, SNAPSHOT).select("group_id", "item_id", "path"))
    return _issue(bad.distinct(), reason, F.col("path"))


def repeated(members: DataFrame, groups: DataFrame, key: Column, reason: str) -> DataFrame:
    """Every occurrence of a key but the first, in the order of groups and paths."""
    order = F.struct(F.upper("first_path"), F.col("first_path"), *path_order(), F.col("item_id"), F.col("group_id"))
    rows = members.join(groups.select("group_id", "first_path"), "group_id", "left").select(
        key.alias("_key"), "path", order.alias("_order")
    )
    firsts = (
        rows.groupBy("_key")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_order").alias("_first"))
        .filter("_n > 1")
        .select("_key", "_first")
    )
    return _issue(rows.join(firsts, "_key").filter("_order > _first"), reason, F.col("path"))


def duplicate_identities(members: DataFrame, groups: DataFrame) -> DataFrame:
    key = F.coalesce(F.concat_ws("/", "identity.volume", "identity.id_low", "identity.id_high"), F.lit(""))
    return repeated(members, groups, key, "DuplicatePhysicalIdentity")


def duplicate_paths(members: DataFrame, groups: DataFrame) -> DataFrame:
    return repeated(members, groups, F.upper("path"), "DuplicatePath")


def unsupported_paths(members: DataFrame) -> DataFrame:
    return _issue(members.filter(~supported_path()), "UnsupportedPath", F.col("path"))


def arithmetic_mismatches(members: DataFrame, groups: DataFrame, total: DataFrame | None = None) -> DataFrame:
    """Groups whose stored reclaimable bytes are not (members - 1) x length, and a stored total that is not their sum.

    An overflow is a finding here, not an error.
    """
    first = F.min_by("length", F.struct(*path_order(), F.col("item_id")))
    counted = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"), first.alias("_length"))
    expected = F.try_multiply(F.col("_n") - 1, F.col("_length"))
    wrong = groups.join(counted, "group_id").filter(F.col("_n") >= 2).filter(~expected.eqNullSafe(F.col("reclaimable")))
    issues = _issue(wrong, "SnapshotArithmeticMismatch")
    if total is None:
        return issues
    several = groups.join(counted.filter("_n >= 2").select("group_id"), "group_id", "left_semi")
    summed = several.agg(F.coalesce(F.try_sum("reclaimable"), F.when(F.count("reclaimable") == 0, 0)).alias("_sum"))
    both = summed.withColumn("_one", F.lit(1)).join(
        total.select(F.col("reclaimable").alias("_stored"), F.lit(1).alias("_one")), "_one"
    )
    return issues.unionByName(
        _issue(both.filter(~F.col("_sum").eqNullSafe(F.col("_stored"))), "SnapshotArithmeticMismatch")
    )


def unknown_selected(members: DataFrame, selection: DataFrame, reason: str = "UnknownSelectedIdentity") -> DataFrame:
    return _issue(selection.join(members.select("identity"), "identity", "left_anti"), reason)


def all_members_selected(
    members: DataFrame, selection: DataFrame, reason: str = "AllMembersSelected"
) -> DataFrame:
    """Groups that would keep no survivor."""
    chosen = members.join(selection.select("identity", F.lit(1).alias("_chosen")).distinct(), "identity", "left")
    counted = chosen.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"), F.count("_chosen").alias("_selected"))
    return _issue(counted.filter("_selected >= _n"), reason)


def plan_issues(
    groups: DataFrame,
    members: DataFrame,
    selection: DataFrame,
    inventory: DataFrame,
    total: DataFrame | None = None,
    complete: bool = True,
) -> DataFrame:
    """(reason, path) of everything that forbids a plan.

    An incomplete scan is the only issue then; groups without survivor are looked for when all else is clean.
    """
    if not complete:
        return _issue(members.sparkSession.range(1), "CancelledScanSnapshot")
    # written, because it is looked at for emptiness and then read
    first = materialize(_union(
        [
            invalid_groups(groups, members),
            invalid_members(members, inventory),
            duplicate_identities(members, groups),
            duplicate_paths(members, groups),
            unsupported_paths(members),
            arithmetic_mismatches(members, groups, total),
            unknown_selected(members, selection),
            overflowing_selection(members, selection),
        ]
    ))
    return all_members_selected(members, selection) if first.isEmpty() else first


def build_plan(members: DataFrame, selection: DataFrame, survivor_role: str = "keeper") -> DataFrame:
    """Members of the groups with at least one selected member, each with its role."""
    chosen = selection.select("identity").distinct().withColumn("_chosen", F.lit(True))
    marked = members.join(chosen, "identity", "left")
    touched = marked.filter("_chosen").select("group_id").distinct()
    return (
        marked.join(touched, "group_id", "left_semi")
        .withColumn("role", F.when(F.col("_chosen"), F.lit("candidate")).otherwise(F.lit(survivor_role)))
        .drop("_chosen")
    )


def plan_review(plan: DataFrame, indexed_groups: DataFrame) -> DataFrame:
    """Candidates in the order of group number and path."""
    numbers = indexed_groups.select("group_id", (F.col("group_index") + 1).alias("group_number"))
    return (
        plan.filter("role = 'candidate'")
        .join(numbers, "group_id")
        .select("group_number", "path", "length")
        .orderBy("group_number", *path_order())
    )


def plan_totals(plan: DataFrame) -> DataFrame:
    """One row: candidates, their bytes, affected groups."""
    per_group = (
        plan.filter("role = 'candidate'")
        .groupBy("group_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    )
    return per_group.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("candidate_bytes"),
        F.count(F.lit(1)).alias("affected_groups"),
    )


def check_plan(plan: DataFrame, members: DataFrame, survivor_role: str = "keeper") -> DataFrame:
    """(problem, group_id) of a plan that does not split its source groups; a sound plan gives no rows."""
    problem = lambda df, name: df.select(F.lit(name).alias("problem"), "group_id")
    roles = plan.groupBy("group_id").agg(
        F.count_if(F.col("role") == "candidate").alias("_candidates"),
        F.count_if(F.col("role") == survivor_role).alias("_survivors"),
        F.count(F.lit(1)).alias("_n"),
    )
    partial = roles.filter("_candidates = 0 or _survivors = 0 or _candidates + _survivors <> _n")
    overlapping = (
        plan.groupBy("identity")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("group_id").alias("group_id"))
        .filter("_n > 1")
    )
    state = ["group_id", *SNAPSHOT]
    unknown = _without_equal(plan, members, state)
    source = members.join(plan.select("group_id").distinct(), "group_id", "left_semi")
    lost = _without_equal(source, plan, state)
    return _union(
        [
            problem(partial, "NoSurvivorOrCandidate"),
            problem(overlapping, "OverlappingIdentity"),
            problem(unknown.select("group_id").distinct(), "MemberNotInGroup"),
            problem(lost.select("group_id").distinct(), "GroupMemberMissing"),
        ]
    )


def _validated(plan: DataFrame, fresh: DataFrame, ambiguous: str, links_of: Column) -> DataFrame:
    names = ("identity", "length", "modified_at", "changed_at", "attributes", "link_count")
    now = fresh.select(
        "path",
        *[F.col(name).alias("now_" + name) for name in names],
        *[F.col(name).alias("now_" + name) for name in ("content_key",) if name in fresh.columns],
        F.lit(True).alias("_present"),
    )
    same = F.lit(True)
    for name in ("length", "modified_at", "changed_at"):
        same = same & F.col(name).eqNullSafe(F.col("now_" + name))
    status = (
        F.when(~supported_path(), F.lit("PolicyRejected"))
        .when(F.col("_present").isNull(), F.lit("Missing"))
        .when(unsafe_attributes("now_attributes"), F.lit("PolicyRejected"))
        .when(links_of & (F.col("now_link_count") != 1), F.lit(ambiguous))
        .when(~F.col("identity").eqNullSafe(F.col("now_identity")), F.lit("IdentityMismatch"))
        .when(~same, F.lit("Changed"))
        .otherwise(F.lit("Valid"))
    )
    return plan.join(now, "path", "left").withColumn("status", status).drop("_present")


def revalidate(plan: DataFrame, fresh: DataFrame) -> DataFrame:
    """The plan with the state of every member in a fresh inventory, as `status`.

    Only candidates must have a single link: a keeper with aliases still survives.
    """
    return _validated(plan, fresh, "PolicyRejected", F.col("role") == "candidate")


def revalidate_similar(plan: DataFrame, fresh: DataFrame) -> DataFrame:
    """As `revalidate`; a second link makes candidates and survivors alike ambiguous."""
    return _validated(plan, fresh, "AmbiguousHardLinks", F.lit(True))


def _first_valid(validated: DataFrame, survivor_role: str) -> DataFrame:
    """Per group: the number of valid survivors and the content of the first by path."""
    content = F.col("now_content_key") if "now_content_key" in validated.columns else F.lit(None).cast("string")
    order = F.struct(*path_order(), F.col("item_id"))
    return (
        validated.filter((F.col("role") == survivor_role) & (F.col("status") == "Valid"))
        .groupBy("group_id")
        .agg(
            F.count(F.lit(1)).alias("valid_survivors"),
            F.min_by(F.struct(F.col("length").alias("length"), content.alias("content_key")), order).alias("_keeper"),
        )
    )


def candidate_outcomes(validated: DataFrame) -> DataFrame:
    """What happens to each candidate: removed only next to a valid keeper of equal content.

    `revalidate` ran against an inventory with a proved `content_key`.
    """
    keepers = _first_valid(validated, "keeper")
    equal = (F.col("length") == F.col("_keeper.length")) & (F.col("now_content_key") == F.col("_keeper.content_key"))
    outcome = F.when(F.col("_keeper").isNull(), F.lit("SkippedKeeperUnavailable"))
    for status, result in CANDIDATE_OUTCOMES.items():
        outcome = outcome.when(F.col("status") == status, F.lit(result))
    outcome = outcome.when(~F.coalesce(equal, F.lit(False)), F.lit("SkippedVerificationFailed")).otherwise(F.lit(REMOVED))
    return (
        validated.filter("role = 'candidate'")
        .join(keepers, "group_id", "left")
        .select(
            "group_id",
            "item_id",
            "path",
            "length",
            outcome.alias("outcome"),
            F.coalesce("valid_survivors", F.lit(0)).alias("valid_survivors"),
        )
    )


def similar_outcomes(validated: DataFrame) -> DataFrame:
    """As `candidate_outcomes` for similar images, whose contents differ by nature."""
    survivors = _first_valid(validated, "survivor")
    outcome = F.when(F.col("_keeper").isNull(), F.lit("SkippedSurvivorUnavailable"))
    for status, result in SIMILAR_OUTCOMES.items():
        outcome = outcome.when(F.col("status") == status, F.lit(result))
    return (
        validated.filter("role = 'candidate'")
        .join(survivors, "group_id", "left")
        .select(
            "group_id",
            "item_id",
            "path",
            "length",
            outcome.otherwise(F.lit(REMOVED)).alias("outcome"),
            F.coalesce("valid_survivors", F.lit(0)).alias("valid_survivors"),
        )
    )


def group_results(outcomes: DataFrame) -> DataFrame:
    """Per group: requested, removed, skipped, failed, surviving verified members, reclaimed bytes."""
    removed = F.col("outcome") == REMOVED
    failed = F.col("outcome").isin(*FAILED)
    return outcomes.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("requested"),
        F.count_if(removed).alias("removed"),
        F.count_if(~removed & ~failed).alias("skipped"),
        F.count_if(failed).alias("failed"),
        F.max("valid_survivors").alias("survivors"),
        F.coalesce(F.sum(F.when(removed, F.col("length"))), F.lit(0)).alias("reclaimed"),
    )


def cleanup_result(results: DataFrame) -> DataFrame:
    """Totals of `group_results` in one row."""
    names = ("requested", "removed", "skipped", "failed", "reclaimed")
    return results.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in names])


def surviving_items(inventory: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The inventory without the removed items."""
    removed = outcomes.filter(F.col("outcome") == REMOVED).select("item_id", "path")
    return inventory.join(removed, ["item_id", "path"], "left_anti")


def similar_plan_issues(
    groups: DataFrame, members: DataFrame, marked: DataFrame, complete: bool = True
) -> DataFrame:
    """`plan_issues` for similar images: `marked` holds one row per mark, and lengths may differ.

    `groups` has group_id, representative_id and first_path.
    """
    if not complete:
        return _issue(members.sparkSession.range(1), "CancelledAnalysis")
    if marked.isEmpty():
        return _issue(members.sparkSession.range(1), "EmptyIntent")
    repeats = marked.groupBy("identity").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1)
    heads = members.select("group_id", F.col("item_id").alias("representative_id"), F.lit(True).alias("_in"))
    sizes = members.groupBy("group_id").agg(F.count(F.lit(1)).alias("_n"))
    judged = groups.join(sizes, "group_id", "left").join(heads, ["group_id", "representative_id"], "left")
    broken = judged.filter("coalesce(_n, 0) < 2 or _in is null").select("group_id")
    sound = members.join(broken, "group_id", "left_anti")
    first = materialize(_union(
        [
            _issue(repeats, "DuplicateCandidateIntent"),
            _issue(broken, "InvalidGroup"),
            invalid_members(sound, None, "InvalidGroup", negative_lengths=True),
            duplicate_identities(sound, groups),
            duplicate_paths(sound, groups),
            unsupported_paths(sound),
            unknown_selected(sound, marked, "UnknownCandidate"),
        ]
    ))
    if not first.isEmpty():
        return first
    chosen = members.join(marked.select("identity").distinct(), "identity", "left_semi")
    overflow = chosen.agg(F.count("length").alias("_n"), F.try_sum("length").alias("_sum"))
    return all_members_selected(members, marked, "AllIndependentMembersSelected").unionByName(
        _issue(overflow.filter("_n > 0 and _sum is null"), "ArithmeticOverflow")
    )


def build_similar_plan(groups: DataFrame, members: DataFrame, marked: DataFrame) -> DataFrame:
    """Candidates and survivors of the touched groups, with the tier of the group."""
    return build_plan(members, marked, "survivor").join(groups.select("group_id", "tier"), "group_id")


def check_similar_plan(
    plan: DataFrame, groups: DataFrame, members: DataFrame, stored_totals: DataFrame | None = None
) -> DataFrame:
    """`check_plan`, and the tiers, paths and stored totals (candidates, candidate_bytes) must agree too."""
    problem = lambda df, name: df.select(F.lit(name).alias("problem"), "group_id")
    tiers = plan.select("group_id", "tier").distinct().join(groups.select("group_id", "tier"), ["group_id", "tier"], "left_anti")
    twice = (
        plan.groupBy(F.upper("path").alias("_key"))
        .agg(F.count(F.lit(1)).alias("_n"), F.min("group_id").alias("group_id"))
        .filter("_n > 1")
    )
    parts = [check_plan(plan, members, "survivor"), problem(tiers, "TierMismatch"), problem(twice, "DuplicatePath")]
    if stored_totals is not None:
        names = ["candidates", "candidate_bytes"]
        wrong = stored_totals.select(*names).join(plan_totals(plan).select(*names), names, "left_anti")
        parts.append(problem(wrong.withColumn("group_id", F.lit(None).cast("long")), "TotalsMismatch"))
    return _union(parts)


def similar_review_summary(plan: DataFrame) -> DataFrame:
    """One row: affected groups, removed and remaining images, bytes, distinct folders touched."""
    candidate = F.col("role") == "candidate"
    folder = F.upper(paths.containing_folder("path"))
    return plan.agg(
        F.count_distinct("group_id").alias("affected_groups"),
        F.count_if(candidate).alias("removing"),
        F.count_if(~candidate).alias("remaining"),
        F.coalesce(F.sum(F.when(candidate, F.col("length"))), F.lit(0)).alias("selected_bytes"),
        F.count_distinct(F.when(candidate, folder)).alias("folders"),
    )

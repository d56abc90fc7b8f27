import random

import pytest
from duploscope.operators import exact, removal
from duploscope.session import materialize
from pyspark.sql import functions as F

ROWS = [
    {"path": "/r/a1.txt", "content": "aaaa"}, {"path": "/r/a2.txt", "content": "aaaa"}, {"path": "/r/a3.txt", "content": "aaaa"},
    {"path": "/r/b1.txt", "content": "bb"}, {"path": "/r/b2.txt", "content": "bb"},
]


@pytest.fixture(scope="module")
def scan(inventory):
    inv = inventory(ROWS)
    result = exact.find_exact_duplicates(inv)
    return inv, materialize(result.groups), materialize(result.members)


def pick(members, *ids):
    return members.filter(F.col("item_id").isin(list(ids))).select("identity")


def issues(scan, selection, members=None, groups=None, **options):
    inv, own_groups, own_members = scan
    total = exact.total_reclaimable(own_groups)
    found = removal.plan_issues(own_groups if groups is None else groups, own_members if members is None else members, selection, inv, total, **options)
    return sorted(((r["reason"], r["path"]) for r in found.collect()), key=str)


def reasons(*args, **options):
    return sorted({reason for reason, _ in issues(*args, **options)})


def change(members, item, **columns):
    return members.withColumns({name: F.when(F.col("item_id") == item, value).otherwise(F.col(name)) for name, value in columns.items()})


def test_clean_plan(scan):
    _, _, members = scan
    chosen = pick(members, 1, 3)
    assert issues(scan, chosen.unionByName(chosen)) == []
    plan = removal.build_plan(members, chosen.unionByName(chosen))
    assert sorted((r["item_id"], r["role"]) for r in plan.collect()) == [(1, "candidate"), (2, "keeper"), (3, "candidate")]
    assert tuple(removal.plan_totals(plan).first()) == (2, 8, 1)
    assert removal.check_plan(plan, members).isEmpty()
    assert removal.build_plan(members, pick(members)).isEmpty()


def test_rejections(scan):
    _, groups, members = scan
    some = pick(members, 1)
    assert reasons(scan, pick(members, 1, 2, 3)) == ["AllMembersSelected"]
    unknown = some.withColumn("identity", F.struct(F.lit(9).cast("long").alias("volume"), F.lit(9).cast("long").alias("id_low"), F.lit(0).cast("long").alias("id_high")))
    assert reasons(scan, unknown) == ["UnknownSelectedIdentity"]
    assert issues(scan, some, complete=False) == [("CancelledScanSnapshot", None)]
    two_groups = members.unionByName(members.filter("item_id = 1").withColumn("group_id", F.lit(4).cast("long")).withColumn("path", F.lit("/r/b3.txt")).withColumn("file_name", F.lit("b3.txt")))
    assert "DuplicatePhysicalIdentity" in reasons(scan, some, members=two_groups)
    same = members.filter("item_id = 1").select("identity").first()[0]
    alias = change(members, 2, identity=F.struct(*[F.lit(v).cast("long").alias(n) for n, v in same.asDict().items()]))
    assert ("DuplicatePhysicalIdentity", "/r/a2.txt") in issues(scan, some, members=alias)
    assert ("DuplicatePath", "/R/A1.TXT") in issues(scan, some, members=change(members, 2, path=F.lit("/R/A1.TXT"), file_name=F.lit("A1.TXT"))) or (
        "DuplicatePath", "/r/a1.txt") in issues(scan, some, members=change(members, 2, path=F.lit("/R/A1.TXT"), file_name=F.lit("A1.TXT")))
    assert "UnsupportedPath" in reasons(scan, some, members=change(members, 1, path=F.lit("\\\\host\\share\\a1.txt"), file_name=F.lit("a1.txt")))
    assert "InvalidVerifiedGroup" in reasons(scan, some, members=change(members, 1, length=F.lit(5).cast("long")))
    assert reasons(scan, some, members=change(members, 2, file_name=F.lit("other"))) == ["InvalidVerifiedGroup"]
    assert "InvalidVerifiedGroup" in reasons(scan, some, members=members.filter("item_id <> 5"))
    assert reasons(scan, some, groups=groups.withColumn("reclaimable", F.col("reclaimable") + 1)) == ["SnapshotArithmeticMismatch"]
    overflow = groups.withColumn("reclaimable", F.lit(2**63 - 1).cast("long"))
    assert reasons(scan, some, groups=overflow) == ["SnapshotArithmeticMismatch"]


def test_edges_of_groups(scan):
    inv, groups, members = scan
    some = pick(members, 1)
    negative = members.withColumn("length", F.when(F.col("group_id") == 4, -2).otherwise(F.col("length")).cast("long"))
    known = inv.withColumn("length", F.when(F.col("item_id") >= 4, -2).otherwise(F.col("length")).cast("long"))
    own = groups.withColumn("reclaimable", F.when(F.col("group_id") == 4, -2).otherwise(F.col("reclaimable")).cast("long"))
    assert issues((known, own, negative), some) == [("InvalidVerifiedGroup", None)]  # once for the group, not for its members
    empty = groups.unionByName(groups.filter("group_id = 4").withColumns({"group_id": F.lit(99).cast("long"), "first_path": F.lit("/z"), "reclaimable": F.lit(0).cast("long")}))
    assert issues((inv, empty, members), some) == [("InvalidVerifiedGroup", None)]
    timeless = lambda df: df.withColumn("modified_at", F.lit(None).cast("timestamp"))
    assert issues((timeless(inv), groups, timeless(members)), some) == []
    assert removal.check_plan(removal.build_plan(timeless(members), some), timeless(members)).isEmpty()
    assert {r for r, _ in issues((inv, groups, timeless(members)), some)} == {"InvalidVerifiedGroup"}
    total = exact.total_reclaimable(groups)
    single = groups.withColumn("reclaimable", F.when(F.col("group_id") == 4, 50).otherwise(F.col("reclaimable")).cast("long"))
    found = removal.arithmetic_mismatches(members.filter("item_id <> 5"), single, total.withColumn("reclaimable", F.lit(8).cast("long")))
    assert found.isEmpty()  # a group of one adds nothing to the total


def test_selected_bytes_that_overflow(scan):
    _, _, members = scan
    huge = members.withColumn("length", F.lit(2**62).cast("long"))
    assert [r["reason"] for r in removal.overflowing_selection(huge, pick(members, 1, 3)).collect()] == ["SnapshotArithmeticMismatch"]
    assert removal.overflowing_selection(huge, pick(members, 1)).isEmpty()


@pytest.mark.parametrize("attribute", removal.UNSAFE_ATTRIBUTES)
def test_unsafe_attributes(scan, attribute):
    members = change(scan[2], 1, attributes=F.array(F.lit("Normal"), F.lit(attribute)))
    assert issues(scan, pick(members, 2), members=members) == [("InvalidVerifiedGroup", "/r/a1.txt")]


def test_supported_paths(values):
    given = ["/a/b", "C:\\a\\b", "C:/a", "", " ", "//h/s", "\\\\h\\s", "a/b", "/a/../b", "/a/./b", "/a//b", "/a/..", "/a/b.", "/a/.hidden", None]
    assert values(given, removal.supported_path) == [True] * 3 + [False] * 9 + [True, True, False]


def test_damaged_plans(scan):
    _, _, members = scan
    plan = removal.build_plan(members, pick(members, 1))
    problems = lambda df: sorted({r["problem"] for r in removal.check_plan(df, members).collect()})
    assert problems(plan.withColumn("role", F.lit("candidate"))) == ["NoSurvivorOrCandidate"]
    assert problems(plan.filter("item_id <> 3")) == ["GroupMemberMissing"]
    assert problems(change(plan, 3, length=F.lit(9).cast("long"))) == ["GroupMemberMissing", "MemberNotInGroup"]
    assert problems(plan.unionByName(plan.filter("item_id = 1").withColumn("role", F.lit("keeper")))) == ["OverlappingIdentity"]


def fresh_state(inventory, **changes):
    rows = [dict(row, item_id=n) for n, row in enumerate(ROWS, start=1)]
    for name, change_ in changes.items():
        number = int(name[1:]) - 1
        rows[number] = None if change_ is None else {**rows[number], "identity": (1, number + 1, 0), **change_}
    kept = [dict(row, identity=row.get("identity", (1, row["item_id"], 0))) for row in rows if row]
    return exact.verify_content(inventory(kept), None)


@pytest.mark.parametrize(
    "changes, expected",
    [
        ({}, "Recycled"), ({"i1": None}, "SkippedMissing"), ({"i1": {"identity": (1, 50, 0)}}, "SkippedIdentityMismatch"),
        ({"i1": {"changed": 1}}, "SkippedChanged"), ({"i1": {"length": 5}}, "SkippedChanged"), ({"i1": {"link_count": 2}}, "SkippedPolicy"),
        ({"i1": {"attributes": ["System"]}}, "SkippedPolicy"), ({"i1": {"path": "/r/renamed.txt"}}, "SkippedMissing"),
        ({"i1": {"content": "aaab"}}, "SkippedVerificationFailed"), ({"i2": None}, "Recycled"), ({"i2": {"link_count": 2}}, "Recycled"),
        ({"i2": None, "i3": {"changed": 1}}, "SkippedKeeperUnavailable"),
    ],
)
def test_revalidation(scan, inventory, changes, expected):
    inv, _, members = scan
    plan = removal.build_plan(members, pick(members, 1))
    outcomes = removal.candidate_outcomes(removal.revalidate(plan, fresh_state(inventory, **changes)))
    assert [r["outcome"] for r in outcomes.collect()] == [expected]
    result = removal.cleanup_result(removal.group_results(outcomes)).first()
    gone = expected == "Recycled"
    assert tuple(result) == (1, int(gone), int(not gone), 0, 4 * gone)
    assert removal.surviving_items(inv, outcomes).count() == 5 - gone


def test_no_removal_without_a_valid_keeper(spark):
    """1,000 groups of 2 to 12 members; each keeper is gone with chance 1/4."""
    rng = random.Random(0x5A17)
    plan, fresh = [], []
    for group in range(1000):
        size = rng.randint(2, 12)
        for n, candidate in enumerate(n < rng.randint(1, size - 1) or n == 0 for n in range(size)):
            candidate = candidate and n < size - 1
            item = group * 100 + n
            plan.append((group, item, f"/g/{item}", "candidate" if candidate else "keeper"))
            if candidate or rng.random() >= 0.25:
                fresh.append(f"/g/{item}")
    columns = "struct(1L as volume, item_id as id_low, 0L as id_high) as identity", "10L as length", "timestamp_seconds(0) as modified_at", \
        "timestamp_seconds(0) as changed_at", "array('Normal') as attributes", "1 as link_count", "'k' as content_key"
    planned = spark.createDataFrame(plan, "group_id long, item_id long, path string, role string").selectExpr("*", *columns)
    now = planned.join(spark.createDataFrame([(p,) for p in fresh], "path string"), "path")
    outcomes = removal.candidate_outcomes(removal.revalidate(planned, now)).collect()
    valid = {}
    present = set(fresh)
    for group, _, path, role in plan:
        valid[group] = valid.get(group, 0) + (role == "keeper" and path in present)
    assert len(outcomes) == sum(role == "candidate" for *_, role in plan)
    assert all((row["outcome"] == "Recycled") == (valid[row["group_id"]] > 0) for row in outcomes)


@pytest.fixture(scope="module")
def similar(scan):
    _, groups, members = scan
    return groups.select("group_id", "first_path", F.col("group_id").alias("representative_id"), F.lit("Similar").alias("tier")), members


def test_similar_plans(similar, inventory):
    groups, members = similar
    marks = pick(members, 2, 5)
    found = lambda marks, groups=groups, **o: sorted({r["reason"] for r in removal.similar_plan_issues(groups, members, marks, **o).collect()})
    assert found(marks) == []
    assert found(marks.limit(0)) == ["EmptyIntent"] and found(marks, complete=False) == ["CancelledAnalysis"]
    assert found(marks.unionByName(marks)) == ["DuplicateCandidateIntent"]
    assert found(pick(members, 4, 5)) == ["AllIndependentMembersSelected"]
    assert found(marks, groups.withColumn("representative_id", F.lit(77).cast("long"))) == ["InvalidGroup", "UnknownCandidate"]
    plan = removal.build_similar_plan(groups, members, marks)
    assert {(r["item_id"], r["role"], r["tier"]) for r in plan.collect()} == {
        (1, "survivor", "Similar"), (2, "candidate", "Similar"), (3, "survivor", "Similar"), (4, "survivor", "Similar"), (5, "candidate", "Similar")
    }
    totals = removal.plan_totals(plan)
    assert removal.check_similar_plan(plan, groups, members, totals).isEmpty()
    off = removal.check_similar_plan(plan.withColumn("tier", F.lit("VerySimilar")), groups, members, totals.withColumn("candidates", F.col("candidates") + 1))
    assert {r["problem"] for r in off.collect()} == {"TierMismatch", "TotalsMismatch"}
    assert tuple(removal.similar_review_summary(plan).first()) == (2, 2, 3, 6, 1)
    state = fresh_state(inventory, i2={"link_count": 2}, i4={"link_count": 2})
    outcomes = removal.similar_outcomes(removal.revalidate_similar(plan, state))
    assert {(r["item_id"], r["outcome"]) for r in outcomes.collect()} == {(2, "SkippedAmbiguousHardLinks"), (5, "SkippedSurvivorUnavailable")}
    clean = removal.similar_outcomes(removal.revalidate_similar(plan, fresh_state(inventory)))
    assert tuple(removal.cleanup_result(removal.group_results(clean)).first()) == (2, 2, 0, 0, 6)

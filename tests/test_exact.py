import random

import pytest
from duploscope.operators import eligibility, exact
from pyspark.sql import functions as F


def found(result):
    members = {}
    for row in result.members.collect():
        members.setdefault(row["group_id"], []).append(row["path"])
    return {r["group_id"]: (sorted(members[r["group_id"]]), r["reclaimable"]) for r in result.groups.collect()}


def lists(result):
    return sorted((paths, n) for paths, n in found(result).values())


def test_no_groups(inventory):
    for rows in ([], [{"path": "/r/a", "content": "x"}], [{"path": "/r/a", "content": "x"}, {"path": "/r/b", "content": "xy"}]):
        result = exact.find_exact_duplicates(inventory(rows))
        assert lists(result) == [] and result.skipped.count() == 0
        assert exact.total_reclaimable(result.groups).first()[0] == 0


def test_pair_with_decoys(inventory, content_of):
    rows = [{"path": "/z/alpha", "content": "AAAA"}, {"path": "/a/beta", "content": "AAAA"},
            {"path": "/a/other", "content": "AAAAA"}, {"path": "/a/same-size", "content": "BBBB"}]
    assert lists(exact.find_exact_duplicates(inventory(rows), content_of(rows))) == [(["/a/beta", "/z/alpha"], 4)]


def test_groups_are_numbered_by_first_path(inventory):
    rows = [{"path": f"/{p}", "content": c} for p, c in (("B1", "xxx"), ("b2", "xxx"), ("a1", "yyyyy"), ("A2", "yyyyy"), ("_c", "zz"), ("_d", "zz"))]
    result = exact.find_exact_duplicates(inventory(rows))
    indexed = exact.with_group_index(result.groups).orderBy("group_index").collect()
    assert [(r["group_index"], r["first_path"]) for r in indexed] == [(0, "/a1"), (1, "/B1"), (2, "/_c")]
    assert exact.total_reclaimable(result.groups).first()[0] == 10


def test_equal_digest_is_no_proof(inventory, content_of):
    rows = [{"path": f"/{n}", "content": c, "digest": "same"} for n, c in enumerate(["AAAA", "BBBB", "AAAA", "CCCC", "BBBB"])]
    assert lists(exact.find_exact_duplicates(inventory(rows), content_of(rows))) == [(["/0", "/2"], 4), (["/1", "/4"], 4)]
    pair = [{"path": "/a", "content": "AAAA", "digest": "same"}, {"path": "/b", "content": "BBBB", "digest": "same"}]
    assert lists(exact.find_exact_duplicates(inventory(pair), content_of(pair))) == []


def test_aliases_are_not_copies(inventory):
    rows = [{"path": "/b", "content": "12345678", "identity": (1, 7, 0)}, {"path": "/A", "content": "12345678", "identity": (1, 7, 0)},
            {"path": "/c", "content": "12345678", "identity": (1, 8, 0)}]
    assert lists(exact.find_exact_duplicates(inventory(rows))) == [(["/A", "/c"], 8)]
    high = [{"path": f"/{n}", "content": "xx", "identity": (1, 1, n)} for n in range(2)]
    assert lists(exact.find_exact_duplicates(inventory(high))) == [(["/0", "/1"], 2)]


def test_unreadable_rows_are_skipped_alone(inventory):
    rows = [{"path": "/a", "content": "xxx"}, {"path": "/b", "content": "xxx"}, {"path": "/c", "length": 3}, {"path": "/d", "length": 99}]
    result = exact.find_exact_duplicates(inventory(rows))
    assert lists(result) == [(["/a", "/b"], 3)]
    assert [(r["path"], r["reason"]) for r in result.skipped.collect()] == [("/c", "HashFailed")]


def test_three_members_and_empty_items(inventory):
    rows = [{"path": f"/{n}", "content": "123456789"} for n in range(3)] + [{"path": f"/e{n}", "content": ""} for n in range(2)]
    assert lists(exact.find_exact_duplicates(inventory(rows))) == [(["/0", "/1", "/2"], 18), (["/e0", "/e1"], 0)]


def test_overflow_fails(inventory):
    rows = [{"path": f"/{n}", "length": 2**63 - 1, "digest": "d"} for n in range(3)]
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        exact.find_exact_duplicates(inventory(rows)).groups.collect()


def flagged(inventory, rows):
    names = {row["path"]: row for row in rows}
    compare = [p for p, r in names.items() if r.get("compare_failed")]
    validate = [p for p, r in names.items() if r.get("validate_failed")]
    return inventory(rows).withColumn("compare_failed", F.col("path").isin(compare)).withColumn("validate_failed", F.col("path").isin(validate))


def test_failed_comparison_and_validation(inventory):
    three = [{"path": f"/{n}", "content": "x", "compare_failed": n == 2} for n in range(3)]
    result = exact.find_exact_duplicates(flagged(inventory, three))
    assert lists(result) == [] and {r["reason"] for r in result.skipped.collect()} == {"ComparisonFailed"} and result.skipped.count() == 3
    pair = [{"path": f"/{n}", "content": "x", "validate_failed": n == 1} for n in range(2)]
    result = exact.find_exact_duplicates(flagged(inventory, pair))
    assert lists(result) == [] and sorted(r["path"] for r in result.skipped.collect()) == ["/0", "/1"]


def plain_sets(flags):
    """Sets of positions and skipped positions, one row after the other."""
    sets, skipped, current = [], set(), []
    for position, (compare_failed, _) in enumerate(flags):
        if current and compare_failed:
            skipped |= {*current, position}
            current = []
        else:
            current.append(position)
            if len(current) == 1:
                sets.append(current)
    sets = [s for s in sets if len(s) > 1 and not skipped & set(s)]
    stale = [s for s in sets if any(flags[p][1] for p in s)]
    return [s for s in sets if s not in stale], skipped | {p for s in stale for p in s}


def test_failures_against_a_plain_model(inventory):
    rng = random.Random(5)
    cases = [[(rng.random() < 0.4, rng.random() < 0.1) for _ in range(rng.randint(2, 12))] for _ in range(120)]
    rows = [
        {"path": f"/{case:03}/{p:02}", "content": f"{case:05}", "compare_failed": c, "validate_failed": v}
        for case, flags in enumerate(cases) for p, (c, v) in enumerate(flags)
    ]
    result = exact.find_exact_duplicates(flagged(inventory, rows))
    expected_groups, expected_skipped = set(), set()
    for case, flags in enumerate(cases):
        sets, skipped = plain_sets(flags)
        expected_groups |= {tuple(f"/{case:03}/{p:02}" for p in s) for s in sets}
        expected_skipped |= {f"/{case:03}/{p:02}" for p in skipped}
    assert {tuple(paths) for paths, _ in found(result).values()} == expected_groups
    assert {r["path"] for r in result.skipped.collect()} == expected_skipped


def test_generated_corpus(inventory):
    """2,000 unique items in 37 folders, and a few copies, an alias and a hidden item."""
    big = 1024 * 1024
    rows = [{"path": f"/c/f{n % 37:02}/unique-{n}.bin", "length": n + 1, "digest": f"u{n}"} for n in range(2000)]
    special = [("pair", 32 * big, 2, "p"), ("triple", 16 * big, 3, "t"), ("empty", 0, 2, "e"), ("größe-文件", 37, 2, "g")]
    for name, length, copies, digest in special:
        rows += [{"path": f"/c/{name}-{n}", "length": length, "digest": digest} for n in range(copies)]
    rows += [{"path": f"/c/unequal-{n}", "length": 24 * big, "digest": f"n{n}"} for n in range(2)]
    rows += [{"path": "/c/single", "length": 32 * big, "digest": "s"}, {"path": "/c/hidden", "length": 37, "digest": "g", "attributes": ["Hidden"]}]
    rows += [{"path": "/c/alias", "length": 32 * big, "digest": "p", "identity": (1, 2001, 0)}]
    split = eligibility.split_eligible(inventory(rows, root="/c"), eligibility.Policy())
    result = exact.find_exact_duplicates(split.accepted)
    assert split.accepted.count() == 2013 and split.skipped.count() == 1
    total = result.groups.agg(F.count("*"), F.sum("members"), F.sum("reclaimable")).first()
    assert tuple(total) == (4, 9, 64 * big + 37)
    counts = {r["stage"]: r["items"] for r in exact.scan_funnel(split.accepted, split.accepted, result, exact.dedupe_identity(split.accepted)).collect()}
    assert counts["found"] == 2013 and counts["distinct identity"] == 2012 and counts["members"] == 9


def test_snapshots(inventory):
    before = inventory([{"path": f"/{n}", "length": 5} for n in range(6)])
    after = inventory([
        {"path": "/0", "length": 5}, {"path": "/1", "length": 6}, {"path": "/2", "length": 5, "changed": 1},
        {"path": "/3", "length": 5, "identity": (1, 99, 0)}, {"path": "/4", "length": 5, "attributes": ["AlternateDataStream"]},
    ])
    rows = exact.snapshot_unchanged(before, after).orderBy("path").collect()
    assert [(r["present"], r["unchanged"]) for r in rows] == [(True, True)] + [(True, False)] * 4 + [(False, False)]


def test_results_do_not_depend_on_partitions(inventory):
    rng = random.Random(3)
    rows = [{"path": f"/{n:03}", "content": str(rng.randint(0, 40))} for n in range(300)]
    inv = inventory(rows)
    one = lists(exact.find_exact_duplicates(inv.coalesce(1)))
    assert one == lists(exact.find_exact_duplicates(inv.repartition(7, "path"))) and one

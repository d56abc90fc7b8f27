import pytest
from duploscope.operators import exact, review, selection
from duploscope.session import materialize
from duploscope.sources import reports
from pyspark.sql import functions as F

KIB, MIB = 1024, 1024 * 1024


@pytest.fixture(scope="module")
def small(inventory):
    rows = [
        {"path": "/a/photo-1.jpg", "length": 512 * KIB, "digest": "p", "modified": 5},
        {"path": "/b/photo, \"2\".jpg", "length": 512 * KIB, "digest": "p", "modified": 1},
        {"path": "/a/report-1.pdf", "length": 2 * MIB, "digest": "r", "modified": 2},
        {"path": "/b/report-2.pdf", "length": 2 * MIB, "digest": "r", "modified": 2},
        {"path": "/b/report-3.pdf", "length": 2 * MIB, "digest": "r", "modified": 9},
    ]
    found = exact.find_exact_duplicates(inventory(rows, root="/"))
    view = selection.clear_selection(review.members_view(found.members, found.groups, ["/a", "/b"]))
    return materialize(found.groups), materialize(view)


def names(df):
    return sorted(r["file_name"] for r in df.collect())


def test_composed_filters(small):
    groups, view = small
    visible = review.filter_members(view, search=".jpg", file_type="Photos", size="LessThan1Mb", location="/A")
    assert names(visible) == ["photo-1.jpg"]
    shown = review.visible_groups(groups, visible).collect()
    assert [(r["members"], r["reclaimable"]) for r in shown] == [(2, 512 * KIB)]
    assert review.filter_members(view, size="Custom", min_bytes=512 * KIB, max_bytes=512 * KIB).count() == 2
    assert review.filter_members(view, size="OneTo10Mb").count() == 3
    assert {r["display_name"] for r in view.collect()} == {"photo-1.jpg", "report-1.pdf"}


def test_sorts(inventory):
    rows = []
    for name, length, copies, modified in (("b", 20, 2, 3), ("A", 10, 2, 1), ("c", 10, 3, 2)):
        rows += [{"path": f"/{name}{n}", "length": length, "digest": name, "modified": modified} for n in range(copies)]
    groups = exact.find_exact_duplicates(inventory(rows)).groups

    def order(by, descending):
        return "".join(r["first_path"][1] for r in review.sort_groups(groups, by, descending).collect())

    assert order("reclaimable", True) == "bcA" and order("reclaimable", False) == "Abc"
    assert order("file_size", True) == "bAc" and order("file_size", False) == "Acb"
    assert order("copy_count", True) == "cAb" and order("copy_count", False) == "Abc"
    assert order("name", True) == "cbA" and order("name", False) == "Abc"
    assert order("path", True) == "cbA" and order("path", False) == "Abc"
    assert order("modified", True) == "bcA" and order("modified", False) == "Acb"
    assert [r["first_path"] for r in review.sort_groups(groups, top=1).collect()] == ["/b0"]


def chosen(df):
    return sorted(r["path"] for r in df.collect())


def test_rules(small):
    _, view = small
    assert chosen(selection.propose(view, "keep_newest")) == ['/a/report-1.pdf', '/b/photo, "2".jpg', "/b/report-2.pdf"]
    assert chosen(selection.propose(view, "keep_oldest")) == ["/a/photo-1.jpg", "/b/report-2.pdf", "/b/report-3.pdf"]
    for rule in ("prefer_location", "select_outside_location"):
        assert chosen(selection.propose(view, rule, "/B")) == ["/a/photo-1.jpg", "/a/report-1.pdf", "/b/report-3.pdf"]
        assert chosen(selection.propose(view, rule, " ")) == [] and chosen(selection.propose(view, rule, "/none")) == []
    with pytest.raises(ValueError):
        selection.propose(view, "keep_best")


def test_scope_apply_and_undo(small):
    groups, view = small
    visible = review.visible_groups(groups, review.filter_members(view, file_type="Documents"))
    proposal = selection.propose(view, "keep_oldest", scope=visible)
    assert tuple(selection.proposal_summary(proposal).first()) == (2, 4 * MIB, 1)
    before = view.withColumn("selected", F.col("file_name") == "report-1.pdf")
    applied = selection.apply_proposal(before, proposal)
    assert tuple(review.selection_summary(applied.members).first()) == (2, 4 * MIB)
    assert review.only_selected_groups(groups, applied.members).count() == 1
    undone = selection.undo(applied.members, applied.previous)
    assert names(undone.filter("selected")) == ["report-1.pdf"]
    assert review.selection_summary(selection.clear_selection(undone)).first()[0] == 0
    with pytest.raises(ValueError):
        selection.apply_proposal(before, view)


def test_the_last_free_member_is_refused(small, spark):
    _, view = small
    wanted = [(r["item_id"], n) for n, r in enumerate(view.orderBy("path").collect())]
    requests = spark.createDataFrame(wanted, "item_id long, request_no long")
    guarded = selection.guard_survivor(view, requests)
    assert names(guarded.members.filter("selected")) == ["photo-1.jpg", "report-1.pdf", "report-2.pdf"]
    refused = {r["item_id"] for r in guarded.refused.collect()}
    assert names(view.filter(F.col("item_id").isin(list(refused)))) == ['photo, "2".jpg', "report-3.pdf"]
    again = selection.guard_survivor(guarded.members, requests)
    assert names(again.members.filter("selected")) == names(guarded.members.filter("selected"))


def test_members_of_one_id_in_two_groups(spark):
    rows = [(1, 7, f"/a{n}") for n in range(1)] + [(1, 8, "/a1"), (2, 7, "/b0"), (2, 9, "/b1")]
    members = spark.createDataFrame([(g, i, p, False) for g, i, p in rows], "group_id long, item_id long, path string, selected boolean")
    requests = spark.createDataFrame([(1, 7, 1), (2, 9, 2)], "group_id long, item_id long, request_no long")
    chosen = selection.guard_survivor(members, requests).members.filter("selected").collect()
    assert {(r["group_id"], r["item_id"]) for r in chosen} == {(1, 7), (2, 9)}


def test_many_groups(spark):
    members = spark.range(50_000).selectExpr(
        "id as item_id", "id div 10 as group_id", "concat('/m/', lpad(id, 6, '0')) as path", "100L as length",
        "timestamp_seconds(id % 7) as modified_at", "named_struct('volume', 1L, 'id_low', id, 'id_high', 0L) as identity", "false as selected",
    )
    applied = selection.apply_proposal(members, selection.propose(members, "keep_newest")).members
    assert tuple(review.selection_summary(applied).first()) == (45_000, 4_500_000)
    left = applied.filter("not selected").groupBy("group_id").count()
    assert left.count() == 5_000 and left.filter("count <> 1").isEmpty()


def test_reports(small, tmp_path):
    groups, view = small
    marked = view.withColumn("selected", F.col("file_name") == "report-3.pdf")
    rows = reports.duplicate_report_rows(marked, exact.with_group_index(groups))
    reports.write_quoted_csv(rows.coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text[0] == '"Group","Filename","Full path","Size bytes","Formatted size","Modified","Extension","Type","Selected candidate"'
    assert text[2] == (
        '"1","photo, ""2"".jpg","/b/photo, ""2"".jpg","524288","512.0 KB","2024-01-01T01:00:00.0000000+00:00",".jpg","Photos","No"'
    )
    assert len(text) == 6 and text[5].endswith('"Documents","Yes"')
    lines = reports.duplicate_report_text(rows)
    reports.write_text(lines.coalesce(1), str(tmp_path / "text"), "Group", F.upper("path"), "line_no")
    written = next((tmp_path / "text").glob("*.txt")).read_text().splitlines()
    assert written[:2] == ["Group 1: photo-1.jpg", "  Path: /a/photo-1.jpg"] and len(written) == 25
    visible = review.filter_members(view, file_type="Photos")
    summary = reports.duplicate_report_summary(review.visible_groups(groups, visible), visible, marked, "Current filtered results").first()
    assert (summary["groups"], summary["members"], summary["reclaimable"], summary["selected"], summary["selected_bytes"]) == (1, 2, 512 * KIB, 1, 2 * MIB)


def test_locations_and_totals(small, spark):
    groups, view = small
    roots = spark.createDataFrame([("/a",), ("/A",), (" ",), ("/b",)], "root string")
    assert sorted(r[0].upper() for r in review.locations(view, roots).collect()) == ["/A", "/B"]
    assert [r[0] for r in review.locations(view).collect()] == ["/"]
    assert tuple(review.result_summary(groups, view.limit(3), view.limit(1)).first()) == (2, 5, 512 * KIB + 4 * MIB, 4)

import random

import pytest
from duploscope.operators import compare, exact, trees
from duploscope.sources import reports
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def items(inventory):
    def build(files):
        rows = []
        for number, (path, content, *rest) in enumerate(files, start=1):
            root = "/" + path.split("/")[1]
            rows.append({"path": path, "content": content, "root": root, "identity": rest[0] if rest else (1, number, 0)})
        return exact.verify_content(inventory(rows), None)

    return build


def folder_groups(found):
    by_group = {}
    for row in found.members.collect():
        by_group.setdefault(row["group_folder"], []).append(row["folder"])
    figures = {r["group_folder"]: (r["folders"], r["logical_files"], r["distinct_identities"], r["total_bytes"], r["reclaimable"]) for r in found.groups.collect()}
    return {tuple(sorted(folders)): figures[name] for name, folders in by_group.items()}


def test_equal_folders(items):
    found = trees.find_duplicate_folders(items([("/A/photos/same.txt", "123"), ("/B/photos/same.txt", "123")]))
    assert folder_groups(found) == {("/A", "/B"): (2, 1, 2, 3, 3)}
    other_name = items([("/A/one.txt", "123"), ("/B/two.txt", "123")])
    assert folder_groups(trees.find_duplicate_folders(other_name)) == {}
    other_bytes = items([("/A/one.txt", "123"), ("/B/one.txt", "124")])
    assert folder_groups(trees.find_duplicate_folders(other_bytes)) == {}
    assert {tuple(r) for r in trees.structural_candidates(trees.expand_folders(other_bytes)).collect()} == {("/A", "/A"), ("/B", "/A")}


def test_aliases_free_nothing(items):
    found = trees.find_duplicate_folders(items([("/A/x", "12345", (1, 7, 0)), ("/B/x", "12345", (1, 7, 0))]))
    assert folder_groups(found) == {("/A", "/B"): (2, 1, 1, 5, 0)}


def test_nested_groups_are_suppressed(items):
    files = [(f"/{root}/{name}", name) for root in "AB" for name in ("root.txt", "nested/child.txt")]
    everything = trees.verified_folder_groups(trees.expand_folders(items(files)))
    assert set(folder_groups(everything)) == {("/A", "/B"), ("/A/nested", "/B/nested")}
    kept = trees.suppress_nested_groups(everything)
    assert folder_groups(kept) == {("/A", "/B"): (2, 2, 4, len("root.txt" + "nested/child.txt"), len("root.txt" + "nested/child.txt"))}
    elsewhere = files + [("/C/other/nested/child.txt", "x"), ("/D/child.txt", "nested/child.txt")]
    assert set(folder_groups(trees.find_duplicate_folders(items(elsewhere)))) == {("/A", "/B"), ("/A/nested", "/B/nested", "/D")}


def test_every_class_of_one_shape_is_found(items):
    files = [("/P1/x", "pp"), ("/P2/x", "pp"), ("/Q1/x", "qq"), ("/Q2/x", "qq"), ("/R/x", "rr")]
    found = trees.find_duplicate_folders(items(files))
    assert set(folder_groups(found)) == {("/P1", "/P2"), ("/Q1", "/Q2")}
    shapes = trees.structural_candidates(trees.expand_folders(items(files)))
    assert {r["first_folder"] for r in shapes.collect()} == {"/P1"} and shapes.count() == 5


def test_unreadable_files_and_metrics(items, inventory):
    inv = items([("/A/x", "1"), ("/B/x", "1")]).withColumn("content_key", F.when(F.col("path") == "/A/x", F.col("content_key")))
    assert folder_groups(trees.find_duplicate_folders(inv)) == {}
    files = items([("/A/x", "12", (1, 1, 0)), ("/A/s/y", "12", (1, 1, 0)), ("/A/s/z", "123")])
    rows = {r["folder"]: tuple(r)[1:] for r in trees.folder_metrics(trees.expand_folders(files)).collect()}
    assert rows == {"/A": (3, 2, 7, 5), "/A/s": (2, 2, 5, 5)}
    flat = {r["folder"]: r["logical_files"] for r in trees.folder_metrics(trees.expand_folders(files, recursive=False)).collect()}
    assert flat == {"/A": 3}


def test_folder_results(items, tmp_path):
    files = [(f"/{root}/{n}", str(n)) for root in ("A", "B") for n in range(3)] + [("/C, x/y", "long text"), ("/D/y", "long text")]
    found = trees.find_duplicate_folders(items(files))
    results = trees.folder_results(found)
    order = lambda **o: [r["folder"] for r in trees.filter_folder_results(results, **o).collect()]
    assert order() == ["/C, x", "/D", "/A", "/B"] and order(sort="count") == ["/A", "/B", "/C, x", "/D"]
    assert order(min_files=2) == ["/A", "/B"] and order(search=" d ") == ["/D"] and order(sort="path")[0] == "/A"
    from duploscope.functions import ranking

    indexed = ranking.global_rank(found.groups, [F.col("group_folder")], "group_index")
    metrics = trees.folder_metrics(trees.expand_folders(items(files)))
    reports.write_plain_csv(reports.folder_report_rows(results, indexed, metrics).coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text[0] == "Group,Folder root,Logical file count,Independent physical files,Total logical bytes,Potential reclaimable bytes"
    assert text[3] == '2,"/C, x",1,1,9,9' and len(text) == 5
    lines = reports.folder_report_text(found.groups, found.members, indexed).orderBy("Group", "part", "folder", "line_no")
    assert [r["line"] for r in lines.collect()][:7] == [
        "Group 1", "Logical files: 3", "Independent physical files: 6", "Potential reclaimable bytes: 3", "  /A", "  /B", ""
    ]


MASTER = [("/m/same", "s"), ("/m/changed", "c1"), ("/m/gone", "g"), ("/m/moved", "mm")]
TARGET = [("/t/same", "s"), ("/t/changed", "c2"), ("/t/x/moved-1", "mm"), ("/t/x/moved-2", "mm"), ("/t/new", "n")]


def test_comparison(items, tmp_path):
    everything = items(MASTER + TARGET + [("/u/same", "s")])
    result = compare.compare_master(everything.filter("root = '/m'"), everything.filter("root <> '/m'"), "/m", ["/t/", "/M", "/T", "/u"])
    rows = {(r["target"], r["relative"]): (r["status"], r["compared_count"]) for r in result.rows.collect()}
    assert {k[1]: v for k, v in rows.items() if k[0] == "/t"} == {
        "same": ("Identical", 1), "changed": ("Different", 1), "gone": ("OnlyInMaster", 0), "moved": ("MovedRenamedExactMatch", 2), "new": ("OnlyInTarget", 1)
    }
    assert sum(k[0] == "/u" and v[0] == "OnlyInMaster" for k, v in rows.items()) == 3
    summary = {r["target"]: tuple(r)[1:] for r in result.summary.collect()}
    assert summary == {"/t": (4, 5, 1, 1, 1, 1, 1, 1), "/u": (4, 1, 1, 0, 3, 0, 0, 1)}
    assert {r["compared_path"] for r in result.match_sets.collect()} == {"/t/x/moved-1", "/t/x/moved-2"}
    assert [r["relative"] for r in compare.filter_compare_rows(result.rows, "OnlyInMaster", "GON").filter("target = '/t'").collect()] == ["gone"]
    one = result.rows.filter("target = '/t'")
    assert [r["relative"] for r in compare.sort_compare_rows(one).collect()] == ["changed", "gone", "moved", "new", "same"]
    listed = {r["Relative path"]: r for r in reports.comparison_report_rows(one).collect()}
    assert listed["moved"]["Compared path"] == "/t/x/moved-1 (+1)" and listed["gone"]["Compared path"] == ""
    moved = reports.comparison_report_moved(result.match_sets).collect()
    assert {(r["Content"], r["Compared path"]) for r in moved} == {(listed["moved"]["Match set"], f"/t/x/moved-{n}") for n in (1, 2)}
    head = reports.comparison_report_head(result.summary, "/m").filter("target = '/t'").orderBy("line_no").collect()
    assert [r["line"] for r in head] == ["Master: /m", "Compared: /t", ""]
    reports.write_plain_csv(reports.comparison_report_rows(one).coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("*.csv")).read_text().splitlines()
    assert text[2] == "/t,OnlyInMaster,gone,/m/gone,,1,,2024-01-01T00:00:00.0000000+00:00,,"
    lines = [r["line"] for r in reports.comparison_report_text(one).orderBy("relative", "line_no").collect()]
    assert lines[3:6] == ["OnlyInMaster | gone", "  Master: /m/gone", "  Compared: (none)"]


def test_spellings_of_a_folder_are_one_folder(items):
    files = [("/A/Sub/x", "1"), ("/A/sub/y", "2"), ("/B/SUB/x", "1"), ("/B/Sub/y", "2")]
    found = trees.find_duplicate_folders(items([(*f, (1, n, 0)) for n, f in enumerate(files)]))
    assert set(folder_groups(found)) == {("/A/Sub", "/B/SUB")}


def test_a_changed_file_takes_its_folders_out(items):
    inv = items([("/A/p/x", "1", (1, 1, 0)), ("/A/y", "2", (1, 2, 0)), ("/B/p/x", "1", (1, 3, 0)), ("/B/y", "2", (1, 4, 0))])
    assert set(folder_groups(trees.find_duplicate_folders(inv))) == {("/A", "/B")}
    for flag in ("validate_failed", "compare_failed"):
        found = trees.find_duplicate_folders(inv.withColumn(flag, F.col("path") == "/B/y"))
        assert set(folder_groups(found)) == {("/A/p", "/B/p")}
    lost = inv.filter("path = '/B/y'").select("item_id", "path", F.lit("Unavailable").alias("reason"))
    assert set(folder_groups(trees.find_duplicate_folders(inv, skipped=lost.union(lost)))) == {("/A/p", "/B/p")}


def test_roots_without_case_and_an_empty_target(items):
    both = items([("/m/x", "1"), ("/t/x", "1")])
    result = compare.compare_master(both.filter("root = '/m'"), both.filter("root = '/t'"), "/m", ["/T", "/empty"])
    assert {(r["target"], r["status"]) for r in result.rows.collect()} == {("/T", "Identical"), ("/empty", "OnlyInMaster")}
    nothing = compare.compare_master(both.limit(0), both.limit(0), "/m", ["/t"])
    assert [tuple(r) for r in nothing.summary.collect()] == [("/t", 0, 0, 0, 0, 0, 0, 0, 0)]


def test_unreadable_content_is_different(items):
    both = items([("/m/x", "1"), ("/t/x", "1")]).withColumn("content_key", F.lit(None).cast("string"))
    result = compare.compare_master(both.filter("root = '/m'"), both.filter("root = '/t'"), "/m", ["/t"])
    assert [r["status"] for r in result.rows.collect()] == ["Different"]


def test_one_target_may_serve_many_masters(items):
    everything = items([(f"/m/{n}", "same") for n in range(20)] + [(f"/t/x{n}", "same") for n in range(30)])
    result = compare.compare_master(everything.filter("root = '/m'"), everything.filter("root = '/t'"), "/m", ["/t"])
    assert {(r["status"], r["compared_count"]) for r in result.rows.collect()} == {("MovedRenamedExactMatch", 30)}
    assert result.rows.count() == 20 and result.match_sets.count() == 30


def bottom_up_and_expanded(inv):
    """The groups found bottom-up, which must have been possible, and those of files set against all folders above them."""
    assert trees.folder_tree(inv) is not None
    return folder_groups(trees.tree_groups(inv)), folder_groups(trees.verified_folder_groups(trees.expand_folders(inv)))


def test_trees_bottom_up_equal_trees_by_all_ancestors(items):
    """Random trees with copied, changed and unreadable parts, aliases, files and folders of one name at several depths."""
    draw = random.Random(11)
    files = {}
    for root in ("/A", "/B", "/Cc"):
        for _ in range(14):
            place = "/".join(draw.choice(("p", "q", "rr")) for _ in range(draw.randint(0, 3)))
            files[f"{root}/{place}/{draw.choice('xy')}".replace("//", "/")] = draw.choice(("1", "1", "22"))
    copied = {path.replace("/A/", "/D/e/f/", 1): content for path, content in files.items() if path.startswith("/A/")}
    taken = {path for path in files for other in files if other.startswith(path + "/")}  # a file is no folder
    rows = [(path, content, (1, n // 2, 0)) for n, (path, content) in enumerate({**files, **copied}.items()) if path not in taken]
    inv = items(rows)
    inv = inv.withColumn("content_key", F.when(F.xxhash64("path") % 13 != 0, F.col("content_key")))
    bottom_up, expanded = bottom_up_and_expanded(inv)
    assert bottom_up == expanded and bottom_up
    kept = trees.suppress_nested_groups(trees.verified_folder_groups(trees.expand_folders(inv)))
    assert folder_groups(trees.find_duplicate_folders(inv)) == folder_groups(kept)
    shapes = {tuple(r) for r in trees.structural_candidates(trees.expand_folders(inv)).collect()}
    assert {tuple(r) for r in trees.equal_folders(inv, ["length"]).collect()} == shapes


def test_a_tree_from_the_top_and_empty_trees(inventory):
    rows = [{"path": path, "content": content, "root": "/"} for path, content in [("/x", "1"), ("/a/x", "1"), ("/b/x", "1"), ("/b/c/d/x", "1")]]
    inv = exact.verify_content(inventory(rows), None)
    bottom_up, expanded = bottom_up_and_expanded(inv)
    assert bottom_up == expanded == {("/a", "/b/c/d"): (2, 1, 2, 1, 1)}
    assert folder_groups(trees.find_duplicate_folders(inv.limit(0))) == {}
    assert trees.equal_folders(inv.limit(0), ["length"]).count() == 0


def test_folders_of_two_roots_or_colliding_hashes_are_still_found(items, inventory, monkeypatch):
    files = [("/A/p/x", "1"), ("/A/p/y", "2"), ("/B/p/x", "1"), ("/B/p/y", "2"), ("/C/p/x", "2"), ("/C/p/y", "1"), ("/C/q", "3")]
    rows = [{"path": path, "content": content, "root": "/A/p" if path == "/A/p/y" else path[:2]} for path, content in files]
    inside = exact.verify_content(inventory(rows), None)  # y of /A/p is not below /A
    assert trees.folder_tree(inside) is None
    assert set(folder_groups(trees.find_duplicate_folders(inside))) == {("/A/p", "/B/p")}
    weak = lambda *elements: [F.lit(0).cast("long") + 0 * F.xxhash64(*elements).bitwiseAND(1) for _ in range(4)]
    monkeypatch.setattr(trees, "_fingerprints", weak)
    inv = items(files)
    assert trees._equal_trees(trees.folder_tree(inv), ["length", "content_key"]) is None
    assert set(folder_groups(trees.find_duplicate_folders(inv))) == {("/A", "/B")}


def test_no_file_is_repeated_for_the_folders_above_it(items):
    """What is written and shuffled of the files does not grow with their depth."""
    deep = "/".join("d" * 7)
    inv = items([(f"/{root}/{deep}/{n}", str(n)) for root in "AB" for n in range(20)])
    tree = trees.folder_tree(inv)
    assert tree.files.count() == 40 and tree.folders.count() == 2 * 8
    found = trees.find_duplicate_folders(inv)
    assert folder_groups(found) == {("/A", "/B"): (2, 20, 40, 30, 30)}


def test_wide_folders_and_common_classes(inventory, monkeypatch):
    """The entries of a folder above the bound stay where they are, those of a class above it are dealt to several tasks."""
    files = [{"path": f"/r/{n}/{name}", "length": n % 4} for n in range(60) for name in ("a", "b")]
    files += [{"path": f"/r/{top}/f{n}", "length": 1} for top in ("x", "y") for n in range(30)] + [{"path": "/r/z/f0", "length": 1}]
    items = inventory(files, root="/r")
    plain = sorted(map(tuple, trees.equal_folders(items, ["length"]).collect()))
    monkeypatch.setattr(trees, "TASK_ROWS", 10)
    monkeypatch.setattr(trees, "HOT_CLASS", 4)
    found = trees.equal_folders(items, ["length"])
    assert sorted(map(tuple, found.collect())) == plain and len(plain) == 62
    assert {tuple(r) for r in found.filter("folder IN ('/r/x', '/r/y', '/r/5')").collect()} == {("/r/x", "/r/x"), ("/r/y", "/r/x"), ("/r/5", "/r/1")}

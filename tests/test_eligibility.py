import pytest
from duploscope.operators import eligibility as e
from duploscope.operators import exact


def test_criteria_are_checked():
    assert e.Criteria(custom_extensions=(" blend ", ".BLEND", "*.bad", "folder/name")).custom_extensions == (".blend",)
    for wrong in ({"types": {"Poems"}}, {"min_bytes": -1}, {"min_bytes": 5, "max_bytes": 4}, {"max_bytes": -1}):
        with pytest.raises(ValueError):
            e.Criteria(**wrong)


def test_bounds_are_inclusive_and_custom_extensions_skip_only_the_type(spark):
    rows = [(".txt", 9), (".txt", 10), (".txt", 20), (".txt", 21), (".jpg", 15), (".blend", 15), (".blend", 9), (".tmp", 15)]
    df = spark.createDataFrame(rows, "extension string, length long")
    criteria = e.Criteria({"Documents"}, ("blend",), 10, 20)
    reasons = [r[0] for r in df.select(e.evaluate_criteria("extension", "length", criteria, ["tmp"])).collect()]
    assert reasons == ["BelowMinimumSize", None, None, "AboveMaximumSize", "FileTypeExcluded", None, "BelowMinimumSize", "ExtensionExcluded"]


def test_profiles():
    assert e.profile("large-files").min_bytes == 104857600
    assert e.profile("photos-videos").types == {"Images", "Video"}
    assert e.profile("nothing") is None
    policy = e.Policy(criteria=e.Criteria({"Documents"}, ("blend",), 5, 9), excluded_folders=("/x/", "/X"))
    images = e.image_policy(policy).criteria
    assert (images.types, images.custom_extensions, images.min_bytes, images.max_bytes) == ({"Images"}, (), 5, 9)
    assert policy.excluded_folders == ("/x",)


CORPUS = [
    ("top-original.txt", "top-copy.txt", 43), ("documents/invoice-original.txt", "documents/invoice-copy.txt", 43),
    ("photos/portrait-original.jpg", "nested/photos/portrait-copy.JPG", 35), ("custom/scene-original.blend", "custom/scene-copy.BLEND", 43),
    ("cache/scratch-original.tmp", "cache/scratch-copy.tmp", 42), ("excluded-folder/private-original.dat", "excluded-folder/private-copy.dat", 39),
    ("near-miss/same-size-a.bin", "near-miss/same-size-b.bin", 20),
]


@pytest.fixture(scope="module")
def corpus(inventory):
    files, folders = [], set()
    for pair, (left, right, length) in enumerate(CORPUS):
        for root, rel in (("/root-a", left), ("/root-b", right)):
            digest = rel if "near-miss" in rel else f"pair {pair}"
            files.append({"path": f"{root}/{rel}", "root": root, "length": length, "digest": digest})
            parts = rel.split("/")[:-1]
            folders |= {(root, "/".join(parts[: n + 1])) for n in range(len(parts))}
    entries = files + [
        {"path": f"{root}/{rel}", "root": root, "is_dir": True, "identity": (2, n, 0), "attributes": ["Directory"]}
        for n, (root, rel) in enumerate(sorted(folders))
    ]
    return inventory(entries)


def groups(split):
    return {(r["length"], r["members"]) for r in exact.find_exact_duplicates(split.accepted).groups.collect()}


def test_corpus(corpus):
    everything = e.split_eligible(corpus, e.Policy())
    assert everything.accepted.count() == 14 and everything.skipped.count() == 0
    assert len(exact.find_exact_duplicates(everything.accepted).groups.collect()) == 6
    small = e.Policy(criteria=e.Criteria({"Archives"}, ("tmp",), 42, 42))
    assert groups(e.split_eligible(corpus, small)) == {(42, 2)}
    flat = e.split_eligible(corpus, e.Policy(include_subfolders=False))
    assert groups(flat) == {(43, 2)}
    reasons = {(r["reason"], r["n"]) for r in e.skip_summary(flat.skipped).collect()}
    assert reasons == {("SubfolderExcluded", 12)}  # six direct subfolders per root; nested/photos goes with nested
    folders = ("/root-a/excluded-folder", "/ROOT-B/EXCLUDED-FOLDER/")
    without = e.split_eligible(corpus, e.Policy(excluded_folders=folders, excluded_extensions=("tmp",)))
    assert sorted(r["reason"] for r in without.skipped.collect()) == ["ExtensionExcluded"] * 2 + ["FolderExcluded"] * 2
    assert without.accepted.count() == 10


def test_rejections_in_order(inventory):
    rows = [
        {"path": "/r/a.txt", "attributes": ["ReparsePoint", "Hidden"]},
        {"path": "/r/b.txt", "identity": None},
        {"path": "/r/c.txt", "attributes": ["AlternateDataStream", "Hidden"]},
        {"path": "/r/d.txt", "attributes": ["Offline", "Hidden"]},
        {"path": "/r/e.txt", "attributes": ["Hidden", "System"]},
        {"path": "/r/f.txt", "attributes": ["System", "Encrypted"]},
        {"path": "/r/g.txt", "attributes": ["Encrypted"]},
        {"path": "/r/h.txt"},
        {"path": "/r/secret", "is_dir": True, "attributes": ["Directory", "Hidden"]},
        {"path": "/r/secret/in", "is_dir": True, "attributes": ["Directory"]},
        {"path": "/r/secret/in/i.txt", "attributes": ["Offline"]},
        {"path": "/r/secrets.txt"},
    ]
    split = e.split_eligible(inventory(rows), e.Policy())
    assert {(r["path"], r["reason"]) for r in split.skipped.collect()} == {
        ("/r/a.txt", "ReparsePoint"), ("/r/b.txt", "IdentityUnavailable"), ("/r/c.txt", "AlternateDataStream"), ("/r/d.txt", "Offline"),
        ("/r/e.txt", "HiddenByPolicy"), ("/r/f.txt", "SystemByPolicy"), ("/r/g.txt", "Encrypted"), ("/r/secret", "HiddenByPolicy"),
    }
    assert {r["path"] for r in split.accepted.collect()} == {"/r/h.txt", "/r/secrets.txt"}
    open_policy = e.Policy(include_hidden=True, include_system=True, include_encrypted=True)
    assert e.split_eligible(inventory(rows), open_policy).accepted.count() == 5


def test_folder_operators(inventory):
    inv = inventory([{"path": p} for p in ("/r/a.txt", "/r/x/b.txt", "/r/x/y/c.txt", "/r/xx/d.txt")])
    split = e.exclude_folders(inv, ["/r/x/y", "/R/X"])
    assert {r["path"] for r in split.accepted.collect()} == {"/r/a.txt", "/r/xx/d.txt"}
    assert [r["path"].upper() for r in split.skipped.collect()] == ["/R/X"]
    flat = e.include_subfolders(inv, False)
    assert {r["path"] for r in flat.accepted.collect()} == {"/r/a.txt"}
    assert {r["path"] for r in flat.skipped.collect()} == {"/r/x", "/r/xx"}
    assert e.include_subfolders(inv, True).accepted.count() == 4


def test_split_roots(spark):
    roots = ["/a", "/A/", "/a/b", "//host/share", "\\\\host\\s", "rel", "C:\\data", "\\\\?\\C:\\data\\x", " "]
    split = e.split_roots(spark.createDataFrame([(r,) for r in roots], "root string"))
    assert {r["root"].upper() for r in split.accepted.collect()} == {"/A", "C:\\DATA"}
    assert {r["reason"] for r in split.skipped.collect()} == {"NetworkLocation", "InvalidRoot"}

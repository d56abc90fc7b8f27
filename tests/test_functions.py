from datetime import datetime

import pytest
from duploscope.functions import formats, paths
from pyspark.sql import functions as F

MIB = 1024 * 1024


@pytest.mark.parametrize(
    "extension, kind",
    [(".PDF", "Documents"), (".JPEG", "Images"), (".flac", "Audio"), (".mkv", "Video"), (".7z", "Archives"),
     (".blend", "Other"), ("", "Other"), (None, "Other")],
)
def test_file_types(values, extension, kind):
    assert values([extension], paths.classify_file_type) == [kind]


def test_normalize_extension(values):
    given = [" blend ", ".BLEND", "*.bad", "folder/name", "", "  ", None, ".", "..", ".tar.gz", "a" * 31, "a" * 32, "a b", "x?", ". txt"]
    expected = [".blend", ".blend", None, None, None, None, None, None, None, None, "." + "a" * 31, None, ".a b", None, ". txt"]
    assert values(given, paths.normalize_extension) == expected


def test_path_parts(values):
    given = ["/a/b/c.tar.gz", "C:\\x\\y.TXT", "/top", "plain", "/a/b.d/none", "/a/dot."]
    assert values(given, paths.file_name) == ["c.tar.gz", "y.TXT", "top", "plain", "none", "dot."]
    assert values(given, paths.extension) == [".gz", ".TXT", "", "", "", ""]
    assert values(given, paths.containing_folder) == ["/a/b", "C:\\x", "/", "", "/a/b.d", "/a"]
    assert values(given, paths.path_depth) == [3, 2, 1, 0, 3, 2]
    assert values(["C:\\x\\y", "https://h.org/a/b", "/a", "rel/x"], paths.path_root) == ["C:\\", "https://h.org", "/", "rel/x"]


def test_relative_and_ancestors(values):
    assert values(["/r/a\\b/c.txt"], lambda v: paths.relative_path(F.lit("/r/"), v)) == ["a/b/c.txt"]
    assert values(["/r/a/b/c.txt", "/r/x", "/rr/x", "/r"], lambda v: paths.ancestors(v, F.lit("/r"))) == [
        ["/r", "/r/a", "/r/a/b"], ["/r"], [], []
    ]
    assert values(["/a/b/c"], lambda v: paths.ancestors(v, F.lit("/"))) == [["/", "/a", "/a/b"]]


def test_descendants_stop_at_separators(values):
    given = ["/a/b", "/A/B/c", "/a/b2", "/a/b\\c", "/a"]
    assert values(given, lambda v: paths.is_same_or_descendant(v, F.lit("/a/b"))) == [True, True, False, True, False]
    assert values(given, lambda v: paths.is_strict_descendant(v, F.lit("/a/b/"))) == [False, True, False, True, False]


def test_locations(values, spark):
    roots = ["/data", "/data/photos", "/other/"]
    given = ["/data/photos/x.jpg", "/DATA/y", "/data2/z", "/other/q"]
    assert values(given, lambda v: paths.resolve_location(v, roots)) == ["/data/photos", "/data", "/", "/other/"]
    assert values(given[:1], lambda v: paths.resolve_location(v, [])) == ["/"]
    items = spark.createDataFrame([(n, p) for n, p in enumerate(given)], "n int, path string")
    table = spark.createDataFrame([(root,) for root in roots], "root string")
    found = paths.resolve_location_by_table(items, table).orderBy("n").collect()
    assert [row["location"] for row in found] == ["/data/photos", "/data", "/", "/other/"]
    collapsed = {row[0] for row in paths.collapse_roots(table).collect()}
    assert collapsed == {"/data", "/other"}


def test_search(values):
    assert values(["Photo.JPG", "note.txt", None], lambda v: paths.search_match("photo", v)) == [True, False, False]
    assert values(["x", None], lambda v: paths.search_match("  ", v)) == [True, True]


def test_size_buckets(values):
    given = [0, MIB - 1, MIB, 10 * MIB, 100 * MIB, 1024 * MIB, 1024 * MIB + 1]
    expected = ["LessThan1Mb", "LessThan1Mb", "OneTo10Mb", "TenTo100Mb", "OneHundredMbTo1Gb", "OneHundredMbTo1Gb", "MoreThan1Gb"]
    assert values(given, formats.size_bucket, "long") == expected


def test_format_bytes(values):
    given = [-5, 0, 1023, 1024, 1280, 1536, 1048575, MIB, 5 * 1024**3, 3 * 1024**4, 5000 * 1024**4]
    expected = ["0 B", "0 B", "1,023 B", "1.0 KB", "1.3 KB", "1.5 KB", "1,024.0 KB", "1.0 MB", "5.0 GB", "3.0 TB", "5,000.0 TB"]
    assert values(given, formats.format_bytes, "long") == expected


def test_labels(values):
    assert values([datetime(2024, 1, 2, 3, 4, 5, 678901)], formats.iso_utc, "timestamp") == ["2024-01-02T03:04:05.6789010+00:00"]
    assert values(["VerySimilar", "LooselySimilar"], formats.tier_label) == ["Very similar", "Loosely similar"]
    got = values(["Recycled", "SkippedChanged", "Cancelled", "odd"], lambda v: formats.outcome_category(v)["tone"])
    assert got == ["Success", "Skipped", "Cancelled", "Failed"]
    assert values(["", None], lambda v: formats.content_digest(v)) == [
        "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", None
    ]
    assert values(["a", "b", None], lambda v: formats.content_equal(v, F.lit("a"))) == [True, False, None]

"""Paths, extensions and locations as column expressions.

Both `/` and `\\` separate path segments. Case-insensitive comparisons use upper case,
because that is the order the results are defined in.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Extension classes, and what an extension may look like: 1 to 31 characters after the dot.
FILE_TYPES: dict[str, tuple[str, ...]] = {
    "Documents": (".csv", ".doc", ".docm", ".docx", ".epub", ".log", ".md", ".ods", ".odt", ".pdf", ".ppt", ".pptm",
                  ".pptx", ".rtf", ".tex", ".txt", ".xls", ".xlsm", ".xlsx"),
    "Images": (".avif", ".bmp", ".cr2", ".dng", ".gif", ".heic", ".heif", ".ico", ".jpeg", ".jpg", ".nef", ".png",
               ".raw", ".svg", ".tif", ".tiff", ".webp"),
    "Audio": (".aac", ".aiff", ".alac", ".flac", ".m4a", ".mid", ".midi", ".mp3", ".ogg", ".opus", ".wav", ".wma"),
    "Video": (".3gp", ".avi", ".flv", ".m4v", ".mkv", ".mov", ".mp4", ".mpeg", ".mpg", ".mts", ".webm", ".wmv"),
    "Archives": (".7z", ".bz2", ".cab", ".gz", ".iso", ".rar", ".tar", ".tgz", ".xz", ".zip"),
}
OTHER_TYPE = "Other"
ALL_TYPES = (*FILE_TYPES, OTHER_TYPE)
REVIEW_TYPES = {"Images": "Photos", "Video": "Videos", "Audio": "Audio", "Documents": "Documents",
                "Archives": "Archives"}
EXTENSION_LENGTHS = (2, 32)
USABLE_EXTENSION = r'^\s*\.?([^\x00-\x1f"<>|:*?/\\.]{0,30}[^\x00-\x1f"<>|:*?/\\.\s])\s*$'


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def normalize_extension(value: Column | str) -> Column:
    """Trimmed, dotted, lower-case extension; null where the text is no usable extension."""
    # one reference to the value: nested conditions would copy it many times into the generated code
    body = F.lower(F.regexp_extract(_col(value), USABLE_EXTENSION, 1))
    return F.nullif(F.concat(F.lit("."), body), F.lit("."))


def classify_file_type(extension: Column | str) -> Column:
    """Documents, Images, Audio, Video, Archives or Other."""
    by_extension = {ext: F.lit(name) for name, extensions in FILE_TYPES.items() for ext in extensions}
    return F.coalesce(_lookup(by_extension, normalize_extension(extension)), F.lit(OTHER_TYPE))


def review_type(extension: Column | str) -> Column:
    """The label of the type filter: Photos, Videos, Audio, Documents, Archives or Other."""
    by_type = {name: F.lit(label) for name, label in REVIEW_TYPES.items()}
    return F.coalesce(_lookup(by_type, classify_file_type(extension)), F.lit(OTHER_TYPE))


def _lookup(values: dict[str, Column], key: Column) -> Column:
    pairs = [part for name, value in values.items() for part in (F.lit(name), value)]
    return F.create_map(*pairs)[key]


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/\\]*)$", 1)


def extension(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"(\.[^./\\]+)$", 1)


def containing_folder(path: Column | str) -> Column:
    path = _col(path)
    parent = F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)
    return F.when((parent == "") & path.rlike(r"^[/\\]."), F.substring(path, 1, 1)).otherwise(parent)


def path_root(path: Column | str) -> Column:
    """Drive, leading separator or scheme and host; the path itself where there is none."""
    path = _col(path)
    found = F.regexp_extract(path, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|[A-Za-z]:[/\\]?|[/\\])", 1)
    return F.when(found == "", path).otherwise(found)


def trim_separators(path: Column | str) -> Column:
    return F.rtrim(_col(path), F.lit("/\\"))


def unified(path: Column | str) -> Column:
    """The path with `/` between all segments."""
    return F.translate(_col(path), "\\", "/")


def relative_path(root: Column | str, path: Column | str) -> Column:
    """The part of the path below the root, separated by `/`."""
    below = F.substring(_col(path), F.length(trim_separators(root)) + 2, F.length(_col(path)))
    return unified(below)


def path_depth(path: Column | str) -> Column:
    return F.regexp_count(_col(path), F.lit(r"[/\\]"))


def is_strict_descendant(path: Column | str, root: Column | str) -> Column:
    """Whether the path lies below the root, cut at a separator: `a/b2` is not under `a/b`."""
    path = F.upper(_col(path))
    root = F.upper(trim_separators(root))
    return path.startswith(F.concat(root, F.lit("/"))) | path.startswith(F.concat(root, F.lit("\\")))


def is_same_or_descendant(path: Column | str, root: Column | str) -> Column:
    return (F.upper(_col(path)) == F.upper(_col(root))) | is_strict_descendant(path, root)


def ancestors(path: Column | str, root: Column | str) -> Column:
    """Every folder from the root down to the parent of the path; empty where the path is not below the root.

    Turns each "lies below" question into an equality join.
    """
    separators = lambda text: F.length(text) - F.length(F.replace(text, F.lit("/")))

    def walk(p: Column) -> Column:
        folder, top = p["path"], p["top"]
        # the text before the n-th separator; "/" itself stands before the first one
        cut = lambda n: F.call_function("substring_index", folder, F.lit("/"), n)
        above = F.transform(F.sequence(separators(top) + 1, separators(folder)), lambda n: F.coalesce(F.nullif(cut(n), F.lit("")), F.lit("/")))
        below = F.startswith(F.upper(folder), F.concat(F.upper(top), F.lit("/")))
        return F.when(below, above).otherwise(F.array().cast("array<string>"))

    pair = F.struct(unified(path).alias("path"), unified(trim_separators(root)).alias("top"))
    return F.transform(F.array(pair), walk)[0]


def under_any(path: Column | str, folders: Sequence[str]) -> Column:
    """Whether the path is, or lies below, one of the folders given as a parameter list."""
    hit = F.lit(False)
    for folder in folders:
        hit = hit | is_same_or_descendant(path, F.lit(folder))
    return hit


def resolve_location(path: Column | str, roots: Sequence[str]) -> Column:
    """The longest of the given roots that holds the path, else the root of the path itself."""
    path = _col(path)
    by_key = {root.rstrip("/\\").upper(): F.lit(root) for root in sorted(roots) if root.strip()}
    if not by_key:
        return path_root(path)
    longest_first = F.lit(sorted(by_key, key=len, reverse=True))

    def holds(key: Column, upper: Column) -> Column:
        below = upper.startswith(F.concat(key, F.lit("/"))) | upper.startswith(F.concat(key, F.lit("\\")))
        return (upper == key) | below

    found = F.transform(F.array(F.upper(path)), lambda upper: F.get(F.filter(longest_first, lambda key: holds(key, upper)), F.lit(0)))[0]
    return F.coalesce(_lookup(by_key, found), path_root(path))


def resolve_location_by_table(items: DataFrame, roots: DataFrame, name: str = "location") -> DataFrame:
    """`resolve_location` for roots in a table with column `root`.

    Works on the distinct folders of the items, so that the fan-out over ancestors is paid once per folder.
    """
    folders = items.select(containing_folder("path").alias("_folder")).distinct()
    walked = folders.select(
        "_folder",
        F.explode(F.array_append(ancestors("_folder", path_root("_folder")), F.col("_folder"))).alias("_above"),
    )
    known = roots.groupBy(F.upper(unified(trim_separators("root"))).alias("_key")).agg(F.min("root").alias("_root"))
    best = (
        walked.join(known, F.upper(unified("_above")) == F.col("_key"))
        .groupBy("_folder")
        .agg(F.max_by("_root", F.length("_root")).alias("_root"))
    )
    return (
        items.withColumn("_folder", containing_folder("path"))
        .join(best, "_folder", "left")
        .withColumn(name, F.coalesce("_root", path_root("path")))
        .drop("_folder", "_root")
    )


def collapse_roots(roots: DataFrame) -> DataFrame:
    """Distinct roots without those that lie below another root."""
    distinct = (
        roots.filter(F.trim("root") != "")
        .select(trim_separators("root").alias("root"))
        .groupBy(F.upper(unified("root")).alias("_key"))
        .agg(F.min("root").alias("root"))
    )
    walked = distinct.select("_key", F.explode(ancestors("_key", path_root("_key"))).alias("_above"))
    nested = walked.join(distinct.select(F.col("_key").alias("_above")), "_above", "left_semi").select("_key")
    return distinct.join(nested, "_key", "left_anti").select("root")


def search_match(text: str | None, *columns: Column | str) -> Column:
    """Case-insensitive "contains" over the columns; a blank search matches everything."""
    if not text or not text.strip():
        return F.lit(True)
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.contains(F.upper(_col(column)), F.lit(text.upper())), F.lit(False))
    return hit

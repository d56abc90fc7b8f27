"""Which entries are taken in, and the reason for every one that is not."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duploscope.functions import paths
from duploscope.session import materialize


def _normalized(values: Sequence[str]) -> tuple[str, ...]:
    """Usable extensions of a parameter list: trimmed, dotted, lower-case, distinct, sorted."""
    kept = set()
    for value in values:
        text = value.strip().lower()
        dotted = text if text.startswith(".") else "." + text
        shortest, longest = paths.EXTENSION_LENGTHS
        forbidden = set('"<>|:*?/\\') | {chr(code) for code in range(32)}
        if text and shortest <= len(dotted) <= longest and "." not in dotted[1:] and not forbidden & set(dotted):
            kept.add(dotted)
    return tuple(sorted(kept))


@dataclass(frozen=True)
class Criteria:
    """Accepted types, extra extensions and inclusive size bounds."""

    types: frozenset[str] = frozenset(paths.ALL_TYPES)
    custom_extensions: tuple[str, ...] = ()
    min_bytes: int = 0
    max_bytes: int | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "types", frozenset(self.types))
        unknown = self.types - set(paths.ALL_TYPES)
        if unknown:
            raise ValueError(f"unknown types: {sorted(unknown)}")
        if self.min_bytes < 0:
            raise ValueError("min_bytes is negative")
        if self.max_bytes is not None and self.max_bytes < self.min_bytes:
            raise ValueError("max_bytes is below min_bytes")
        object.__setattr__(self, "custom_extensions", _normalized(self.custom_extensions))


# Built-in profiles.
PROFILES: dict[str, Criteria] = {
    "all-files": Criteria(),
    "large-files": Criteria(min_bytes=100 * 1024 * 1024),
    "photos-videos": Criteria(types=frozenset({"Images", "Video"})),
    "documents": Criteria(types=frozenset({"Documents"})),
    "music": Criteria(types=frozenset({"Audio"})),
}


def profile(name: str) -> Criteria | None:
    return PROFILES.get(name)


@dataclass(frozen=True)
class Policy:
    include_hidden: bool = False
    include_system: bool = False
    include_encrypted: bool = False
    include_subfolders: bool = True
    criteria: Criteria = Criteria()
    excluded_folders: tuple[str, ...] = ()
    excluded_extensions: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        folders = {folder.rstrip("/\\").upper(): folder.rstrip("/\\") for folder in reversed(self.excluded_folders) if folder.strip()}
        object.__setattr__(self, "excluded_folders", tuple(sorted(folders.values())))
        object.__setattr__(self, "excluded_extensions", _normalized(self.excluded_extensions))


def image_policy(policy: Policy) -> Policy:
    """The same policy for images only: bounds and exclusions stay, custom extensions go."""
    return replace(policy, criteria=replace(policy.criteria, types=frozenset({"Images"}), custom_extensions=()))


def evaluate_criteria(
    extension: Column | str, length: Column | str, criteria: Criteria, excluded_extensions: Sequence[str] = ()
) -> Column:
    """The first reason to reject, or null. An accepted custom extension skips only the type check."""
    known = F.coalesce(paths.normalize_extension(extension), F.lit(""))
    length = F.col(length) if isinstance(length, str) else length
    checks = []
    excluded = _normalized(excluded_extensions)
    if excluded:
        checks.append(F.when(known.isin(*excluded), F.lit("ExtensionExcluded")))
    checks.append(F.when(length < criteria.min_bytes, F.lit("BelowMinimumSize")))
    if criteria.max_bytes is not None:
        checks.append(F.when(length > criteria.max_bytes, F.lit("AboveMaximumSize")))
    if criteria.types != frozenset(paths.ALL_TYPES):
        accepted = paths.classify_file_type(extension).isin(*sorted(criteria.types)) if criteria.types else F.lit(False)
        if criteria.custom_extensions:
            accepted = accepted | known.isin(*criteria.custom_extensions)
        checks.append(F.when(~accepted, F.lit("FileTypeExcluded")))
    return F.coalesce(*checks)


def attribute_policy(attributes: Column | str, policy: Policy) -> Column:
    """Offline entries are always rejected; hidden, system and encrypted ones by switch, in this order."""
    attributes = F.col(attributes) if isinstance(attributes, str) else attributes
    checks = [F.when(F.array_contains(attributes, "Offline"), F.lit("Offline"))]
    for flag, included, reason in (
        ("Hidden", policy.include_hidden, "HiddenByPolicy"),
        ("System", policy.include_system, "SystemByPolicy"),
        ("Encrypted", policy.include_encrypted, "Encrypted"),
    ):
        if not included:
            checks.append(F.when(F.array_contains(attributes, flag), F.lit(reason)))
    return F.coalesce(*checks)


class Split(NamedTuple):
    accepted: DataFrame
    skipped: DataFrame


def exclude_folders(inv: DataFrame, folders: Sequence[str]) -> Split:
    """Drop folders with everything under them; only the topmost excluded folder is reported."""
    folders = Policy(excluded_folders=tuple(folders)).excluded_folders
    under = paths.under_any("path", folders)
    topmost = F.coalesce(
        *[F.when(paths.is_same_or_descendant("path", F.lit(folder)), F.lit(folder)) for folder in sorted(folders, key=len)],
        F.lit(None).cast("string"),
    )
    reported = inv.filter(under).select(topmost.alias("path")).distinct()
    return Split(inv.filter(~under), reported.select("path", F.lit("FolderExcluded").alias("reason")))


def include_subfolders(inv: DataFrame, include: bool) -> Split:
    """Without subfolders only direct children of a root stay and each direct subfolder is reported once."""
    direct = F.upper(paths.containing_folder("path")) == F.upper(paths.trim_separators("root"))
    if include:
        direct = F.lit(True)
    first_below = F.concat(
        paths.trim_separators("root"),
        F.lit("/"),
        F.regexp_extract(paths.relative_path("root", "path"), r"^([^/]*)", 1),
    )
    skipped = inv.filter(~direct).select(first_below.alias("path")).distinct()
    return Split(inv.filter(direct), skipped.select("path", F.lit("SubfolderExcluded").alias("reason")))


# Attributes of entries that are never opened, which are their reasons as well.
UNREAD = ("ReparsePoint", "Inaccessible", "UnstableOrDisappeared", "IdentityUnavailable")


def plain_file() -> Column:
    """Whether an entry of an inventory is a file that may be opened: no folder, no link, nothing that failed when it was listed."""
    return ~(F.coalesce("is_dir", F.lit(False)) | F.coalesce(F.arrays_overlap("attributes", F.array(*map(F.lit, UNREAD))), F.lit(False)))


def entry_reason(policy: Policy) -> Column:
    """Why an entry is rejected on its own account, or null."""
    link = F.coalesce(*[F.when(F.array_contains("attributes", name), F.lit(name)) for name in UNREAD])
    by_attribute = attribute_policy("attributes", policy)
    of_folder = F.coalesce(
        link,
        F.when(paths.under_any("path", policy.excluded_folders), F.lit("FolderExcluded")),
        by_attribute,
        F.when(F.lit(not policy.include_subfolders), F.lit("SubfolderExcluded")),
    )
    of_file = F.coalesce(
        link,
        F.when(F.col("identity").isNull(), F.lit("IdentityUnavailable")),
        F.when(F.array_contains("attributes", "AlternateDataStream"), F.lit("AlternateDataStream")),
        by_attribute,
        evaluate_criteria("extension", "length", policy.criteria, policy.excluded_extensions),
    )
    return F.when(F.col("is_dir"), of_folder).otherwise(of_file)


def split_eligible(entries: DataFrame, policy: Policy) -> Split:
    """Accepted files, and (path, reason) of the rejected entries.

    A rejected folder takes everything under it out without further reports. That is decided on the
    distinct folders, not on the files: only folders fan out over their ancestors.
    """
    # read four times below, so written once
    judged = materialize(
        entries.withColumn("reason", entry_reason(policy)).withColumn("_folder", paths.containing_folder("path"))
    )
    rejected = judged.filter("is_dir and reason is not null").select(F.upper(paths.unified("path")).alias("_above"))
    # a folder counts itself among those that can take it out
    folders = judged.select("_folder", "root").distinct()
    walked = folders.select(
        "_folder",
        F.explode(F.array_append(paths.ancestors("_folder", "root"), F.col("_folder"))).alias("_above"),
    ).withColumn("_above", F.upper(paths.unified("_above")))
    blocked = walked.join(rejected, "_above", "left_semi").select("_folder").distinct()
    visible = judged.join(blocked, "_folder", "left_anti").drop("_folder")
    return Split(
        visible.filter("not is_dir and reason is null").drop("reason"),
        visible.filter("reason is not null").select("path", "reason"),
    )


def split_roots(roots: DataFrame) -> Split:
    """Usable roots, and those that are no absolute path or lie on a network share."""
    # an extended-length prefix on a local path is only a way to write it
    roots = roots.withColumn("root", F.regexp_replace("root", r"^\\\\\?\\(?i:(?!UNC\\))", ""))
    root = F.col("root")
    reason = (
        F.when(root.rlike(r"^(\\\\|//)"), "NetworkLocation")
        .when(root.contains("\x00") | ~root.rlike(r"^(/|[A-Za-z]:[/\\])"), "InvalidRoot")
    )
    judged = roots.filter(F.trim("root") != "").withColumn("reason", reason)
    accepted = paths.collapse_roots(judged.filter("reason is null").select("root"))
    return Split(accepted, judged.filter("reason is not null").select(root.alias("path"), "reason"))


def skip_summary(skipped: DataFrame) -> DataFrame:
    return skipped.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))

"""Duplicate folders: every folder is the set of (relative path, length, content) below it.

A folder may hold a third of all files, so no folder is collected. Folders meet by an order-free
fingerprint of their set, and the match is then proved entry by entry with an equality join. In a tree,
an entry is a file or a folder directly inside, and fingerprints rise level by level: a file counts once,
however deep it lies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duploscope.functions import paths
from duploscope.session import materialize

FOLDER_SORTS = {"reclaimable": "reclaimable", "size": "total_bytes", "count": "logical_files", "path": None}


def expand_folders(items: DataFrame, recursive: bool = True) -> DataFrame:
    """Each item once per folder above it up to its root, with `folder` and `relative`.

    Not recursive: only the root as a folder, still with all items below it.
    """
    folders = paths.ancestors("path", "root") if recursive else F.array(paths.trim_separators("root"))
    return items.withColumn("folder", F.explode(folders)).withColumn("relative", paths.relative_path("folder", "path"))


def merge_spellings(folder_files: DataFrame) -> DataFrame:
    """Folders whose paths differ only by case are one folder, named by the spelling that comes first; relative paths keep their case."""
    spelled = folder_files.select("folder").distinct().groupBy(F.upper("folder").alias("_key"))
    several = spelled.agg(F.min("folder").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    several = materialize(several.select("_key", "_first"))
    if several.isEmpty():
        return folder_files
    named = folder_files.join(several, F.upper("folder") == F.col("_key"), "left")
    return named.withColumn("folder", F.coalesce("_first", "folder")).drop("_key", "_first")


def folder_metrics(folder_files: DataFrame) -> DataFrame:
    """Per folder: logical files and bytes, and the same over distinct identities."""
    by_identity = folder_files.groupBy("folder", "identity").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("length").alias("_bytes"), F.min("length").alias("_one")
    )
    return by_identity.groupBy("folder").agg(
        F.sum("_n").alias("logical_files"),
        F.count(F.lit(1)).alias("distinct_identities"),
        F.sum("_bytes").alias("total_bytes"),
        F.sum("_one").alias("distinct_bytes"),
    )


def _fingerprints(*elements: str | Column) -> list[Column]:
    """Four 64-bit hashes of a row, to be combined by `bit_xor`."""
    return [F.xxhash64(F.lit(seed), *elements) for seed in range(4)]


SHAPE = ["_n", "_h0", "_h1", "_h2", "_h3"]
LEVELS_AT_ONCE = 4
TASK_ROWS = 500_000  # entries that a task of a join holds: their number grows with the entries, not what a task needs
HOT_CLASS = 100_000  # folders of a class whose entries stay together


def _all_known(values: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(value).isNotNull() for value in values])


def _equal_sets(folder_files: DataFrame, values: Sequence[str]) -> DataFrame:
    """(folder, first_folder) of the folders whose sets of (relative, *values) are equal, proved file by file.

    Four 64-bit sums without carry find the candidates; they combine before the shuffle. Then each
    file of a folder must find its equal in the first folder of the class. Folders that fail, which
    takes a hash collision, are compared among themselves again.
    """
    elements = ["relative", *values]
    hashes = [F.bit_xor(value).alias(name) for name, value in zip(SHAPE[1:], _fingerprints(*elements))]
    signatures = (
        folder_files.groupBy("folder")
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(_all_known(values)).alias("_read"), *hashes)
        .filter("_n = _read")
    )
    shape = SHAPE
    open_folders = materialize(signatures)
    held = None  # files of the folders that have a candidate, written once for all rounds
    proved = []
    while True:
        classes = (
            open_folders.groupBy(*shape)
            .agg(F.count(F.lit(1)).alias("_folders"), F.min("folder").alias("first_folder"))
            .filter("_folders > 1")
        )
        members = materialize(open_folders.join(classes, shape))
        firsts = members.filter("folder = first_folder").select("folder", "first_folder")
        others = members.filter("folder <> first_folder").select("folder", "first_folder", "_n")
        if held is None:
            files = folder_files.select("folder", *elements)
            held = materialize(files.join(members.select("folder"), "folder", "left_semi"))
        theirs = held.join(others, "folder")
        wanted = held.withColumnRenamed("folder", "first_folder").join(
            firsts.select("first_folder"), "first_folder", "left_semi"
        )
        matched = (
            theirs.join(wanted, ["first_folder", *elements], "left_semi")
            .groupBy("folder", "first_folder", "_n")
            .agg(F.count(F.lit(1)).alias("_matched"))
            .filter("_matched = _n")
            .select("folder", "first_folder")
        )
        matched = materialize(matched)
        proved.append(matched)
        proved.append(firsts.join(matched.select("first_folder").distinct(), "first_folder", "left_semi").select("folder", "first_folder"))
        rest = others.select("folder").join(matched, "folder", "left_anti")
        if rest.isEmpty():
            return reduce(DataFrame.unionByName, proved)
        open_folders = materialize(open_folders.join(rest, "folder", "left_semi"))


def structural_candidates(folder_files: DataFrame) -> DataFrame:
    """(folder, first_folder) of folders with the same relative paths and lengths."""
    return _equal_sets(folder_files, ["length"])


class Tree(NamedTuple):
    """Items and folders, each with the folder directly above it."""

    files: DataFrame  # the items, with `folder` and `name`
    folders: DataFrame  # folder, its root, parent and name (null for a root), and level below the root


def _folder_of(path: Column) -> Column:
    """The folder that directly holds a path with `/` between its segments."""
    return F.coalesce(F.nullif(F.regexp_replace(path, "/[^/]*$", ""), F.lit("")), F.lit("/"))


def _last(path: Column) -> Column:
    return F.call_function("substring_index", path, F.lit("/"), F.lit(-1))


def folder_tree(items: DataFrame) -> Tree | None:
    """The items below their folders, as written tables; None where a folder has two spellings or lies below two roots, because such a
    folder is the union of several nodes."""
    path, top = paths.unified("path"), paths.unified(paths.trim_separators("root"))
    carried = [name for name in ("identity", "length", "content_key") if name in items.columns]
    below = F.startswith(F.upper(path), F.concat(F.upper(top), F.lit("/")))
    files = items.filter(below).select(_folder_of(path).alias("folder"), _last(path).alias("name"), top.alias("root"), *carried)
    files = materialize(files)
    chain = F.array_distinct(F.array_append(paths.ancestors("folder", "root"), F.col("folder")))
    steps = files.select("folder", "root").distinct().select("root", F.posexplode(chain).alias("level", "folder")).distinct()
    inner = lambda value: F.when(F.col("level") > 0, value)
    folders = steps.select("folder", "root", "level", inner(_folder_of(F.col("folder"))).alias("parent"), inner(_last(F.col("folder"))).alias("name"))
    folders = materialize(folders)
    if not folders.groupBy(F.upper("folder")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty():
        return None
    return Tree(files.drop("root"), folders)


def _signatures(tree: Tree, values: Sequence[str]) -> DataFrame:
    """(folder, parent, name, shape) of the folders all of whose files are known, from the deepest level upwards.

    A folder's shape is made of its files and of the shapes of the folders inside, so that a level reads only the level below it.
    """
    combined = lambda hashes: [F.bit_xor(value).alias(name) for name, value in zip(SHAPE[1:], hashes)]
    own = tree.files.groupBy("folder").agg(
        F.count(F.lit(1)).alias("_n"), F.every(_all_known(values)).alias("_known"), *combined(_fingerprints("name", *values))
    )
    places = tree.folders.select("folder", "parent", "name", "level")
    own = materialize(places.join(own, "folder", "left"))
    levels = own.agg(F.min("level").alias("top"), F.max("level").alias("deepest")).first()
    if levels["top"] is None:
        return own.drop("level", "_known")
    done, pending, inside = [], [], None
    for level in range(levels["deepest"], levels["top"] - 1, -1):
        here = own.filter(F.col("level") == level)
        if inside is not None:
            entries = inside.filter("parent IS NOT NULL").select(
                F.col("parent").alias("folder"), "_known",
                *[value.alias(name) for name, value in zip(SHAPE[1:], _fingerprints(F.lit("/"), "name", *SHAPE))],
            )
            entries = entries.groupBy("folder").agg(
                F.count(F.lit(1)).alias("_n"), F.every("_known").alias("_known"), *combined(F.col(name) for name in SHAPE[1:])
            )
            below = entries.withColumnsRenamed({name: f"_of{name}" for name in ("_known", *SHAPE)})
            here = here.join(below, "folder", "left").select(
                "folder", "parent", "name",
                (F.coalesce("_n", F.lit(0)) + F.coalesce("_of_n", F.lit(0))).alias("_n"),
                (F.coalesce("_known", F.lit(True)) & F.coalesce("_of_known", F.lit(True))).alias("_known"),
                *[F.coalesce(name, F.lit(0)).bitwiseXOR(F.coalesce(f"_of{name}", F.lit(0))).alias(name) for name in SHAPE[1:]],
            )
        inside = here.select("folder", "parent", "name", "_known", *SHAPE, F.lit(level).alias("level"))
        pending.append(inside)
        if len(pending) == LEVELS_AT_ONCE or level == levels["top"]:  # a plan does not grow with the depth of the tree
            done.append(materialize(reduce(DataFrame.unionByName, pending)))
            pending, inside = [], done[-1].filter(F.col("level") == level)
    return reduce(DataFrame.unionByName, done).filter("_known").drop("_known", "level")


def _classed(signatures: DataFrame, classes: DataFrame) -> DataFrame:
    """Folders with the class of their shape. Classes of very many folders, of which there are few, come to the folders, so that these do not meet in one task."""
    hot = F.broadcast(classes.filter(F.col("_folders") > HOT_CLASS))
    common = signatures.join(hot, SHAPE)
    others = signatures.join(hot, SHAPE, "left_anti").join(classes.filter(F.col("_folders") <= HOT_CLASS), SHAPE)
    columns = ["folder", "parent", "name", "first_folder", "_n", "_folders"]
    return common.select(columns).unionByName(others.select(columns))


def _equal_trees(tree: Tree, values: Sequence[str]) -> DataFrame | None:
    """(folder, first_folder) of the folders whose sets of (relative path, *values) are equal; None if hashes collided.

    Each entry of a folder must be in the first folder of its class: a file with equal name and values, a folder with equal name whose
    class is the same. Where that holds for all folders, it holds for what is inside them as well, from the deepest upwards.
    """
    signatures = _signatures(tree, values)
    classes = signatures.groupBy(*SHAPE).agg(F.count(F.lit(1)).alias("_folders"), F.min("folder").alias("first_folder"))
    members = materialize(_classed(signatures, materialize(classes.filter("_folders > 1"))))
    blank = [F.lit(-1).cast(tree.files.schema[value].dataType).alias(value) for value in values]
    inside = members.select(F.col("parent").alias("folder"), "name", *blank, F.col("first_folder").alias("_class"))
    entries = tree.files.select("folder", "name", *values, F.lit("").alias("_class")).unionByName(inside)
    element = ["name", *values, "_class"]
    sizes = materialize(entries.groupBy("folder").agg(F.count(F.lit(1)).alias("_entries")))
    parts = max(1, math.ceil((sizes.agg(F.sum("_entries")).first()[0] or 0) / TASK_ROWS))
    wide = F.broadcast(sizes.filter(F.col("_entries") > TASK_ROWS).select("folder"))  # few folders, whose entries stay where they are
    holders = members.select("folder", "first_folder", "_n", "_folders")
    narrow = entries.join(wide, "folder", "left_anti").repartition(parts, "folder").join(holders.repartition(parts, "folder"), "folder")
    held = narrow.unionByName(entries.join(F.broadcast(holders.join(wide, "folder")), "folder"))
    # the entries of a class that many folders share are dealt to several tasks, each with those of the first folder
    shares = F.ceil(F.col("_folders") / HOT_CLASS).cast("int")
    held = materialize(held.withColumn("_shares", shares).drop("_folders"))
    every = F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share")
    wanted = held.filter("folder = first_folder").select("first_folder", *element, every)
    others = held.filter("folder <> first_folder").withColumn("_share", F.pmod(F.xxhash64("folder"), F.col("_shares")).cast("int"))
    key = ["first_folder", *element, "_share"]
    matched = others.repartition(parts, *key).join(wanted.repartition(parts, *key), key, "left_semi")
    matched = matched.groupBy("folder", "_n").agg(F.count(F.lit(1)).alias("_matched"))
    unequal = members.filter("folder <> first_folder").join(matched.filter("_matched = _n"), "folder", "left_anti")
    if not unequal.isEmpty():
        return None
    return members.select("folder", "first_folder")


def equal_folders(items: DataFrame, values: Sequence[str]) -> DataFrame:
    """(folder, first_folder) of the folders below the items' roots that agree in relative paths and `values`, length or content_key.

    Folders of one spelling and one root, which is what a listing gives, are compared bottom-up; otherwise, and should hashes ever
    collide, every file is set against each folder above it.
    """
    tree = folder_tree(items)
    found = _equal_trees(tree, values) if tree else None
    return found if found is not None else _equal_sets(merge_spellings(expand_folders(items)), values)


class FolderGroups(NamedTuple):
    groups: DataFrame
    members: DataFrame


def verified_folder_groups(folder_files: DataFrame) -> FolderGroups:
    """Folders whose files agree in relative path, length and proved content.

    `folder_files` comes from `expand_folders` over items with a `content_key`. A folder with an
    unreadable file is never a duplicate. A group is named by its first folder, the retained one.
    """
    members = materialize(_equal_sets(folder_files, ["length", "content_key"]).withColumnRenamed("first_folder", "group_folder"))
    return FolderGroups(folder_group_metrics(members, folder_files), members)


def tree_groups(items: DataFrame, outermost: bool = False) -> FolderGroups:
    """`verified_folder_groups` of items with a `content_key`, bottom-up; only `outermost` ones if so asked.

    For the figures, which count identities, a file meets only the member folders above it.
    """
    tree = folder_tree(items)
    found = _equal_trees(tree, ["length", "content_key"]) if tree else None
    if found is None:
        groups = verified_folder_groups(merge_spellings(expand_folders(items)))
        return suppress_nested_groups(groups) if outermost else groups
    members = found.withColumnRenamed("first_folder", "group_folder")
    if outermost:
        members = members.join(_nested(members), "group_folder", "left_anti")
    above = F.array_distinct(F.array_append(paths.ancestors("folder", "root"), F.col("folder")))
    reached = tree.folders.select("folder", F.explode(above).alias("_member"))
    reached = reached.join(members.select(F.col("folder").alias("_member")), "_member")
    located = tree.files.select("folder", "identity", "length").join(reached, "folder").drop("folder").withColumnRenamed("_member", "folder")
    return FolderGroups(folder_group_metrics(members, located), members)


def folder_group_metrics(members: DataFrame, folder_files: DataFrame) -> DataFrame:
    """Per group: folders, files and bytes of the retained folder, distinct identities, and the bytes of
    those identities that the retained folder does not hold."""
    files = folder_files.select("folder", "identity", "length").join(members, "folder")
    retained = F.col("folder") == F.col("group_folder")
    by_identity = files.groupBy("group_folder", "identity").agg(
        F.bool_or(retained).alias("_kept"),
        F.count_if(retained).alias("_files"),
        F.coalesce(F.sum(F.when(retained, F.col("length"))), F.lit(0)).alias("_bytes"),
        F.min("length").alias("_one"),
    )
    metrics = by_identity.groupBy("group_folder").agg(
        F.sum("_files").alias("logical_files"),
        F.count(F.lit(1)).alias("distinct_identities"),
        F.sum("_bytes").alias("total_bytes"),
        F.coalesce(F.sum(F.when(~F.col("_kept"), F.col("_one"))), F.lit(0)).alias("reclaimable"),
    )
    folders = members.groupBy("group_folder").agg(F.count(F.lit(1)).alias("folders"))
    return folders.join(metrics, "group_folder")


def _nested(members: DataFrame) -> DataFrame:
    """Groups all of whose folders lie below folders of one other group.

    A folder is in one group only, so each ancestor meets at most one row. The relation is transitive,
    so dropping against all groups equals dropping against those that stay.
    """
    above = members.select(
        "group_folder", "folder", F.explode(paths.ancestors(F.upper("folder"), paths.path_root(F.upper("folder")))).alias("_above")
    )
    owners = members.select(F.upper("folder").alias("_above"), F.col("group_folder").alias("_parent"))
    covered = (
        above.join(owners, "_above")
        .filter("_parent <> group_folder")
        .select("group_folder", "_parent", "folder")
        .distinct()
        .groupBy("group_folder", "_parent")
        .agg(F.count(F.lit(1)).alias("_covered"))
    )
    sizes = members.groupBy("group_folder").agg(F.count(F.lit(1)).alias("folders"))
    return covered.join(sizes, "group_folder").filter("_covered = folders").select("group_folder").distinct()


def suppress_nested_groups(found: FolderGroups) -> FolderGroups:
    """Drop a group when one other group has a folder strictly above each of its folders."""
    nested = _nested(found.members)
    return FolderGroups(
        found.groups.join(nested, "group_folder", "left_anti"), found.members.join(nested, "group_folder", "left_anti")
    )


def find_duplicate_folders(items: DataFrame, recursive: bool = True, skipped: DataFrame | None = None) -> FolderGroups:
    """Groups of equal folders, without those inside larger equal folders.

    Optional boolean columns compare_failed and validate_failed tell of files whose content could not be compared, or that changed
    before the end: like an unreadable file, such a one takes its folders out. So does every item of `skipped` (item_id, path), what
    `find_exact_duplicates` could not judge.
    """
    if skipped is not None:
        lost = skipped.select("item_id", "path").distinct().withColumn("_lost", F.lit(True))
        known = F.when(F.col("_lost").isNull(), F.col("content_key"))
        items = items.join(lost, ["item_id", "path"], "left").withColumn("content_key", known).drop("_lost")
    for flag in ("compare_failed", "validate_failed"):
        if flag in items.columns:
            items = items.withColumn("content_key", F.when(~F.coalesce(flag, F.lit(False)), F.col("content_key")))
    if recursive:
        return tree_groups(items, outermost=True)
    return suppress_nested_groups(verified_folder_groups(merge_spellings(expand_folders(items, recursive))))


def folder_results(found: FolderGroups) -> DataFrame:
    """One row per member folder with the figures of its group."""
    return found.members.join(found.groups, "group_folder")


def folder_order(sort: str = "reclaimable") -> list[Column]:
    key = FOLDER_SORTS[sort]
    return [F.col("folder")] if key is None else [F.col(key).desc(), F.col("folder")]


def filter_folder_results(
    results: DataFrame, min_files: int = 0, search: str | None = None, sort: str = "reclaimable"
) -> DataFrame:
    """Member folders with enough files and matching text; largest first, or by path."""
    kept = results.filter((F.col("logical_files") >= min_files) & paths.search_match((search or "").strip(), "folder"))
    return kept.orderBy(*folder_order(sort))

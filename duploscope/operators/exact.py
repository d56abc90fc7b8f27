"""Exact duplicates: by size and SHA-256, proved on the bytes.

Rows travel as (id, path, length, digest). Only items of repeated lengths are read; content is read where it lies and
crosses the network only for items whose digest occurs more than once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from duploscope.functions import ranking
from duploscope.operators.eligibility import plain_file
from duploscope.session import materialize


def path_order(path: str = "path") -> list[Column]:
    """Case-insensitive path order, made total by the path itself."""
    return [F.upper(path), F.col(path)]


def dedupe_identity(inv: DataFrame) -> DataFrame:
    """One row per physical identity, the first by path: aliases of one item are not copies."""
    row = F.struct(*inv.columns)
    first = F.min_by(row, F.struct(*path_order(), F.col("item_id")))
    alone = F.when(F.col("identity").isNull(), F.col("item_id"))  # an unknown identity is nobody's alias
    return inv.groupBy(F.col("identity").alias("_identity"), alone.alias("_alone")).agg(first.alias("_row")).select("_row.*")


def size_candidates(inv: DataFrame) -> DataFrame:
    """Rows whose length occurs at least twice, empty items included."""
    lengths = inv.groupBy("length").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("length")
    return inv.join(lengths, "length", "left_semi")


def digest_buckets(candidates: DataFrame) -> DataFrame:
    """(length, digest) pairs that occur at least twice."""
    return (
        candidates.filter("digest is not null")
        .groupBy("length", "digest")
        .agg(F.count(F.lit(1)).alias("members"))
        .filter("members > 1")
    )


def _only_bucket_content(content: DataFrame, buckets: DataFrame) -> DataFrame:
    """Content rows of the buckets.

    `buckets` is a written table: Spark knows its bytes and broadcasts it below its threshold, which keeps
    other content from being shuffled at all. Above it, both sides are shuffled by key.
    """
    return content.join(buckets.select("length", "digest"), ["length", "digest"], "left_semi")


Reader = Callable[[DataFrame], DataFrame]


def verify_content(rows: DataFrame, content: DataFrame | Reader | None) -> DataFrame:
    """Add `content_key`: within one length, two rows have equal keys if and only if their bytes are equal.

    `rows` holds item_id, length, digest; `content` holds item_id, length, digest, content, and where items come in
    several pieces also their number `chunk`; or it is a function that reads these for rows whose digest repeats. Copies
    collapse while they are scanned, so a bucket with a third of all rows moves one content per task.
    Where one digest has several contents, each content gets its own key.
    """
    if content is None:
        return rows.withColumn("content_key", F.col("digest"))
    buckets = materialize(digest_buckets(rows))
    if buckets.isEmpty():
        return rows.withColumn("content_key", F.col("digest"))
    if not isinstance(content, DataFrame):
        content = content(rows.join(buckets.select("length", "digest"), ["length", "digest"], "left_semi"))
    if "chunk" not in content.columns:
        content = content.withColumn("chunk", F.lit(0))
    piece = ["length", "digest", "chunk"]
    contents = _only_bucket_content(content, buckets).select(*piece, "content").distinct()
    collided = (
        contents.groupBy(*piece).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("length", "digest").distinct()
    )
    if collided.isEmpty():
        return rows.withColumn("content_key", F.col("digest"))
    # Only contents whose digests collide get here.
    collided = materialize(collided)
    open_content = _only_bucket_content(content, collided)
    named = (
        open_content.groupBy(*piece, "content")
        .agg(F.min("item_id").alias("_name"))
        .select(*piece, "content", "_name")
    )
    names = F.array_sort(F.collect_list(F.struct("chunk", "_name")))  # one for each piece of an item
    variants = (
        open_content.join(named, [*piece, "content"])
        .groupBy("item_id", "length", "digest")
        .agg(F.array_join(F.transform(names, lambda part: part["_name"].cast("string")), ".").alias("_name"))
    )
    return (
        rows.join(variants, ["item_id", "length", "digest"], "left")
        .withColumn("content_key", F.concat_ws("#", "digest", F.col("_name").cast("string")))
        .withColumn("content_key", F.when(F.col("digest").isNotNull(), F.col("content_key")))
        .drop("_name")
    )


class Proof(NamedTuple):
    """How the equality of items is proved where they lie."""

    compare: Reader  # of items with `first`, one of equal digest: adds state, failure and first_failure; see `files.compare_files`
    validate: Reader  # of items: (item_id, path, failure) of those that are not as they were; see `files.validate_files`


def prove_pairs(rows: DataFrame, compare: Reader) -> DataFrame:
    """Add `content_key`, as `verify_content` does, and, unless all items are equal to the first of their digest, `read_failure`: why an item
    could not be compared.

    Every item of a repeated digest is compared with the first of its bucket by path, in the task of the pair; no content is shuffled. Items
    that differ from the first are compared with the first of them, and so on; so are those whose first could not be read, until every
    item has been compared with one that could, or could not be read itself.
    """
    key = ["length", "digest", "_class"]
    named = ["item_id", "path"]
    whole = F.struct(*[F.col(name) for name in rows.columns])
    pending, states, number = rows.filter("digest IS NOT NULL").withColumn("_class", F.lit(0)), [], 0
    while True:
        number += 1
        first = F.min_by(whole, F.struct(*path_order(), F.col("item_id"))).alias("first")
        firsts = pending.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), first)
        firsts = materialize(firsts.filter("_n > 1") if number == 1 else firsts)
        if number == 1 and firsts.isEmpty():
            return rows.withColumn("content_key", F.col("digest"))
        others = pending.join(firsts.select(*key, "first"), key).filter("item_id <> first.item_id OR path <> first.path")
        result = materialize(compare(others.withColumn("_digest", F.col("digest")).withColumn("_length", F.col("length"))))
        if result.filter("state <> 'equal'").isEmpty():
            if number == 1:
                return rows.withColumn("content_key", F.col("digest"))
            open_again = None
        else:
            open_again = result.filter("state IN ('different', 'unproved')").select(
                *named, F.when(F.col("state") == "different", number).otherwise(F.col("_class")).alias("_class")
            )
        keyed = result.withColumnsRenamed({"_digest": "digest", "_length": "length"})
        unread = keyed.groupBy(*key).agg(F.min("first_failure").alias("failure"))
        states.append(firsts.join(unread, key, "left").select("first.item_id", "first.path", "_class", "failure"))
        states.append(result.filter("state IN ('equal', 'failed')").select(*named, "_class", "failure"))
        if open_again is None:
            break
        pending = materialize(rows.join(open_again, named))
        if pending.isEmpty():
            break
    found = materialize(reduce(DataFrame.unionByName, states)).withColumnRenamed("failure", "read_failure")
    variant = F.when(F.col("_class") > 0, F.concat_ws("#", "digest", F.col("_class").cast("string"))).otherwise(F.col("digest"))
    return rows.join(found, named, "left").withColumn("content_key", variant).drop("_class")


class Isolated(NamedTuple):
    members: DataFrame
    skipped: DataFrame


def isolate_failures(members: DataFrame) -> Isolated:
    """Take the sets apart that a failed comparison or a failed final check makes uncertain.

    `members` has group_id and the boolean columns compare_failed and validate_failed. In path order,
    a failed comparison with the first of the set ends that set: everything in it so far and the failed
    row are skipped, later rows may form a new set. A failed final check ends its whole set. The rows
    that stay carry `set_no`. With a column `read_failure`, the reason why a row could not be read at all, its comparison with the first
    has failed, and so has that of the row after it, which finds a first that could not be read or opens a set; the reason is then that.
    """
    read = F.col("read_failure").isNotNull() if "read_failure" in members.columns else F.lit(False)
    suspicious = (
        members.filter(F.col("compare_failed") | F.col("validate_failed") | read).select("group_id").distinct()
    )
    suspicious = materialize(suspicious)
    if suspicious.isEmpty():
        empty = members.limit(0).withColumn("reason", F.lit(None).cast("string"))
        return Isolated(members.withColumn("set_no", F.lit(0).cast("long")), empty)
    safe = members.join(suspicious, "group_id", "left_anti").withColumn("set_no", F.lit(0).cast("long"))
    order = [*path_order(), F.col("item_id")]
    blocked = ranking.with_blocks(members.join(suspicious, "group_id", "left_semi"), order)
    key = ["group_id"]
    counted = ranking.running_count(blocked, key, order, F.lit(1), "_pos")
    if "read_failure" in members.columns:
        after = counted.filter(read).select("group_id", (F.col("_pos") + 1).alias("_pos"), F.lit(True).alias("_after"))
        counted = materialize(
            counted.join(after, ["group_id", "_pos"], "left")
            .withColumn("compare_failed", F.col("compare_failed") | read | F.coalesce("_after", F.lit(False)))
            .drop("_after")
        )
    counted = ranking.running_count(counted, key, order, F.col("compare_failed"), "_failed_upto")
    # Rows in one run of neighbouring failures share this difference.
    failed = counted.filter("compare_failed").withColumn("_run", F.col("_pos") - F.col("_failed_upto"))
    runs = failed.groupBy("group_id", "_run").agg(F.min("_pos").alias("_start"))
    # A failure needs a set to end: the row after an ended set, or the very first row, opens a set instead.
    ends = (
        failed.join(runs, ["group_id", "_run"])
        .withColumn("_shift", F.when(F.col("_start") == 1, 1).otherwise(0))
        .select("group_id", "item_id", (((F.col("_pos") - F.col("_start") + F.col("_shift")) % 2) == 0).alias("_ends"))
    )
    marked = materialize(
        counted.join(ends, ["group_id", "item_id"], "left").withColumn("_ends", F.coalesce("_ends", F.lit(False)))
    )
    sets = ranking.running_count(marked, key, order, F.col("_ends"), "_upto").withColumn(
        "set_no", F.col("_upto") - F.col("_ends").cast("long")
    )
    verdicts = sets.groupBy("group_id", "set_no").agg(
        F.bool_or("_ends").alias("_compare"),
        F.bool_or("validate_failed").alias("_validate"),
        F.count(F.lit(1)).alias("_n"),
        F.min("read_failure" if "read_failure" in members.columns else F.lit(None).cast("string")).alias("_read"),
    )
    judged = sets.join(verdicts, ["group_id", "set_no"])
    reason = F.when(F.col("_compare"), F.coalesce("_read", F.lit("ComparisonFailed"))).when(
        F.col("_validate") & (F.col("_n") > 1), F.lit("ChangedDuringAnalysis")
    )
    if "read_failure" in members.columns:  # the last row of a bucket has nothing to be compared with, but it is lost as well
        reason = F.coalesce(reason, F.when(F.col("_n") == 1, F.col("read_failure")))
    judged = judged.withColumn("reason", reason)
    columns = [*members.columns, "set_no"]
    kept = judged.filter("reason is null and _n > 1").select(*columns)
    skipped = judged.filter("reason is not null").select(*members.columns, "reason")
    return Isolated(safe.unionByName(kept), skipped)


def assemble_groups(keyed: DataFrame, *extra_keys: str) -> DataFrame:
    """One row per set of at least two equal items, named by its first member.

    The product under ANSI mode fails on overflow instead of wrapping.
    """
    described = [name for name in ("modified_at",) if name in keyed.columns]
    first = F.min(F.struct(*path_order(), F.col("item_id"), *described)).alias("_first")
    return (
        keyed.groupBy("length", "content_key", *extra_keys)
        .agg(F.count(F.lit(1)).alias("members"), first)
        .filter("members > 1")
        .select(
            F.col("_first.item_id").alias("group_id"),
            F.col("_first.path").alias("first_path"),
            *[F.col(f"_first.{name}").alias(f"first_{name}") for name in described],
            "length",
            "members",
            reclaimable_bytes("members", "length").alias("reclaimable"),
            "content_key",
            *extra_keys,
        )
    )


def reclaimable_bytes(members: str, length: str) -> Column:
    return (F.col(members) - 1) * F.col(length)


def total_reclaimable(groups: DataFrame) -> DataFrame:
    return groups.agg(F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable"))


def with_group_index(groups: DataFrame) -> DataFrame:
    """0-based index of the groups in the order of their first paths."""
    return ranking.global_rank(groups, path_order("first_path"), "group_index")


class ExactDuplicates(NamedTuple):
    groups: DataFrame
    members: DataFrame
    skipped: DataFrame
    items: DataFrame


class Funnel:
    """Items and bytes at the stages of a scan, counted by the run that passes them on: nothing is read again for it."""

    def __init__(self) -> None:
        self._seen: list[tuple[int, str, Observation]] = []

    def watch(self, number: int, stage: str, df: DataFrame, counted: Column | None = None) -> DataFrame:
        """The same rows; those that are `counted`, all by default, are counted when they are written."""
        seen = Observation()
        self._seen.append((number, stage, seen))
        counted = F.lit(True) if counted is None else counted
        return df.observe(
            seen, F.count(F.when(counted, 1)).alias("items"), F.coalesce(F.sum(F.when(counted, F.col("length"))), F.lit(0)).alias("bytes")
        )

    def table(self, accepted: DataFrame, result: ExactDuplicates) -> DataFrame:
        """(stage_no, stage, items, bytes), as `scan_funnel` gives it; every watched table must have been written."""
        seen = [(number, stage, *(watched.get[name] for name in ("items", "bytes"))) for number, stage, watched in self._seen]
        kinds = "stage_no int, stage string, items long, bytes long"
        rows = accepted.sparkSession.createDataFrame(seen, kinds)
        return rows.unionByName(_stage(2, "accepted", accepted)).unionByName(_group_stages(result.groups))


def with_digests(items: DataFrame, digests: Reader, funnel: Funnel | None = None) -> DataFrame:
    """Items with `digest` and `failure`, of which only those of repeated lengths are read.

    `digests` gets (item_id, path, length) of these and gives (item_id, path, digest) and, where it knows, `failure`.
    """
    wanted = size_candidates(items).select("item_id", "path", "length")
    read = digests(materialize(funnel.watch(4, "size candidates", wanted)) if funnel else wanted)
    if "failure" not in read.columns:
        read = read.withColumn("failure", F.lit(None).cast("string"))
    read = materialize(read.select("item_id", "path", "digest", "failure"))
    return items.drop("digest", "failure").join(read, ["item_id", "path"], "left")


def find_exact_duplicates(
    inv: DataFrame, content: DataFrame | Reader | Proof | None = None, digests: Reader | None = None, funnel: Funnel | None = None
) -> ExactDuplicates:
    """Groups of equal items, their members, the items that could not be judged, and all items with what was read of them.

    Folders, links and whatever else `plain_file` refuses are left out: they are never opened. With `digests`, only items whose length occurs
    again are hashed at all, see `with_digests`; otherwise the inventory has the digests. Null digests are unreadable items: each one is
    skipped alone. With a `Proof`, items are compared where they lie, and the members of every set are looked at once more at the end: an
    item that went away or changed since it was listed takes its set with it, with its reason. Optional boolean columns
    compare_failed and validate_failed tell of other reads that failed later on, see `isolate_failures`. A `funnel` counts items and bytes
    on the way; it needs `digests`.
    """
    # everything below reads this narrow table
    items = dedupe_identity(inv.filter(plain_file()))
    items = materialize(funnel.watch(3, "distinct identity", items) if funnel else items)
    if digests is not None:
        items = with_digests(items, digests, funnel)
        items = materialize(funnel.watch(5, "hashed", items, F.col("digest").isNotNull()) if funnel else items)
    if isinstance(content, Proof):
        keyed = prove_pairs(items.filter("digest is not null").drop("failure"), content.compare)
    else:
        keyed = verify_content(items.filter("digest is not null"), content)
    groups = assemble_groups(keyed)
    members = keyed.join(groups.select("length", "content_key", "group_id"), ["length", "content_key"])
    skipped = detection_skipped(items)
    flags = [name for name in ("compare_failed", "validate_failed") if name in inv.columns]
    if flags or "read_failure" in members.columns:
        for name in {"compare_failed", "validate_failed"}:
            members = members.withColumn(name, F.coalesce(F.col(name), F.lit(False)) if name in flags else F.lit(False))
        isolated = isolate_failures(members)
        groups = assemble_groups(isolated.members.withColumnRenamed("group_id", "_whole"), "_whole", "set_no")
        members = (
            isolated.members.withColumnRenamed("group_id", "_whole")
            .join(groups.select("_whole", "set_no", "group_id"), ["_whole", "set_no"])
            .drop("_whole", "set_no", "read_failure")
        )
        groups = groups.drop("_whole", "set_no")
        skipped = skipped.unionByName(isolated.skipped.select(*skipped.columns))
    if isinstance(content, Proof):
        members = materialize(members)
        changed = materialize(content.validate(members))
        if not changed.isEmpty():
            reasons = members.join(changed, ["item_id", "path"]).groupBy("group_id").agg(F.min("failure").alias("reason"))
            lost = members.drop("reason").join(materialize(reasons), "group_id")
            skipped = skipped.unionByName(lost.select(*skipped.columns))
            members = members.join(reasons.select("group_id"), "group_id", "left_anti")
            groups = groups.join(reasons.select("group_id"), "group_id", "left_anti")
    return ExactDuplicates(groups, members, skipped, items)


def detection_skipped(items: DataFrame) -> DataFrame:
    """Unreadable items among the size candidates: unique lengths are never read, so they cannot fail."""
    unreadable = size_candidates(items).filter("digest is null")
    reason = F.coalesce("failure", F.lit("HashFailed")) if "failure" in items.columns else F.lit("HashFailed")
    return unreadable.select("item_id", "path", "identity", reason.alias("reason"))


def _stage(number: int, name: str, df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).select(
        F.lit(number).alias("stage_no"), F.lit(name).alias("stage"), "items", "bytes"
    )


def _group_stages(groups: DataFrame) -> DataFrame:
    sizes = groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("members"), F.lit(0)).alias("members"),
        F.coalesce(F.sum(F.col("members") * F.col("length")), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable"),
    )
    level = lambda number, name, count, size: F.struct(
        F.lit(number).alias("stage_no"), F.lit(name).alias("stage"), count.alias("items"), size.alias("bytes")
    )
    return sizes.select(
        F.inline(
            F.array(
                level(6, "verified groups", F.col("groups"), F.col("bytes")),
                level(7, "members", F.col("members"), F.col("bytes")),
                level(8, "reclaimable", F.col("members") - F.col("groups"), F.col("reclaimable")),
            )
        )
    )


def scan_funnel(entries: DataFrame, accepted: DataFrame, result: ExactDuplicates, items: DataFrame) -> DataFrame:
    """Items and bytes at each stage of a scan, as (stage_no, stage, items, bytes), from the tables of its stages; see `Funnel` for a run
    that counts as it goes."""
    lengths = items.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.count("digest").alias("hashed")).filter("n > 1")
    total = lambda name: lengths.agg(
        F.coalesce(F.sum(name), F.lit(0)).alias("items"), F.coalesce(F.sum(F.col(name) * F.col("length")), F.lit(0)).alias("bytes")
    )
    named = lambda number, name, df: df.select(
        F.lit(number).alias("stage_no"), F.lit(name).alias("stage"), "items", "bytes"
    )
    return (
        _stage(1, "found", entries)
        .unionByName(_stage(2, "accepted", accepted))
        .unionByName(_stage(3, "distinct identity", items))
        .unionByName(named(4, "size candidates", total("n")))
        .unionByName(named(5, "hashed", total("hashed")))
        .unionByName(_group_stages(result.groups))
    )


def snapshot_unchanged(then: DataFrame, now: DataFrame) -> DataFrame:
    """(path, present, unchanged) of every item of the first snapshot."""
    state = lambda df, prefix: df.select(
        F.col("path").alias("path"),
        *[F.col(name).alias(prefix + name) for name in ("identity", "length", "modified_at", "changed_at")],
        (~F.array_contains("attributes", "AlternateDataStream")).alias(prefix + "plain"),
    )
    joined = state(then, "then_").join(state(now, "now_").withColumn("_seen", F.lit(True)), "path", "left")
    same = F.coalesce(F.col("now_plain"), F.lit(False))
    for name in ("identity", "length", "modified_at", "changed_at"):
        same = same & F.col("then_" + name).eqNullSafe(F.col("now_" + name))
    present = F.col("_seen").isNotNull()
    return joined.select("path", present.alias("present"), (present & same).alias("unchanged"))

"""Similar images: the links between them, candidates, scores and review of groups.

All links are found by `links`: equal fingerprints are one look, looks are put in order of aspect and cut into blocks, and blocks
whose aspects are close enough are compared as a whole, tile by tile. Nothing leaves a tile but the pairs that reach the thresholds, and
copies of a look are linked with its first image, not with each other, but by `links_of_images`, which gives every pair of images.

For collections that are too large for that there is the bounded candidate search. Its candidates come from equal 16-bit hash segments. A segment value may be shared by a third of all
images; by default each image looks only at the 64 newest holders before it, which is found by a running count
and an equality join on blocks of that count, so no bucket is ever joined with itself.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duploscope.functions import formats, images, paths, ranking
from duploscope.operators import selection
from duploscope.operators.exact import dedupe_identity, path_order
from duploscope.session import materialize

# Formats that are looked at, and the bounds of the candidate search.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tif", ".tiff", ".webp", ".heic", ".heif")
NEWEST_PER_BUCKET = 64
BEST_PER_IMAGE = 64

MARKS = ("None", "Keep", "ConsiderRemoving")

RANK_BLOCK = 65_536
TILE, LARGEST_TILE = 1024, 16_384  # looks of a block
BLOCKS = 48  # that blocks grow for, so that what is shuffled, each block once for each of its tiles, grows with the looks
RUN = 8  # blocks that a task compares with those it holds, where that gives each core of the session a few tasks
COPIES = 1024  # images of a look in one row
SCORES = ("structure", "difference", "average", "color", "aspect")


class Eligible(NamedTuple):
    images: DataFrame
    skipped: DataFrame


def eligible_images(inv: DataFrame) -> Eligible:
    """One row per identity in a supported format, and the others as skipped."""
    items = dedupe_identity(inv)
    supported = F.lower("extension").isin(*IMAGE_EXTENSIONS)
    return Eligible(
        items.filter(supported),
        items.filter(~supported).select("item_id", "path", F.lit("UnsupportedFormat").alias("reason")),
    )


def image_skips(eligible: Eligible, decoded: DataFrame, undecoded: DataFrame, now: DataFrame | None = None) -> DataFrame:
    """(item_id, path, reason) of every image that gets no fingerprint.

    `decoded` and `undecoded` are the two sides of `read_images`. An eligible file on neither side could not be
    opened. With a later inventory, files that changed in between are skipped too.
    """
    wanted = eligible.images.select("item_id", "path")
    corrupt = wanted.join(undecoded.select("path", "reason"), "path").select("item_id", "path", "reason")
    seen = decoded.select("path").unionByName(undecoded.select("path"))
    missing = wanted.join(seen, "path", "left_anti").withColumn("reason", F.lit("Inaccessible"))
    parts = eligible.skipped.unionByName(corrupt).unionByName(missing)
    if now is None:
        return parts
    names = ("path", "length", "modified_at", "changed_at", "identity")
    changed = (
        eligible.images.join(decoded.select("path"), "path", "left_semi")
        .join(now.select(*names), list(names), "left_anti")
        .select("item_id", "path", F.lit("ChangedDuringAnalysis").alias("reason"))
    )
    return parts.unionByName(changed)


def with_positions(fingerprints: DataFrame) -> DataFrame:
    """Fingerprints with `pos`, their 0-based place in path order. The rank has written them, so that every step below reads a table."""
    return ranking.global_rank(fingerprints, [*path_order(), F.col("item_id")], "pos")


def candidates_all_pairs(placed: DataFrame, at_most: int) -> DataFrame:
    """(first_pos, second_pos) of all pairs, for a collection that the caller knows to be small; `candidates` does not use it."""
    last = placed.count() - 1
    if last + 1 > at_most:
        raise ValueError(f"all pairs were asked for at most {at_most} images")
    later = F.when(F.col("pos") < last, F.sequence(F.col("pos") + 1, F.lit(last)))
    return placed.select(F.col("pos").alias("first_pos"), F.explode(later).alias("second_pos"))


def candidates_identical(placed: DataFrame) -> DataFrame:
    """Each image with the first one that has the same three hashes."""
    firsts = placed.groupBy(*images.HASHES).agg(F.min("pos").alias("first_pos"))
    return (
        placed.select("pos", *images.HASHES)
        .join(firsts, list(images.HASHES))
        .filter("pos <> first_pos")
        .select("first_pos", F.col("pos").alias("second_pos"))
    )


def _same_segments() -> list[Column]:
    """Whether probe and member agree in each segment."""
    same = lambda name, shift: (
        F.shiftrightunsigned(F.col(f"probe.{name}").bitwiseXOR(F.col(f"member.{name}")), shift).bitwiseAND(F.lit(0xFFFF)) == 0
    )
    return [same(name, 16 * part) for name in images.HASHES for part in range(4)]


def _shared_segments() -> Column:
    bits = [same.cast("int") for same in _same_segments()]
    total = bits[0]
    for bit in bits[1:]:
        total = total + bit
    return total


def segment_candidates(
    placed: DataFrame, newest: int | None = NEWEST_PER_BUCKET, best: int | None = BEST_PER_IMAGE
) -> DataFrame:
    """Per image the `best` earlier images by shared segments, among the `newest` of each of its buckets.

    The bounds keep a bucket of many like images from being joined with itself; with None there are none, and every
    pair with a segment in common is found. A bucket is (aspect class, segment, value); an image is stored in its own aspect class and looks into
    the neighbouring ones as well.
    """
    slim = placed.select("pos", *images.HASHES, images.aspect_bucket("aspect").alias("own_aspect"))
    keys = F.array(*[F.struct(F.lit(n).alias("segment"), images.segment(n).alias("value")) for n in range(images.SEGMENTS)])
    spread = (
        slim.select("*", F.explode(keys).alias("key"))
        .select("pos", *images.HASHES, "key.segment", "key.value", "own_aspect", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("delta"))
        .withColumn("bucket_aspect", F.col("own_aspect") + F.col("delta"))
        .withColumn("_block", F.floor(F.col("pos") / RANK_BLOCK))
    )
    key = ["bucket_aspect", "segment", "value"]
    if newest is None:
        found = _sharing(spread, key)
    else:
        found = _sharing_newest(spread, key, newest)
    if best is None:
        return found
    order = Window.partitionBy("second_pos").orderBy(F.col("shared").desc(), "first_pos")
    return found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= best).drop("_rank")


def _hashes(name: str) -> Column:
    return F.struct(*images.HASHES).alias(name)


def _sharing(spread: DataFrame, key: list[str]) -> DataFrame:
    members = spread.filter("delta = 0").select(*key, F.col("pos").alias("first_pos"), _hashes("member"))
    probes = spread.select(*key, F.col("pos").alias("second_pos"), _hashes("probe"))
    # a pair meets once for each segment it shares, and is kept at the first of them, so that pairs need not be told apart
    first = F.coalesce(*[F.when(same, n) for n, same in enumerate(_same_segments())])
    found = probes.join(members, key).filter("first_pos < second_pos").filter(F.col("segment") == first)
    return found.select("first_pos", "second_pos", _shared_segments().alias("shared"))


def _sharing_newest(spread: DataFrame, key: list[str], newest: int) -> DataFrame:
    # stored images up to and including this row; the row itself is stored in its own class only
    counted = materialize(ranking.running_count(spread, key, [F.col("pos")], F.col("delta") == 0, "_count"))
    members = counted.filter("delta = 0").select(
        *key, F.col("_count").alias("_seq"), F.floor((F.col("_count") - 1) / newest).alias("_part"),
        F.col("pos").alias("first_pos"), _hashes("member"),
    )
    before = F.col("_count") - F.when(F.col("delta") == 0, 1).otherwise(0)
    last = F.floor((F.col("_before") - 1) / newest)
    # the newest numbers up to `_before` lie in its own part and the one before
    probes = (
        counted.withColumn("_before", before)
        .filter("_before > 0")
        .select(
            *key, "_before", F.col("pos").alias("second_pos"), _hashes("probe"),
            F.explode(F.when(last > 0, F.array(last - 1, last)).otherwise(F.array(last))).alias("_part"),
        )
    )
    return (
        probes.join(members, [*key, "_part"])
        .filter((F.col("_seq") <= F.col("_before")) & (F.col("_seq") > F.col("_before") - newest))
        .select("first_pos", "second_pos", _shared_segments().alias("shared"))
        .distinct()
    )


def candidates_lsh(placed: DataFrame) -> DataFrame:
    """(first_pos, second_pos) from shared segments and from identical hashes."""
    by_segment = segment_candidates(placed).select("first_pos", "second_pos")
    return by_segment.unionByName(candidates_identical(placed)).distinct()


def candidates(placed: DataFrame) -> DataFrame:
    """Pairs to score: by the same rule in collections of any size."""
    return candidates_lsh(placed)


def _paired(pairs: DataFrame, placed: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    side = lambda name: placed.select(F.col("pos").alias(f"{name}_pos"), F.struct("item_id", "path", *columns).alias(name))
    return pairs.join(side("first"), "first_pos").join(side("second"), "second_pos")


def pair_scores(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """The six scores of each pair: structure, difference, average, color, aspect, composite."""
    scored = _paired(pairs, placed, images.FINGERPRINT).select(
        *pairs.columns,
        F.col("first.item_id").alias("first_id"),
        F.col("second.item_id").alias("second_id"),
        *[score.alias(name) for name, score in images.scores(F.col("first"), F.col("second")).items()],
    )
    return scored.withColumn("composite", images.composite())


def pair_explain(scored: DataFrame) -> DataFrame:
    """The scores of a pair side by side."""
    return scored.select("first_id", "second_id", *[F.round(name, 6).alias(name) for name in (*SCORES, "composite")])


def _hopeless(sensitivity: str) -> Column:
    """Pairs that miss a threshold whatever their luminance and colors are: known from hashes and aspect alone."""
    limits, weights = images.THRESHOLDS[sensitivity], images.WEIGHTS
    ceiling = (
        weights["structure"] + weights["color"] + weights["difference"] * F.col("difference")
        + weights["average"] * F.col("average") + weights["aspect"] * F.col("aspect")
    )
    slack = 1e-9  # the terms are added in another order than in the score
    return (
        (F.col("difference") < limits["difference"]) | (F.col("aspect") < limits["aspect"])
        | (ceiling < limits["composite"] - slack)
    )


def relationships(pairs: DataFrame, placed: DataFrame, sensitivity: str = "Balanced") -> DataFrame:
    """Scored pairs that reach the thresholds, with their tier.

    Hashes weigh 56 bytes, a whole fingerprint some 4 KB: pairs are thinned by what the hashes
    rule out before the rest is fetched.
    """
    small = (*images.HASHES, *[f"center_{name}" for name in images.HASHES], "aspect")
    thinned = (
        _paired(pairs.select("first_pos", "second_pos"), placed, small)
        .select(
            "first_pos",
            "second_pos",
            images.difference_similarity(F.col("first"), F.col("second")).alias("difference"),
            images.average_similarity(F.col("first"), F.col("second")).alias("average"),
            images.aspect_similarity(F.col("first.aspect"), F.col("second.aspect")).alias("aspect"),
        )
        .filter(~_hopeless(sensitivity))
        .select("first_pos", "second_pos")
    )
    scored = pair_scores(thinned, placed)
    return scored.filter(images.meets(sensitivity)).withColumn("tier", images.tier("composite"))


class Looks(NamedTuple):
    """Distinct fingerprints, and the images that have them."""

    looks: DataFrame  # pos, item_id and path of the first image, aspect, print, copies
    images: DataFrame  # pos, item_id, path, look: the pos of its look


def distinct_looks(placed: DataFrame) -> Looks:
    """Images with equal fingerprints together."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = [batch.column(name) for name in ("pos", "item_id", "path", "aspect")]
                yield pa.RecordBatch.from_arrays([*own, images.packed(batch)], names=["pos", "item_id", "path", "aspect", "print"])

    kinds = {field.name: field.dataType.simpleString() for field in placed.schema}
    packed = placed.select("pos", "item_id", "path", *images.FINGERPRINT).mapInArrow(
        pack, f"pos long, item_id {kinds['item_id']}, path string, aspect double, print binary"
    )
    packed = materialize(packed.withColumn("key", F.sha2("print", 256)))
    grouped = packed.groupBy("key").agg(F.min(F.struct("pos", "item_id", "path", "aspect", "print")).alias("one"), F.count(F.lit(1)).alias("copies"))
    looks = materialize(grouped.select("key", "one.*", "copies"))
    members = packed.select("pos", "item_id", "path", "key").join(looks.select("key", F.col("pos").alias("look")), "key").drop("key")
    return Looks(looks.drop("key"), members)


def _tiles(blocks: DataFrame, sensitivity: str) -> DataFrame:
    """(one, other) of all blocks with one <= other whose aspects may reach the threshold; blocks stand in order of aspect.

    Each block is paired with all from itself to the last that begins below its end over the threshold, which a running maximum over
    begins and ends finds: the only global window, over two numbers of each block.
    """
    limit = images.THRESHOLDS[sensitivity]["aspect"]
    begins = blocks.select(F.col("low").alias("value"), F.lit(0).alias("kind"), "block")
    ends = blocks.select((F.col("high") / limit * (1 + 1e-9)).alias("value"), F.lit(1).alias("kind"), "block")
    upto = Window.orderBy("value", "kind").rowsBetween(Window.unboundedPreceding, 0)
    last = F.max(F.when(F.col("kind") == 0, F.col("block"))).over(upto)
    reach = begins.unionByName(ends).withColumn("last", last).filter("kind = 1")
    return reach.select(F.col("block").alias("one"), F.explode(F.sequence("block", "last")).alias("other"))


def block_size(looks: int) -> int:
    """Looks of a block: a fixed number of blocks between the bounds."""
    return min(LARGEST_TILE, max(TILE, math.ceil(looks / BLOCKS)))


class Block(NamedTuple):
    """Looks of a block in a task: their rows, and their fingerprints laid out once."""

    rows: pa.StructArray
    side: images.Side

    @classmethod
    def of(cls, rows: pa.StructArray) -> Block:
        return cls(rows, images.Side(images.Prints.unpacked(rows.field("print").to_pylist())))


Sides = tuple[Block, Block, bool]  # two blocks, and whether they are one


def _shares(tiles: DataFrame, blocks: int, run: int) -> DataFrame:
    """(task, role, block, partners): the blocks of each task, and which of the blocks it holds each of them is compared with.

    A task holds a group of neighbouring blocks (role 0), of which there are up to `BLOCKS`, and goes through `run` others (role 1). So a block
    goes to the groups that it meets, not to its tiles, however many blocks there are. Tiles more than half of all blocks apart are
    held by the later block, so that groups have as much to do as each other where every block meets all.
    """
    per_group = math.ceil(blocks / BLOCKS)
    far = F.col("other") - F.col("one") > blocks // 2
    met = tiles.select(F.when(far, F.col("other")).otherwise(F.col("one")).alias("held"), F.when(far, F.col("one")).otherwise(F.col("other")).alias("block"))
    met = met.withColumn("group", F.floor(F.col("held") / per_group)).groupBy("group", "block").agg(F.sort_array(F.collect_list("held")).alias("partners"))
    inside = F.col("group") == F.floor(F.col("block") / per_group)  # each block is there: it meets itself
    place = F.row_number().over(Window.partitionBy("group").orderBy("block")) - 1
    others = materialize(met.filter(~inside).withColumn("run", F.floor(place / run)))
    last = others.groupBy("group").agg(F.max("run").alias("last"))
    held = met.filter(inside).join(last, "group", "left").withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("last", F.lit(0).cast("long")))))
    partners = F.when(F.col("run") == 0, F.col("partners")).otherwise(F.array().cast("array<long>"))
    columns = ("group", "run", "role", "block", "partners")
    shares = held.withColumn("partners", partners).withColumn("role", F.lit(0)).select(*columns)
    shares = shares.unionByName(others.withColumn("role", F.lit(1)).select(*columns))
    return shares.withColumn("task", F.dense_rank().over(Window.orderBy("group", "run")) - 1).drop("group", "run")


def _over_tiles(
    looks: DataFrame, columns: tuple[str, ...], sensitivity: str, tile: int | None, work: Callable[[Iterator[Sides]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """What `work` makes of all pairs of blocks that may have a close pair; a look is (pos, print, *columns).

    Blocks grow with the looks up to a bound, and beyond that the groups of blocks that a task holds, so that a look is shuffled about as often
    in a large table as in a small one.
    """
    ranked = ranking.global_rank(looks.select("pos", "print", "aspect", *columns), [F.col("aspect"), F.col("pos")], "_index")
    count = ranked.count()
    tile = tile or block_size(count)
    blocks = materialize(
        ranked.groupBy(F.floor(F.col("_index") / tile).alias("block"))  # `tile` rows each
        .agg(F.collect_list(F.struct("pos", "print", *columns)).alias("members"), F.min("aspect").alias("low"), F.max("aspect").alias("high"))
    )
    tiles = materialize(_tiles(blocks.select("block", "low", "high"), sensitivity))
    run = max(1, min(RUN, tiles.count() // (4 * looks.sparkSession.sparkContext.defaultParallelism)))
    shares = materialize(_shares(tiles, max(1, math.ceil(count / tile)), run))
    tasks = shares.agg(F.coalesce(F.max("task") + 1, F.lit(1))).first()[0]
    dealt = blocks.select("block", "members").join(shares, "block").select("task", "role", "block", "partners", "members")
    dealt = dealt.repartitionById(tasks, F.col("task").cast("int")).sortWithinPartitions("task", "role", "block")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[Sides]:
        task, held = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                if batch.column("task")[row].as_py() != task:
                    task, held = batch.column("task")[row].as_py(), {}
                number, block = batch.column("block")[row].as_py(), Block.of(batch.column("members")[row].values)
                if batch.column("role")[row].as_py() == 0:
                    held[number] = block
                for partner in batch.column("partners")[row].as_py():
                    yield held[partner], block, partner == number

    return dealt.mapInArrow(lambda batches: work(pairs(batches)), schema)


def close_looks(looks: DataFrame, sensitivity: str = "Balanced", tile: int | None = None, scores: tuple[str, ...] = SCORES) -> DataFrame:
    """(first_pos, second_pos, first_id, second_id, scores, composite) of all pairs of looks that reach the thresholds.

    Every pair of blocks that may have one is compared: the work grows with the square of the looks of about one aspect, at some 15
    nanoseconds for a pair that the hashes rule out and 75 where most are close.
    """
    kind = looks.schema["item_id"].dataType.simpleString()
    given = (*scores, "composite")

    def compare(tiles: Iterator[Sides]) -> Iterator[pa.RecordBatch]:
        for one, other, same in tiles:
            pos = [block.rows.field("pos").to_numpy() for block in (one, other)]
            ids = pa.concat_arrays([block.rows.field("item_id") for block in (one, other)])
            for i, j, found in images.close_pairs(one.side, other.side, sensitivity, same):
                near, far = pos[0].take(i), pos[1].take(j)
                turned, after = near > far, j + len(one.rows)
                first, second = np.where(turned, after, i), np.where(turned, i, after)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.minimum(near, far)), pa.array(np.maximum(near, far)), ids.take(pa.array(first)), ids.take(pa.array(second)),
                        *[pa.array(found[name]) for name in given],
                    ],
                    names=["first_pos", "second_pos", "first_id", "second_id", *given],
                )

    numbers = ", ".join(f"{name} double" for name in given)
    schema = f"first_pos long, second_pos long, first_id {kind}, second_id {kind}, {numbers}"
    return _over_tiles(looks, ("item_id",), sensitivity, tile, compare, schema)


def close_counts(looks: DataFrame, sensitivity: str = "Balanced", tile: int | None = None) -> DataFrame:
    """(pos, tier, looks, images, reached) of the looks in the pairs of `close_looks`, in one row or several that add up: with how many other looks and
    their images a look is linked in a tier, and the smallest position that it is connected with inside a tile. Nothing is written for a pair.
    """

    def count(tiles: Iterator[Sides]) -> Iterator[pa.RecordBatch]:
        for first, second, same in tiles:
            blocks = [first] if same else [first, second]
            pos, copies = (np.concatenate([block.rows.field(name).to_numpy() for block in blocks]) for name in ("pos", "copies"))
            order = np.argsort(pos)  # vertices are numbered by position
            place = np.argsort(order)
            ends = place[: len(first.rows)], place if same else place[len(first.rows) :]
            pos, copies = pos[order], copies[order]
            label, single = np.arange(len(pos)), bool((copies == 1).all())
            looks_of, images_of = (np.zeros((len(images.TIER_ORDER), len(pos)), np.int64) for _ in range(2))
            for rows, columns, reached in images.close_masks(first.side, second.side, sensitivity, same):
                near, far = ends[0][rows], ends[1][columns]
                for n, mask in enumerate(reached):
                    if n + 1 < len(reached):  # those of no higher tier
                        mask = mask & ~reached[n + 1]
                    for at, around, linked in ((near, far, mask), (far, near, mask.T)):
                        looks_of[n][at] += np.count_nonzero(linked, axis=1)
                        if not single:
                            images_of[n][at] += np.where(linked, copies[around], 0).sum(axis=1)
                label = _met(label, near, far, reached[0])
            for n, name in enumerate(images.TIER_ORDER):
                at = np.flatnonzero(looks_of[n])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(pos[at]), pa.array([name] * len(at), pa.string()), pa.array(looks_of[n][at]),
                        pa.array((looks_of if single else images_of)[n][at]), pa.array(pos[label[at]]),
                    ],
                    names=["pos", "tier", "looks", "images", "reached"],
                )

    return _over_tiles(looks, ("copies",), sensitivity, tile, count, "pos long, tier string, looks long, images long, reached long")


def _met(label: np.ndarray, near: np.ndarray, far: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """`_joined` with the pairs of vertices that are linked; most are known to be connected after a few."""
    low, high = label.take(near), label.take(far)
    known = np.bincount(high).argmax()
    rows, columns = np.flatnonzero(low != known), np.flatnonzero(high != known)
    if not len(rows) and not len(columns):
        return label
    of_rows, of_columns = np.nonzero(linked[rows]), np.nonzero(linked[:, columns])
    one = np.concatenate([rows.take(of_rows[0]), of_columns[0]])
    other = np.concatenate([of_rows[1], columns.take(of_columns[1])])
    return _joined(label, near.take(one), far.take(other))


def _joined(label: np.ndarray, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Labels, each the smallest vertex that a vertex is known to be connected with, after these pairs are connected as well."""
    while True:
        low, high = label.take(one), label.take(other)
        apart = np.flatnonzero(low != high)
        if not len(apart):
            return label
        one, other, low, high = one.take(apart), other.take(apart), low.take(apart), high.take(apart)
        parent = np.arange(len(label))
        np.minimum.at(parent, np.maximum(low, high), np.minimum(low, high))
        while True:
            above = parent[parent]
            if np.array_equal(above, parent):
                break
            parent = above
        label = parent[label]


def links(found: Looks, close: DataFrame) -> DataFrame:
    """All links with their tier: the pairs of `close_looks`, and each further image of a look with the look's first."""
    first = found.looks.filter("copies > 1").select(F.col("pos").alias("first_pos"), F.col("item_id").alias("first_id"))
    copies = found.images.filter("pos <> look").select(F.col("look").alias("first_pos"), F.col("pos").alias("second_pos"), F.col("item_id").alias("second_id"))
    equal = copies.join(first, "first_pos").withColumns({name: F.lit(1.0) for name in SCORES}).withColumn("composite", images.composite())
    return close.unionByName(equal.select(*close.columns)).withColumn("tier", images.tier("composite"))


def links_of_images(found: Looks, close: DataFrame, chunk: int = COPIES) -> DataFrame:
    """All links between images with their tier: each pair of `close_looks` once for every two images of its looks, and all pairs of images of a look.

    The images of a look are kept in arrays of up to `chunk`. Only looks with copies are joined, by a written table that Spark broadcasts if it is small.
    """
    several = found.looks.filter("copies > 1").select(F.col("pos").alias("look"))
    ranked = ranking.global_rank(found.images.select("look", "pos", "item_id").join(several, "look"), [F.col("look"), F.col("pos")], "_index")
    copies = materialize(
        ranked.groupBy("look", F.floor(F.col("_index") / chunk).alias("chunk")).agg(F.collect_list(F.struct("pos", "item_id")).alias("members"))
    )
    values = [name for name in close.columns if name not in ("first_pos", "second_pos", "first_id", "second_id")]
    lists = lambda side: copies.select(F.col("look").alias(f"{side}_pos"), F.col("members").alias(f"_{side}"))
    own = lambda side: F.array(F.struct(F.col(f"{side}_pos").alias("pos"), F.col(f"{side}_id").alias("item_id")))
    both = close.join(lists("first"), "first_pos", "left").join(lists("second"), "second_pos", "left")
    both = both.select(*[F.coalesce(f"_{side}", own(side)).alias(f"_{side}") for side in ("first", "second")], *values)
    one, other = (copies.select("look", F.col("chunk").alias(f"_{name}"), F.col("members").alias(name)) for name in ("one", "other"))
    equal = one.join(other, "look").filter("_one <= _other").select(F.col("one").alias("_first"), F.col("other").alias("_second"))
    equal = equal.withColumns({name: F.lit(1.0) for name in SCORES}).withColumn("composite", images.composite())

    def pairs(df: DataFrame) -> DataFrame:
        return df.select(F.explode("_first").alias("a"), "_second", *values).select("a", F.explode("_second").alias("b"), *values)

    between = pairs(both).withColumn("turned", F.expr("a.pos > b.pos"))
    inside = pairs(equal.select("_first", "_second", *values)).filter("a.pos < b.pos").withColumn("turned", F.lit(False))
    end = lambda field, yes, no: F.when(F.col("turned"), F.col(f"{yes}.{field}")).otherwise(F.col(f"{no}.{field}"))
    ends = [end("pos", "b", "a").alias("first_pos"), end("pos", "a", "b").alias("second_pos"), end("item_id", "b", "a").alias("first_id"), end("item_id", "a", "b").alias("second_id")]
    return between.unionByName(inside).select(*ends, *values).withColumn("tier", images.tier("composite"))


def links_by_tier(found: Looks, counts: DataFrame) -> DataFrame:
    """(tier, pairs): how many `links` there are of each tier, from `close_counts`."""
    equal = images.tier(images.composite({name: F.lit(1.0) for name in SCORES}))
    copies = found.looks.filter("copies > 1").select(equal.alias("tier"), (2 * (F.col("copies") - 1)).alias("looks"))
    both = counts.select("tier", "looks").unionByName(copies)  # a pair is counted at both of its looks
    return both.groupBy("tier").agg(F.expr("sum(looks) div 2").alias("pairs"))


def similarity_totals(found: Looks, close: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: eligible images, candidate pairs and comparisons, both all pairs, relationships between images, groups.

    `close` are the pairs of `close_looks` or the rows of `close_counts`.
    """
    sizes = found.looks.select("pos", "copies")
    if "reached" in close.columns:  # each pair from both sides
        between = close.join(sizes, "pos")
        related = F.expr("sum(copies * images) div 2")
    else:
        between = close.join(sizes.withColumnsRenamed({"pos": "first_pos", "copies": "_a"}), "first_pos").join(
            sizes.withColumnsRenamed({"pos": "second_pos", "copies": "_b"}), "second_pos"
        )
        related = F.sum(F.col("_a") * F.col("_b"))
    named = lambda df, name, value: df.agg(F.sum(value).alias("n")).select(F.lit(name).alias("name"), "n")
    rows = (
        named(sizes, "eligible", F.col("copies"))
        .unionByName(named(sizes, "relationships", F.expr("copies * (copies - 1) div 2")))
        .unionByName(between.agg(related.alias("n")).select(F.lit("relationships").alias("name"), "n"))
        .unionByName(named(groups, "groups", F.lit(1)))
    )
    total = lambda name: F.coalesce(F.sum(F.when(F.col("name") == name, F.col("n"))), F.lit(0)).alias(name)
    every = F.expr("eligible * (eligible - 1) div 2")
    return rows.agg(total("eligible"), total("relationships"), total("groups")).select(
        "eligible", every.alias("candidate_pairs"), every.alias("comparisons"), "relationships", "groups"
    )


def similarity_stats(placed: DataFrame, pairs: DataFrame, related: DataFrame, groups: DataFrame) -> DataFrame:
    """One row after a bounded candidate search: eligible images, candidate pairs, relationships, groups; see `similarity_totals`."""
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
    rows = (
        count(placed, "eligible").unionByName(count(pairs, "candidate_pairs"))
        .unionByName(count(related, "relationships")).unionByName(count(groups, "groups"))
    )
    names = ("eligible", "candidate_pairs", "relationships", "groups")
    return rows.agg(*[F.sum(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in names])


SIMILAR_SORTS = ("tier", "photo_count", "activity", "total_size")


def similar_group_totals(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Groups with photo count, newest modification and total size; `members` has group_id, length, modified_at."""
    totals = members.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("photos"), F.max("modified_at").alias("newest"), F.sum("length").alias("total_size")
    )
    return groups.join(totals, "group_id").withColumn("tier_label", formats.tier_label("tier"))


def filter_similar_groups(
    groups: DataFrame, members: DataFrame, tier: str | None = None, search: str | None = None
) -> DataFrame:
    """Whole groups of a tier in which some image matches by name or path."""
    kept = groups.filter(F.col("tier") == tier) if tier else groups
    if search and search.strip():
        hits = members.filter(paths.search_match(search, "file_name", "path")).select("group_id").distinct()
        kept = kept.join(hits, "group_id", "left_semi")
    return kept


def sort_similar_groups(totals: DataFrame, by: str = "tier", descending: bool = True) -> DataFrame:
    """Groups of `similar_group_totals` in order."""
    return totals.orderBy(*similar_order(by, descending))


def similar_order(by: str = "tier", descending: bool = True) -> list[Column]:
    """The order of a sort option; ties end at the path of the representative."""
    rank = F.array_position(F.array(*[F.lit(name) for name in images.TIER_ORDER]), F.col("tier"))
    key = {"tier": rank, "photo_count": F.col("photos"), "activity": F.col("newest"), "total_size": F.col("total_size")}[by]
    ties = [paths.file_name("first_path")] if by == "tier" else []
    return [key.desc() if descending else key.asc(), *ties, F.col("first_path")]


def mark(members: DataFrame, requests: DataFrame, value: str) -> DataFrame:
    """Members with `mark` set for the requested images (item_id, request_no, and group_id where ids may repeat).

    A group never has every image under "ConsiderRemoving": the request for the last one changes nothing.
    """
    if value not in MARKS:
        raise ValueError(f"unknown mark: {value}")
    if value == "ConsiderRemoving":
        marked = members.withColumn("selected", F.col("mark") == value)
        guarded = selection.guard_survivor(marked, requests).members
        return guarded.withColumn("mark", F.when(F.col("selected"), F.lit(value)).otherwise(F.col("mark"))).select(*members.columns)
    named = ["group_id", "item_id"] if "group_id" in requests.columns else ["item_id"]
    asked = requests.select(*named, F.lit(value).alias("_mark")).distinct()
    return members.join(asked, named, "left").withColumn("mark", F.coalesce("_mark", "mark")).select(*members.columns)


def marked_totals(members: DataFrame, per_group: bool = False) -> DataFrame:
    """Number and bytes of the images under "ConsiderRemoving"."""
    chosen = F.col("mark") == "ConsiderRemoving"
    totals = [
        F.count_if(chosen).alias("marked"),
        F.coalesce(F.sum(F.when(chosen, F.col("length"))), F.lit(0)).alias("marked_bytes"),
    ]
    return members.groupBy("group_id").agg(*totals) if per_group else members.agg(*totals)

"""Complete-link groups of similar images.

Anchors are taken by number of relationships, then path; each takes the free neighbours, in path
order, that reach the thresholds with every image already taken. An anchor's turn depends only on
its connected component, so components of bounded size are each settled in one task. Larger ones,
which may hold a third of all images, are settled in rounds: every anchor that comes first within
two steps around it can take its turn at once, because no other anchor touches its neighbours.
Where all links are known, no scores are needed any more, and a component is settled in one task up to a number of links.
Where so many are linked that links are only counted, one task compares fingerprints, up to a number of bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duploscope.functions import images, ranking
from duploscope.operators.similar import RANK_BLOCK, Looks, close_looks
from duploscope.session import materialize

COMPONENT_LIMIT = 2_000  # images settled in one task: some 8 MB of fingerprints
EDGE_LIMIT = 16_000_000  # links settled in one task, where all are known: some 700 MB
PRINT_LIMIT = 256 << 20  # bytes of fingerprints settled in one task, where no pairs are written: some 1.2 million grids
TURN_SIZE = 64  # candidates of one anchor that are settled together in a round

MEMBERS = "anchor_pos long, pos long"


class SimilarGroups(NamedTuple):
    groups: DataFrame
    members: DataFrame


def _gathered(parts: list[DataFrame], at_most: int = 16) -> list[DataFrame]:
    """The same rows in few tables, so that plans stay small however many rounds there are."""
    return [materialize(reduce(DataFrame.unionByName, parts))] if len(parts) >= at_most else parts


def connected_components(edges: DataFrame) -> DataFrame:
    """(pos, component) of the vertices of edges (first_pos, second_pos); a component is named by its smallest."""
    both = materialize(_both_ways(edges))
    labels = materialize(both.groupBy("pos").agg(F.least("pos", F.min("other")).alias("component")))
    while True:
        around = (
            both.join(labels.select(F.col("pos").alias("other"), F.col("component").alias("_seen")), "other")
            .groupBy("pos")
            .agg(F.min("_seen").alias("_seen"))
        )
        lowered = labels.join(around, "pos").select(
            "pos", "component", F.least("component", "_seen").alias("_next")
        )
        # follow the label one step further, which halves the distance to the smallest vertex
        heads = labels.select(F.col("pos").alias("_next"), F.col("component").alias("_jump"))
        moved = materialize(
            lowered.join(heads, "_next").select("pos", "component", F.least("_next", "_jump").alias("_next"))
        )
        labels = moved.select("pos", F.col("_next").alias("component"))
        if moved.filter("component <> _next").isEmpty():
            return labels


def _both_ways(edges: DataFrame) -> DataFrame:
    forth = edges.select(F.col("first_pos").alias("pos"), F.col("second_pos").alias("other"))
    back = edges.select(F.col("second_pos").alias("pos"), F.col("first_pos").alias("other"))
    return forth.unionByName(back)


class _Scorer:
    """Thresholds between images of one task, with the arithmetic of `duploscope.functions.images`."""

    def __init__(self, rows: pd.DataFrame, sensitivity: str) -> None:
        self.limits = images.THRESHOLDS[sensitivity]
        stack = lambda name, kind: np.stack([np.asarray(v, dtype=kind) for v in rows[name]])
        self.luminance = {p: stack(f"{p}luminance", np.int32) for p in ("", "center_")}
        self.hashes = {
            (p, name): rows[f"{p}{name}"].to_numpy(np.int64) for p in ("", "center_") for name in images.HASHES
        }
        self.histogram = stack("histogram", np.int64)
        self.aspect = rows["aspect"].to_numpy(np.float64)

    def meets(self, one: int, many: np.ndarray) -> np.ndarray:
        def best(score) -> np.ndarray:
            return np.maximum(score("", ""), np.maximum(score("center_", ""), score("", "center_")))

        def alike(name: str, p: str, q: str) -> np.ndarray:
            differing = self.hashes[p, name][one] ^ self.hashes[q, name][many]
            return 1 - np.bitwise_count(differing.view(np.uint64)) / 64.0

        def levels(p: str, q: str) -> np.ndarray:
            apart = np.abs(self.luminance[p][one] - self.luminance[q][many])
            return 1 - apart.sum(axis=1) / apart.shape[1] / 255.0

        structure = best(levels)
        difference = best(lambda p, q: (alike("difference_h", p, q) + alike("difference_v", p, q)) / 2)
        average = best(lambda p, q: alike("average", p, q))
        apart = np.abs(self.histogram[one] - self.histogram[many]).sum(axis=1)
        color = np.clip(1 - apart / float(3 * images.SIDE * images.SIDE), 0, 1)
        aspect = np.minimum(self.aspect[one] / self.aspect[many], self.aspect[many] / self.aspect[one])
        scores = {"structure": structure, "difference": difference, "average": average, "color": color, "aspect": aspect}
        composite = sum(weight * scores[name] for name, weight in images.WEIGHTS.items())
        return np.logical_and.reduce([(composite if name == "composite" else scores[name]) >= least for name, least in self.limits.items()])


def _admit(order: list[int], scorer: _Scorer, taken: list[int]) -> list[int]:
    """Rows of `order` that reach the thresholds with everything taken before them."""
    for row in order:
        if not taken or bool(np.all(scorer.meets(row, np.array(taken)))):
            taken.append(row)
    return taken


def _settle_component(sensitivity: str):
    def settle(vertices: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        vertices = vertices.sort_values("pos").reset_index(drop=True)
        row_of = {pos: row for row, pos in enumerate(vertices["pos"])}
        neighbours: list[list[int]] = [[] for _ in row_of]
        for first, second in zip(edges["first_pos"], edges["second_pos"]):
            neighbours[row_of[first]].append(row_of[second])
            neighbours[row_of[second]].append(row_of[first])
        scorer, free, found = _Scorer(vertices, sensitivity), [True] * len(row_of), []
        copies = vertices["copies"].to_numpy()
        degrees = [int(copies[around].sum() + copies[row] - 1) for row, around in enumerate(neighbours)]
        for anchor in sorted(range(len(row_of)), key=lambda row: (-degrees[row], row)):
            around = sorted(row for row in neighbours[anchor] if free[row]) if free[anchor] else []
            if not around:
                continue
            # neighbours reach the thresholds with the anchor itself
            for row in [anchor, *_admit(around, scorer, [])]:
                free[row] = False
                found.append((vertices["pos"][anchor], vertices["pos"][row]))
        return pd.DataFrame(found, columns=["anchor_pos", "pos"])

    return settle


def _settle_small(vertices: DataFrame, edges: DataFrame, sensitivity: str) -> DataFrame:
    left = vertices.select("component", "pos", "copies", *images.FINGERPRINT).groupBy("component")
    right = edges.select("component", "first_pos", "second_pos").groupBy("component")
    return left.cogroup(right).applyInPandas(_settle_component(sensitivity), MEMBERS)


def _settle_links(vertices: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """The same where the edges are all pairs that reach the thresholds: whoever is admitted must be a neighbour of all taken before."""
    vertices = vertices.sort_values("pos")
    pos, copies = vertices["pos"].to_numpy(), vertices["copies"].to_numpy()
    ends = [np.searchsorted(pos, edges[name].to_numpy()).astype(np.int32) for name in ("first_pos", "second_pos")]
    source, target = np.concatenate(ends), np.concatenate(ends[::-1])
    degrees = np.bincount(source, copies[target], len(pos)).astype(np.int64) + copies - 1
    order = np.lexsort((target, source))
    target, bounds = target[order], np.searchsorted(source[order], np.arange(len(pos) + 1))
    free, found = np.ones(len(pos), bool), []
    for anchor in np.lexsort((np.arange(len(pos)), -degrees)):
        common = target[bounds[anchor] : bounds[anchor + 1]]
        common = common[free[common]]
        if not free[anchor] or not len(common):
            continue
        taken = [anchor]
        while len(common):
            row = common[0]
            taken.append(row)
            common = np.intersect1d(common[1:], target[bounds[row] : bounds[row + 1]], assume_unique=True)
        free[taken] = False
        found += [(pos[anchor], pos[row]) for row in taken]
    return pd.DataFrame(found, columns=["anchor_pos", "pos"])


def _settle_prints(sensitivity: str):
    """The same from the fingerprints of a component: an anchor is compared with all that are free, and who is admitted with those still left."""

    def close(one: images.Prints, many: images.Side) -> tuple[np.ndarray, np.ndarray]:
        found = [(j, scores["composite"]) for _, j, scores in images.close_pairs(images.Side(one), many, sensitivity, False)]
        return tuple(np.concatenate(parts) for parts in zip(*found)) if found else (np.zeros(0, int), np.zeros(0))

    def settle(vertices: pa.Table) -> pa.Table:
        vertices = vertices.sort_by("pos")
        pos, degrees = vertices["pos"].to_numpy(), vertices["degree"].to_numpy()
        prints = images.Prints.unpacked(vertices["print"].to_pylist())
        left, side = np.arange(len(pos)), images.Side(prints)  # free ones, and some that were taken since
        free, found, shared = np.ones(len(pos), bool), [], side.shared is not None
        whole = side
        for anchor in np.lexsort((np.arange(len(pos)), -degrees)):
            if not free[anchor]:
                continue
            if 4 * np.count_nonzero(free[left]) < 3 * len(left):
                left = left[free[left]]
                side = images.Side(prints.taken(left))
            one = prints.taken(np.array([anchor]))
            if shared:  # strengths are only needed of those that are taken
                near = [columns.start + np.flatnonzero(masks[0][0]) for _, columns, masks in images.close_masks(images.Side(one), side, sensitivity, False)]
                common = left[np.concatenate(near)] if near else left[:0]
                common = common[free[common] & (common != anchor)]
            else:
                near, strength = close(one, side)
                common = left[near]
                kept = np.flatnonzero(free[common] & (common != anchor))
                common, strength = common[kept], strength[kept]
            if not len(common):
                continue
            taken, weakest = [anchor], [np.nan]
            while len(common):
                taken.append(common[0])
                if shared:
                    common = common[1:][images.close_to(whole, common[0], common[1:], sensitivity)]
                else:
                    weakest.append(strength[0])
                    fits, _ = close(prints.taken(common[:1]), images.Side(prints.taken(common[1:])))
                    common, strength = common[1:][fits], strength[1:][fits]
            if shared:
                weakest += list(close(one, images.Side(prints.taken(np.array(taken[1:]))))[1])
            free[taken] = False
            found.append((np.full(len(taken), pos[anchor]), pos[taken], np.array(weakest)))
        columns = [np.concatenate(parts) for parts in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], from_pandas=True)], names=["anchor_pos", "pos", "composite"])

    return settle


def _settle_turns(sensitivity: str):
    def settle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("look_pos").reset_index(drop=True)
        kept = _admit(list(range(len(rows))), _Scorer(rows, sensitivity), [])
        return rows.loc[kept, ["anchor_pos", "look"]]

    return settle


def _ready(both: DataFrame, degrees: DataFrame) -> DataFrame:
    """Free anchors that come first among everything within two steps."""
    turn = F.struct((-F.col("degree")).alias("order"), F.col("pos").alias("pos"))
    own = degrees.join(both.select("pos").distinct(), "pos", "left_semi").select("pos", turn.alias("turn"))

    def around(values: DataFrame, name: str) -> DataFrame:
        seen = both.join(values.select(F.col("pos").alias("other"), F.col(name).alias("_near")), "other")
        best = seen.groupBy("pos").agg(F.min("_near").alias("_near"))
        return values.join(best, "pos").select("pos", F.least(name, "_near").alias(name))

    one_step = materialize(around(own, "turn"))
    two_steps = around(one_step, "turn")
    return two_steps.filter(F.col("turn.pos") == F.col("pos")).select(F.col("pos").alias("anchor_pos"))


def _settle_large(placed: DataFrame, edges: DataFrame, sensitivity: str) -> DataFrame:
    """Groups of components of any size, in rounds of independent anchors.

    Images with equal fingerprints share a fate at every anchor: once one is taken the others reach all
    thresholds as well, and once one is refused so are they. Turns therefore handle each `look` once.
    """
    vertices = edges.select(F.col("first_pos").alias("pos")).union(edges.select("second_pos")).distinct()
    mine = placed.join(vertices, "pos", "left_semi")
    looks = materialize(mine.groupBy(*images.FINGERPRINT).agg(F.min("pos").alias("look")))
    look_of = materialize(
        mine.join(looks, list(images.FINGERPRINT)).select("pos", "look")
    )
    free = materialize(_both_ways(edges))
    own = mine.select("pos", "copies")
    around = free.join(own.withColumnsRenamed({"pos": "other", "copies": "_copies"}), "other").groupBy("pos").agg(F.sum("_copies").alias("_around"))
    degrees = materialize(around.join(own, "pos").select("pos", (F.col("_around") + F.col("copies") - 1).alias("degree")))
    found: list[DataFrame] = []
    while not free.isEmpty():
        anchors = materialize(_ready(free, degrees))
        near = materialize(
            free.join(anchors.withColumnRenamed("anchor_pos", "pos"), "pos", "left_semi")
            .select(F.col("pos").alias("anchor_pos"), F.col("other").alias("pos"))
            .join(look_of, "pos")
        )
        waiting = near.groupBy("anchor_pos", "look").agg(F.min("pos").alias("look_pos"))
        taken: list[DataFrame] = []
        while True:
            numbered = materialize(
                ranking.running_count(
                    waiting.withColumn("_block", F.floor(F.col("look_pos") / RANK_BLOCK)),
                    ["anchor_pos"], [F.col("look_pos")], F.lit(1), "_turn",
                ).drop("_block")
            )
            if numbered.isEmpty():
                break
            turn = numbered.filter(F.col("_turn") <= TURN_SIZE).join(looks, "look")
            kept = materialize(
                turn.groupBy("anchor_pos").applyInPandas(_settle_turns(sensitivity), "anchor_pos long, look long")
            )
            taken = _gathered([*taken, kept])
            # at most TURN_SIZE looks per anchor
            admitted = (
                kept.join(looks, "look")
                .groupBy("anchor_pos")
                .agg(F.collect_list(F.struct(*images.FINGERPRINT)).alias("_admitted"))
            )
            candidate = F.struct(*images.FINGERPRINT)
            waiting = (
                numbered.filter(F.col("_turn") > TURN_SIZE)
                .join(looks, "look")
                .join(admitted, "anchor_pos")
                .filter(F.forall("_admitted", lambda one: images.meets(sensitivity, _with_composite(candidate, one))))
                .select("anchor_pos", "look", "look_pos")
            )
        looks_taken = reduce(DataFrame.unionByName, taken)
        members = near.join(looks_taken, ["anchor_pos", "look"], "left_semi").select("anchor_pos", "pos")
        heads = anchors.select("anchor_pos", F.col("anchor_pos").alias("pos"))
        grouped = materialize(members.unionByName(heads))
        found = _gathered([*found, grouped])
        gone = grouped.select("pos")
        free = materialize(
            free.join(gone, "pos", "left_anti").join(gone.withColumnRenamed("pos", "other"), "other", "left_anti")
        )
    return reduce(DataFrame.unionByName, found)


def _with_composite(a: Column, b: Column) -> dict[str, Column]:
    of = images.scores(a, b)
    return {**of, "composite": images.composite(of)}


def complete_link_groups(
    placed: DataFrame, related: DataFrame, sensitivity: str = "Balanced", component_limit: int = COMPONENT_LIMIT,
    edge_limit: int | None = None, prints: DataFrame | None = None,
) -> SimilarGroups:
    """Groups (group_id, representative_id, first_path, photos, tier) and members (group_id, item_id, ...).

    `placed` are fingerprints with positions, `related` the pairs from `relationships`. The tier is that of
    the weakest strength between the representative and a member. With a column `copies`, a row stands for so many images of
    equal fingerprints, which are linked with each other and share their links; `photos` counts them, members are the rows.
    With an `edge_limit`, `related` are known to be all pairs that reach the thresholds: components of so many are settled in one task from
    their links alone, and no fingerprint is fetched; those of larger ones are in `prints`, or else in `placed`.
    """
    if "copies" not in placed.columns:
        placed = placed.withColumn("copies", F.lit(1).cast("long"))
    edges = materialize(related.select("first_pos", "second_pos", "composite").distinct())
    spark = placed.sparkSession
    if edges.isEmpty():
        members = spark.createDataFrame([], MEMBERS)
    else:
        components = connected_components(edges)
        of_edge = components.select(F.col("pos").alias("first_pos"), "component")
        labelled = materialize(edges.join(of_edge, "first_pos"))
        counted = components if edge_limit is None else labelled
        fitting = F.col("_n") <= (component_limit if edge_limit is None else edge_limit)
        sizes = materialize(counted.groupBy("component").agg(F.count(F.lit(1)).alias("_n")))
        fits = sizes.filter(fitting).select("component")
        small, its_edges = components.join(fits, "component"), labelled.join(fits, "component")
        if edge_limit is None:
            settled = _settle_small(placed.join(small, "pos"), its_edges, sensitivity)
        else:
            left = placed.select("pos", "copies").join(small, "pos").groupBy("component")
            right = its_edges.select("component", "first_pos", "second_pos").groupBy("component")
            settled = left.cogroup(right).applyInPandas(_settle_links, MEMBERS)
        members = materialize(settled)
        large = sizes.filter(~fitting).select("component")
        if not large.isEmpty():
            its_edges = labelled.join(large, "component").select("first_pos", "second_pos")
            members = members.unionByName(_settle_large(placed if prints is None else prints, materialize(its_edges), sensitivity))
    # whatever is left has no free neighbour: copies of one another are a group of their own
    alone = placed.filter("copies > 1").select("pos").join(members.select("pos"), "pos", "left_anti")
    return _describe(placed, edges, members.unionByName(alone.select(F.col("pos").alias("anchor_pos"), "pos")))


def _counted_groups(found: Looks, counts: DataFrame, sensitivity: str, prints: DataFrame, print_limit: int) -> SimilarGroups:
    """`complete_link_groups` of looks without their pairs: degrees and components are in `counts`, and a component of fingerprints of up to
    `print_limit` bytes compares what it must in one task. Pairs are only written for larger ones, which are settled in rounds."""
    degrees = counts.groupBy("pos").agg(F.sum("images").alias("_around"))
    edges = counts.select(F.col("reached").alias("first_pos"), F.col("pos").alias("second_pos")).filter("first_pos <> second_pos").distinct()
    edges = materialize(edges)
    linked, settled = found.looks.limit(0).select("pos"), None
    if not edges.isEmpty():
        components = connected_components(edges)
        vertices = found.looks.join(components, "pos")
        sizes = materialize(vertices.groupBy("component").agg(F.sum(F.octet_length("print")).alias("_bytes")))
        small, large = (sizes.filter(f"_bytes {sign} {print_limit}").select("component") for sign in ("<=", ">"))
        rows = vertices.join(small, "component").join(degrees, "pos").select(
            "component", "pos", (F.col("_around") + F.col("copies") - 1).alias("degree"), "print"
        )
        settled = materialize(rows.groupBy("component").applyInArrow(_settle_prints(sensitivity), f"{MEMBERS}, composite double"))
        if not large.isEmpty():
            pairs = close_looks(vertices.join(large, "component").drop("component"), sensitivity)
            pairs = materialize(pairs.select("first_pos", "second_pos", "composite"))
            members = _settle_large(prints, pairs.select("first_pos", "second_pos"), sensitivity)
            of = F.least("anchor_pos", "pos").alias("first_pos"), F.greatest("anchor_pos", "pos").alias("second_pos")
            rounds = members.select("*", *of).join(pairs, ["first_pos", "second_pos"], "left").select("anchor_pos", "pos", "composite")
            settled = settled.unionByName(materialize(rounds))
        linked = settled.select("pos")
    alone = found.looks.filter("copies > 1").select("pos").join(linked, "pos", "left_anti")
    alone = alone.select(F.col("pos").alias("anchor_pos"), "pos", F.lit(None).cast("double").alias("composite"))
    members = alone if settled is None else settled.unionByName(alone)
    strengths = members.filter("composite IS NOT NULL").groupBy("anchor_pos").agg(F.min("composite").alias("weakest"))
    return _named(found.looks, strengths, members.select("anchor_pos", "pos"))


def look_groups(
    placed: DataFrame, found: Looks, close: DataFrame, sensitivity: str = "Balanced", edge_limit: int = EDGE_LIMIT, print_limit: int = PRINT_LIMIT
) -> SimilarGroups:
    """Complete-link groups of all images from the links between their looks; each image of a look is a member.

    `close` are the pairs of `close_looks`, or the rows of `close_counts` where too many are linked for pairs to be written. Equal images reach
    all thresholds with the same others, so that at every anchor they are taken or refused together.
    """
    prints = found.looks.select("pos", "copies").join(placed.select("pos", *images.FINGERPRINT), "pos")
    if "reached" in close.columns:
        grouped = _counted_groups(found, close, sensitivity, prints, print_limit)
    else:
        grouped = complete_link_groups(found.looks, close, sensitivity, edge_limit=edge_limit, prints=prints)
    looks = grouped.members.join(found.looks.select("item_id", F.col("pos").alias("look")), "item_id").select("group_id", "look")
    return SimilarGroups(grouped.groups, found.images.join(looks, "look").select("group_id", "item_id", "path"))


def _describe(placed: DataFrame, edges: DataFrame, members: DataFrame) -> SimilarGroups:
    # anchor and member are neighbours, so their strength is the composite of an edge
    strengths = members.filter("anchor_pos <> pos").select(
        F.least("anchor_pos", "pos").alias("first_pos"), F.greatest("anchor_pos", "pos").alias("second_pos"), "anchor_pos"
    )
    weakest = strengths.join(edges, ["first_pos", "second_pos"]).groupBy("anchor_pos").agg(F.min("composite").alias("weakest"))
    return _named(placed, weakest, members)


def _named(placed: DataFrame, weakest: DataFrame, members: DataFrame) -> SimilarGroups:
    sizes = members.join(placed.select("pos", "copies"), "pos").groupBy("anchor_pos").agg(F.sum("copies").alias("photos"))
    heads = placed.select(F.col("pos").alias("anchor_pos"), "item_id", "path")
    equal = images.composite({name: F.lit(1.0) for name in images.WEIGHTS})
    groups = sizes.join(weakest, "anchor_pos", "left").join(heads, "anchor_pos").select(
        F.col("item_id").alias("group_id"),
        F.col("item_id").alias("representative_id"),
        F.col("path").alias("first_path"),
        "photos",
        group_tier(F.coalesce("weakest", equal)).alias("tier"),
        "anchor_pos",
    )
    named = (
        members.join(placed.select("pos", "item_id", "path"), "pos")
        .join(groups.select("anchor_pos", "group_id"), "anchor_pos")
        .select("group_id", "item_id", "path")
    )
    return SimilarGroups(groups.drop("anchor_pos"), named)


def group_tier(weakest: Column | str) -> Column:
    """Tier of a group by its weakest strength between representative and member."""
    return images.tier(weakest)

"""Near-duplicate documents by an LSH forest of sorted signature orders.

Method: a document's shingle set gives TREES sequences of DEPTH minimum hashes. Each tree is the order of all
sets by its sequence, so that sets with a long common prefix are neighbours. Sets with the same first MIN_DEPTH values are a region.
A region of up to LEAF sets is a leaf; a larger one is cut by its next value, and its parts by the one after, as deep as it takes until they
are leaves. What such a cut parts is kept together by another: an over-full region is cut anew by each of BANDS bands of BAND codes, and the
parts up to LEAF are leaves, too. Candidates are the pairs of a leaf, filtered by the estimate from all TREES * DEPTH values, which travel
along as one byte each.

A group of near copies stays in one part of any cut. There the set that agrees most with its region, the
pivot, is paired with all; pairs of sets that are both clearly like the same pivot add nothing. Sets of a part that is still
larger than LEAF after a band become queries unless they are joined in the end with every pivot of their region, or are clearly
like one and far from the others; so does a set that seemed clearly like a pivot and is not joined with it. Queries are compared with all
sets that have candidates, in blocks of bounded size, by their shingles.

All candidates are verified on full shingle sets: those with pivots first; of the others those that still join
different components. Equal sets are one node from the start, so copies are never compared. A region is dealt to one task, whole. One above
REGION sets is dealt out by ranges of (tree, values, id); every pivot of a part and every set that is not clearly like one becomes a query,
so that these do not depend on where the ranges cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duploscope.llm import words
from duploscope.llm.columns import bounded_batches, text_or_empty
from duploscope.operators.grouping import connected_components
from duploscope.session import materialize

WIDTH = 5
PERCENT = 80  # 100 * shared >= PERCENT * union
TREES, DEPTH = 16, 8
MIN_DEPTH = 2
LEAF = 64
REGION = 50_000  # sets of a region that are kept in one task: some 10 MB
BAND, BANDS = 4, 31  # codes outside the region's own MIN_DEPTH: at 0.8 all bands part a pair with a chance of 8e-8, as all trees do
MARGIN = 0.13  # below the threshold by the estimate: 3.7 standard deviations
CLEAR = 0.1  # above it
REACH_MARGIN = 0.16  # below the likeness of sets that are two links apart: 3.7 standard deviations
BLOCK_BYTES = 16 << 20  # shingles of one block of queries
BROADCAST_IDS = 2_000_000  # ids of sets to be fetched, up to which they are broadcast: 16 MB

_HASHES = TREES * DEPTH
# why a pair is named: a leaf, a pivot, a member of a crowded region and a pivot of it, or a set clearly like its pivot
_PLAIN, _CENTRAL, _CROWDED, _CLEAR, _LONE = 1, 2, 4, 8, 16  # the last names a set alone: the only one of its region in a task
_flips = words.mixed(np.arange(1, _HASHES + 1, dtype=np.uint64)).astype(np.uint32)
_factors = words.mixed(np.arange(1001, 1001 + _HASHES, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def _sets(part: words.Slice, width: int) -> words.Shingles:
    found = words.words(part)
    return words.shingles(found.hashes, found.bounds, width)


def _signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: list[int] = []
        keys: list[bytes | None] = []
        values: list[bytes | None] = []
        codes: list[bytes | None] = []
        for part in words.slices(batch.column("text")):
            grams = _sets(part, width)
            filled = np.flatnonzero(np.diff(grams.bounds))
            minima = np.empty((_HASHES, len(filled)), np.uint32)
            if len(filled):
                short, begin = (grams.hashes >> np.uint64(32)).astype(np.uint32), grams.bounds[filled]
                for number in range(_HASHES):
                    np.minimum.reduceat((short ^ _flips[number]) * _factors[number], begin, out=minima[number])
            ordered = np.ascontiguousarray(minima.T).astype(">u4")
            low = np.ascontiguousarray(minima.T).astype(np.uint8)
            at = 0
            for row in range(len(part.bounds) - 1):
                own = words.distinct(grams.hashes[grams.bounds[row] : grams.bounds[row + 1]])
                counts.append(len(own))
                if not len(own):
                    keys.append(None), values.append(None), codes.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                values.append(ordered[at].tobytes())
                codes.append(low[at].tobytes())
                at += 1
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()),
                pa.array(values, pa.binary()), pa.array(codes, pa.binary()),
            ],
            names=["doc_id", "n_shingles", "set_key", "signature", "codes"],
        )


class _Region(NamedTuple):
    """Neighbouring rows of one order."""

    values: np.ndarray
    ids: np.ndarray
    sizes: np.ndarray
    codes: np.ndarray
    tree: int = 0


class _Finder:
    """Candidate pairs of the regions of one task."""

    def __init__(self, percent: int) -> None:
        self.likely = percent / 100 - MARGIN
        self.clear = percent / 100 + CLEAR
        self.percent = percent
        self.first: list[np.ndarray] = []
        self.second: list[np.ndarray] = []
        self.why: list[np.ndarray] = []

    def _like(self, region: _Region, one: int, others: np.ndarray) -> np.ndarray:
        """Estimated likeness; nothing where the sizes alone rule a link out."""
        alike = (region.codes[others] == region.codes[one]).mean(axis=1)
        small = np.minimum(region.sizes[others], region.sizes[one])
        large = np.maximum(region.sizes[others], region.sizes[one])
        return np.where(100 * small >= self.percent * large, alike, 0.0)

    def _emit(self, region: _Region, one: int, others: np.ndarray, why: int) -> None:
        ids, own = region.ids[others], region.ids[one]
        self.first.append(np.minimum(ids, own))
        self.second.append(np.maximum(ids, own))
        self.why.append(np.full(len(ids), why))

    def _pivots(self, region: _Region, members: np.ndarray, paired: np.ndarray, pivot_of: np.ndarray) -> None:
        """Pairs members with the most typical one among them, and again those that are not like it, while that gains."""
        rest = members[paired[members] < 0]
        while len(rest) > LEAF:
            some = region.codes[rest[:: max(1, len(rest) // 256)]]  # enough to see the commonest values
            typical = np.array([np.bincount(column, minlength=256).argmax() for column in some.T], np.uint8)
            pivot = rest[(region.codes[rest] == typical).sum(axis=1).argmax()]
            others = rest[rest != pivot]
            like = self._like(region, pivot, others)
            near = others[like >= self.likely]
            self._emit(region, pivot, near, _CENTRAL)
            paired[near] = paired[pivot] = pivot
            clear = others[like >= self.clear]
            self._emit(region, pivot, clear, _CLEAR)
            pivot_of[clear] = pivot_of[pivot] = pivot
            if len(near) < max(1, len(rest) // 50):
                return
            rest = others[like < self.likely]

    def _leaf(self, region: _Region, members: np.ndarray, pivot_of: np.ndarray) -> None:
        for place in range(len(members) - 1):
            one, others = members[place], members[place + 1 :]
            others = others[(pivot_of[others] != pivot_of[one]) | (pivot_of[others] < 0)]
            if len(others):
                self._emit(region, one, others[self._like(region, one, others) >= self.likely], _PLAIN)

    def _crowded(self, region: _Region, members: np.ndarray, pivot_of: np.ndarray) -> None:
        """Names members with the pivots of the region, so that one that is apart from any of them in the end is searched exactly.

        A set that is not clearly like a pivot is named with every pivot that has sets of its own. One that is clear of a pivot is named
        with those of more sets, where a set linked to both may be: at the distances of two links.
        """
        pivots, counts = np.unique(pivot_of[pivot_of >= 0], return_counts=True)
        alone = pivots[counts == 1]  # pivots that are like no other set
        order = np.argsort(-counts[counts > 1], kind="stable")
        pivots = pivots[counts > 1][order]
        unclear = members[(pivot_of[members] < 0) | np.isin(members, alone)]
        if not len(pivots):
            self._emit(region, members[0], unclear[unclear != members[0]], _CROWDED)
        reach = 1 - 2 * (1 - self.percent / 100) - REACH_MARGIN
        rank = np.full(len(region.ids), -1)
        rank[pivots] = np.arange(len(pivots))
        clear = members[np.isin(pivot_of[members], pivots)]
        for place, pivot in enumerate(pivots):
            self._emit(region, pivot, unclear, _CROWDED)
            fewer = clear[rank[pivot_of[clear]] > place]
            alike = (region.codes[fewer] == region.codes[pivot]).mean(axis=1)
            self._emit(region, pivot, fewer[alike >= reach], _CROWDED)

    def _bands(self, region: _Region, paired: np.ndarray, pivot_of: np.ndarray) -> np.ndarray:
        """Pairs that meet in a part of up to LEAF rows with equal codes of a band; returns the members of larger parts."""
        free = np.delete(np.arange(_HASHES), region.tree * DEPTH + np.arange(MIN_DEPTH))
        bands = free[: BAND * BANDS].reshape(BAND, BANDS).T
        codes = np.ascontiguousarray(region.codes[:, bands.ravel()]).view(np.uint32)  # one value a band
        crowded = np.zeros(len(region.ids), bool)
        for band in range(BANDS):
            order = np.argsort(codes[:, band], kind="stable")
            ranked = codes[order, band]
            cut = np.flatnonzero(np.diff(ranked)) + 1
            sizes = np.diff(np.concatenate(([0], cut, [len(order)])))
            full = np.repeat(sizes > LEAF, sizes)
            for part in np.split(order, cut) if full.any() else ():
                if len(part) > LEAF:
                    self._pivots(region, part, paired, pivot_of)
            crowded[order[full]] = True
            order, ranked = order[~full], ranked[~full]
            for shift in range(1, LEAF):
                at = np.flatnonzero(ranked[shift:] == ranked[:-shift])
                if not len(at):
                    break
                self._met(region, order[at], order[at + shift], pivot_of, codes, band)
        return np.flatnonzero(crowded)

    def _met(self, region: _Region, one: np.ndarray, other: np.ndarray, pivot_of: np.ndarray, codes: np.ndarray, band: int) -> None:
        """Emits the likely ones of the pairs, those that met in an earlier band left out."""
        wanted = (pivot_of[one] != pivot_of[other]) | (pivot_of[one] < 0)
        small, large = np.minimum(region.sizes[one], region.sizes[other]), np.maximum(region.sizes[one], region.sizes[other])
        wanted = np.flatnonzero(wanted & (100 * small >= self.percent * large))
        for start in range(0, len(wanted), 8192):
            a, b = one[wanted[start : start + 8192]], other[wanted[start : start + 8192]]
            new = ~(codes[a, :band] == codes[b, :band]).any(axis=1)
            a, b = a[new], b[new]
            likely = (region.codes[a] == region.codes[b]).mean(axis=1) >= self.likely
            ids, others = region.ids[a[likely]], region.ids[b[likely]]
            self.first.append(np.minimum(ids, others))
            self.second.append(np.maximum(ids, others))
            self.why.append(np.full(len(ids), _PLAIN))

    def _alone(self, region: _Region, members: np.ndarray) -> None:
        """Names members as queries, whatever they are joined with."""
        ids = region.ids[members]
        self.first.append(ids)
        self.second.append(ids)
        self.why.append(np.full(len(ids), _LONE))

    def _neighbours(self, region: _Region, paired: np.ndarray) -> None:
        """Pairs of the leaves by common prefixes, each as deep as its part of the region is full; of sets that are paired with the same
        pivot, those that are not joined by it are left to the bands."""
        waiting = [(0, len(region.ids), MIN_DEPTH)]
        while waiting:
            low, high, depth = waiting.pop()
            if high - low <= LEAF:
                self._leaf(region, np.arange(low, high), paired)
            elif depth < DEPTH:
                values = region.values[low:high, depth]
                cuts = np.concatenate(([0], np.flatnonzero(values[1:] != values[:-1]) + 1, [high - low]))
                waiting += [(low + a, low + b, depth + 1) for a, b in zip(cuts.tolist(), cuts[1:].tolist()) if b - a > 1]

    def search(self, region: _Region, cut: bool = False) -> None:
        """Candidates of a region; with `cut` it is only a part of one, whose other sets are elsewhere."""
        size = len(region.ids)
        members, paired, pivot_of = np.arange(size), np.full(size, -1), np.full(size, -1)
        if size < 2 or (cut and size <= LEAF):
            if cut:
                self._alone(region, members)
            return
        if size <= LEAF:
            self._leaf(region, members, pivot_of)
            return
        self._pivots(region, members, paired, pivot_of)
        if cut:
            self._crowded(region, members, pivot_of)
            self._alone(region, members[(pivot_of < 0) | (pivot_of == members)])
            return
        self._neighbours(region, paired)
        crowded = self._bands(region, paired, pivot_of)
        if len(crowded):
            self._crowded(region, crowded, pivot_of)

    def batch(self) -> pa.RecordBatch:
        parts = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (self.first, self.second, self.why)]
        self.first, self.second, self.why = [], [], []
        order = np.lexsort((parts[1], parts[0]))
        first, second, why = (part[order] for part in parts)
        if len(first):
            begin = np.flatnonzero(np.concatenate(([True], (np.diff(first) != 0) | (np.diff(second) != 0))))
            first, second, why = first[begin], second[begin], np.bitwise_or.reduceat(why, begin)
        return pa.RecordBatch.from_arrays(
            [pa.array(first), pa.array(second), pa.array(why.astype(np.int32))], names=["first_pos", "second_pos", "why"]
        )


def _candidates(batches: Iterator[pa.RecordBatch], percent: int, cut: bool) -> Iterator[pa.RecordBatch]:
    """Pairs of a task's share of the orders. Only the region that a batch leaves unfinished is carried to the next; with `cut`, a task's
    share may begin and end inside of regions."""
    finder = _Finder(percent)
    kept: list[pa.RecordBatch] = []

    def regions(rows: pa.Table, upto: int, heads: np.ndarray) -> None:
        values = np.frombuffer(b"".join(rows["values"].to_pylist()), ">u4").reshape(-1, DEPTH)
        codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), np.uint8).reshape(-1, _HASHES)
        ids, sizes, tree = rows["rep"].to_numpy(), rows["n_shingles"].to_numpy(), rows["tree"].to_numpy()
        for low, high in zip(heads, [*heads[1:], upto]):
            if cut or high - low > 1:
                finder.search(_Region(values[low:high], ids[low:high], sizes[low:high], codes[low:high], int(tree[low])), cut)

    def heads_of(rows: pa.Table) -> np.ndarray:
        values = np.frombuffer(b"".join(rows["values"].to_pylist()), ">u4").reshape(-1, DEPTH)[:, :MIN_DEPTH]
        tree = rows["tree"].to_numpy()
        new = (values[1:] != values[:-1]).any(axis=1) | (tree[1:] != tree[:-1])
        return np.concatenate(([0], np.flatnonzero(new) + 1))

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*kept, batch])
        heads = heads_of(rows)
        if len(heads) > 1:
            regions(rows, heads[-1], heads[:-1])
            kept = rows.slice(heads[-1]).combine_chunks().to_batches()
        else:
            kept.append(batch)
        if sum(map(len, finder.first)) > 100_000:
            yield finder.batch()
    if kept:
        rows = pa.Table.from_batches(kept)
        regions(rows, rows.num_rows, np.zeros(1, np.int64))
    yield finder.batch()


def _full_sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = []
        for part in words.slices(batch.column("text")):
            grams = _sets(part, width)
            sets += [words.distinct(grams.hashes[a:b]).tobytes() for a, b in zip(grams.bounds, grams.bounds[1:])]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["id", "shingles"])


def _verified(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for one, other in zip(batch.column("left"), batch.column("right")):
            a = np.frombuffer(one.as_buffer(), np.uint64)
            b = np.frombuffer(other.as_buffer(), np.uint64)
            a, b = (a, b) if len(a) <= len(b) else (b, a)
            places = np.searchsorted(b, a)
            shared = int((b[np.minimum(places, len(b) - 1)] == a).sum())
            keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
        yield batch.select(["first_pos", "second_pos"]).filter(pa.array(keep, pa.bool_()))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    first = sets.select(F.col("id").alias("first_pos"), F.col("shingles").alias("left"))
    second = sets.select(F.col("id").alias("second_pos"), F.col("shingles").alias("right"))
    joined = pairs.select("first_pos", "second_pos").join(first, "first_pos").join(second, "second_pos")
    return materialize(
        joined.select("first_pos", "second_pos", "left", "right").mapInArrow(
            lambda batches: _verified(batches, percent), "first_pos long, second_pos long"
        )
    )


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of (doc_id, text).

    A document's set has the distinct runs of `width` words (A-Z lowered); fewer words make one run of them all. Documents are linked
    where 100 * shared >= percent * union of their sets; `component_id` is the smallest doc_id that links
    reach, and `kept` marks the document that has it. Null texts and texts without words have no set and no links.
    Rows that repeat a doc_id are one document: their texts are in one component, and all of them bear its decision. A null doc_id
    names nothing: such a row is linked with nothing and kept, with a null component. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    signed = materialize(
        given.mapInArrow(
            lambda batches: _signatures(batches, width),
            "doc_id long, n_shingles long, set_key binary, signature binary, codes binary",
        )
    )
    named = signed.filter("doc_id IS NOT NULL AND set_key IS NOT NULL")
    nodes = materialize(
        named.groupBy("set_key", "n_shingles")
        .agg(F.min(F.struct("doc_id", "signature", "codes")).alias("_one"))
        .select("set_key", "n_shingles", F.col("_one.doc_id").alias("rep"), "_one.signature", "_one.codes")
    )
    rows = nodes.select(
        F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "rep", "n_shingles", "signature", "codes"
    ).select(
        "tree", F.expr(f"substring(signature, tree * {DEPTH * 4} + 1, {DEPTH * 4})").alias("values"), "rep", "n_shingles", "codes"
    )
    order, region = ["tree", "values", "rep"], ["tree", "head"]
    rows = rows.withColumn("head", F.substring("values", 1, MIN_DEPTH * 4))
    full = materialize(rows.groupBy(*region).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > REGION).drop("n"))
    kinds = "first_pos long, second_pos long, why int"
    if full.isEmpty():
        whole, found = rows, []
    else:
        whole = rows.join(full, region, "left_anti")
        parted = rows.join(full, region, "left_semi").drop("head").repartitionByRange(*order).sortWithinPartitions(*order)
        found = [parted.mapInArrow(lambda batches: _candidates(batches, percent, True), kinds)]
    dealt = whole.repartition(*region).drop("head").sortWithinPartitions(*order)
    found.append(dealt.mapInArrow(lambda batches: _candidates(batches, percent, False), kinds))
    pairs = materialize(
        reduce(DataFrame.unionByName, found)
        .filter(f"first_pos <> second_pos OR why = {_LONE}")
        .groupBy("first_pos", "second_pos")
        .agg(F.bit_or("why").alias("why"))
    )
    ids = materialize(
        pairs.select(F.explode(F.array("first_pos", "second_pos")).alias("doc_id")).distinct()
    )
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    sets = materialize(
        given.join(wanted, "doc_id", "left_semi")
        .mapInArrow(lambda batches: _full_sets(batches, width), "id long, shingles binary")
    )
    central = _links(pairs.filter(f"why & {_CENTRAL} > 0"), sets, percent)
    components = connected_components(central)
    plain = _apart(pairs.filter(f"why & {_CENTRAL} = 0 AND why & {_PLAIN} > 0"), components)
    components = _merged(components, _links(plain, sets, percent).unionByName(_same_document(named, nodes)))
    crowded = _apart(pairs.filter(f"why & {_CROWDED | _CLEAR} > 0"), components).select("first_pos", "second_pos")
    queries = materialize(
        crowded.unionByName(pairs.filter(f"why & {_LONE} > 0").select("first_pos", "second_pos"))
        .select(F.explode(F.array("first_pos", "second_pos")).alias("id"))
        .distinct()
        .join(sets, "id")
    )
    size = queries.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0
    if size:
        components = _merged(components, _linked_with(queries, sets, percent, -(-size // BLOCK_BYTES)))
    return (
        signed.join(nodes.select("set_key", F.col("rep").alias("_rep")), "set_key", "left")
        .join(components.select(F.col("pos").alias("_rep"), "component"), "_rep", "left")
        .select(
            "doc_id", "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "_rep", "doc_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def _labelled(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Adds the components of both sides, `_first` and `_second`; a set without one is its own."""
    for side, name in (("first_pos", "_first"), ("second_pos", "_second")):
        label = components.select(F.col("pos").alias(side), F.col("component").alias(name))
        pairs = pairs.join(label, side, "left").withColumn(name, F.coalesce(name, side))
    return pairs


def _apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs whose two sides are not in one component."""
    return _labelled(pairs, components).filter("_first <> _second")


def _merged(components: DataFrame, links: DataFrame) -> DataFrame:
    """The components after further links: of these, one between two components is enough."""
    between = materialize(_apart(links.select("first_pos", "second_pos"), components))
    contracted = between.select(F.least("_first", "_second").alias("first_pos"), F.greatest("_first", "_second").alias("second_pos"))
    above = connected_components(contracted.distinct())
    ends = between.select(F.explode(F.array("_first", "_second")).alias("pos")).distinct()
    alone = ends.join(components.select("pos"), "pos", "left_anti").select("pos", F.col("pos").alias("component"))
    merged = above.select(F.col("pos").alias("component"), F.col("component").alias("_above"))
    known = components.unionByName(alone).join(merged, "component", "left")
    return materialize(known.select("pos", F.coalesce("_above", "component").alias("component")))


def _counted(batches: Iterator[pa.RecordBatch], ids: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, owners: np.ndarray,
             percent: int) -> Iterator[pa.RecordBatch]:
    """Links of each set with the queries, by counting which queries its shingles belong to."""
    for batch in batches:
        first: list[np.ndarray] = [np.zeros(0, np.int64)]
        second: list[np.ndarray] = [np.zeros(0, np.int64)]
        for own_id, one in zip(batch.column("id").to_numpy(zero_copy_only=False), batch.column("shingles")):
            own = np.frombuffer(one.as_buffer(), np.uint64)
            low, high = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            amounts = high - low
            at = np.repeat(low - (np.cumsum(amounts) - amounts), amounts) + np.arange(amounts.sum())
            shared = np.bincount(owners[at], minlength=len(ids))
            hit = ids[(100 * shared >= percent * (sizes + len(own) - shared)) & (ids != own_id)]
            first.append(np.minimum(hit, own_id))
            second.append(np.maximum(hit, own_id))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(first)), pa.array(np.concatenate(second))], names=["first_pos", "second_pos"]
        )


def _linked_with(queries: DataFrame, sets: DataFrame, percent: int, blocks: int) -> DataFrame:
    """Links between the queries and all sets. Each block of queries is broadcast with its shingles in order."""
    context, parts = sets.sparkSession.sparkContext, []
    for block in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toArrow()
        own = [np.frombuffer(one.as_buffer(), np.uint64) for one in rows["shingles"].combine_chunks()] if rows.num_rows else []
        sizes = np.array([len(one) for one in own], np.int64)
        hashes = np.concatenate(own) if own else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        index = (rows["id"].to_numpy(), sizes, hashes[order], np.repeat(np.arange(len(own)), sizes)[order])
        shared = context.broadcast(index)
        parts.append(
            sets.mapInArrow(
                lambda batches, shared=shared: _counted(batches, *shared.value, percent), "first_pos long, second_pos long"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _same_document(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges between the nodes of rows that repeat a doc_id with other text."""
    several = named.groupBy("doc_id").agg(F.min("set_key").alias("_a"), F.max("set_key").alias("_b")).filter("_a <> _b")
    own = named.join(several, "doc_id", "left_semi").select("doc_id", "set_key").distinct()
    reps = own.join(nodes.select("set_key", "rep"), "set_key").select("doc_id", "rep")
    first = reps.groupBy("doc_id").agg(F.min("rep").alias("first_pos"))
    return reps.join(first, "doc_id").select("first_pos", F.col("rep").alias("second_pos")).filter("first_pos <> second_pos")

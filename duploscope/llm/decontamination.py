"""Benchmark decontamination: short test items inside long documents.

Method: containment search by MinHash over size partitions. Items are partitioned by the power of
two of their shingle count; each partition looks at a document through overlapping windows three
times its lower size, one such size apart, so that any place an item can stand lies whole in a
window that is not much larger than the item, however long the document is. Where 0.8 of an item
stands in one place, item and window are at least 0.25 alike, and the chance that none of 40
minimum hashes agrees is 1 in 100,000. Window minima of all partitions come from one pass: minima
of the smallest blocks, joined pairwise for the larger ones. Each candidate is then verified
against the whole document by the words themselves.

Items are the stated query set: they are taken in blocks of bounded size, each block's index is
broadcast, and all documents are searched where they stand. Nothing of a document is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duploscope.llm import words
from duploscope.llm.columns import text_or_empty
from duploscope.session import materialize

WIDTH = 5  # words of a shingle
THRESHOLD = 0.8
HASHES = 40
BLOCK_BYTES = 16 << 20  # texts of one block of items

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_FACTORS = words.mixed(np.arange(1, HASHES + 1, dtype=np.uint64) << np.uint64(20)) | np.uint64(1)
_SEEN_BITS = 16


def shingle_set(text: str, width: int) -> set[tuple[str, ...]]:
    found = _WORD.findall(text.translate(_UPPER))
    return {tuple(found[i : i + width]) for i in range(max(1, len(found) - width + 1))} if found else set()


class _Partition(NamedTuple):
    size: int  # its items have from `size` to below twice as many shingles
    items: np.ndarray  # numbers of its items
    seen: np.ndarray  # per hash: which low bits any item has
    order: np.ndarray  # per hash: items by minimum
    minima: np.ndarray  # per hash: the sorted minima


class _Index(NamedTuple):
    partitions: list[_Partition]
    hashes: list[np.ndarray]
    texts: list[str]
    ids: pa.Array
    shortest: np.ndarray  # sorted whole-text hashes of items with fewer words than a shingle
    width: int
    threshold: float


def _index(items: pa.Table, width: int, threshold: float) -> _Index:
    texts = [text or "" for text in items["text"].to_pylist()]
    sets: list[np.ndarray] = []
    long_enough: list[bool] = []
    for part in words.slices(pa.array(texts, pa.string())):
        found = words.words(part)
        grams = words.shingles(found.hashes, found.bounds, width)
        sets += [words.distinct(grams.hashes[a:b]) for a, b in zip(grams.bounds, grams.bounds[1:])]
        long_enough += list(np.diff(found.bounds) >= width)
    partitions = []
    sizes = np.array([len(s) if enough else 0 for s, enough in zip(sets, long_enough)])
    exponents = np.array([int(size).bit_length() - 1 for size in sizes])
    for exponent in sorted(set(exponents[sizes > 0])):
        members = np.flatnonzero((exponents == exponent) & (sizes > 0))
        minima = np.array([[(sets[m] * factor).min() for m in members] for factor in _FACTORS], np.uint64)
        seen = np.zeros((HASHES, 1 << _SEEN_BITS), bool)
        for number, row in enumerate(minima):
            seen[number, row >> np.uint64(64 - _SEEN_BITS)] = True
        order = np.argsort(minima, axis=1, kind="stable")
        partitions.append(_Partition(1 << int(exponent), members, seen, order, np.take_along_axis(minima, order, 1)))
    short = [m for m, enough in enumerate(long_enough) if not enough and len(sets[m])]
    shortest = np.array([[int(sets[m][0]), m] for m in short], np.uint64).reshape(-1, 2)
    return _Index(partitions, sets, texts, items["item_id"], shortest, width, threshold)


def _candidates(grams: words.Shingles, index: _Index) -> set[tuple[int, int]]:
    """(text, item) pairs of which a window and the item have a minimum in common."""
    found: set[tuple[int, int]] = set()
    amounts = np.diff(grams.bounds)
    if not index.partitions or not len(grams.hashes):
        return found
    size = index.partitions[0].size
    blocks = -(-amounts // size)
    bounds = np.concatenate(([0], np.cumsum(blocks)))
    owner = np.repeat(np.arange(len(amounts)), blocks)
    begin = np.repeat(grams.bounds[:-1], blocks) + (np.arange(bounds[-1]) - bounds[owner]) * size
    ladder = []  # per partition: how its blocks follow from those before
    for partition in index.partitions:
        steps = []
        while size < partition.size:
            halved = -(-np.diff(bounds) // 2)
            coarser = np.concatenate(([0], np.cumsum(halved)))
            own = np.repeat(np.arange(len(halved)), halved)
            steps.append(np.repeat(bounds[:-1], halved) + 2 * (np.arange(coarser[-1]) - coarser[own]))
            bounds, owner, size = coarser, own, size * 2
        ladder.append((partition, steps, owner))
    for number, factor in enumerate(_FACTORS):
        minima = np.minimum.reduceat(grams.hashes * factor, begin)
        for partition, steps, owner in ladder:
            for pairs in steps:
                minima = np.minimum.reduceat(minima, pairs)
            hits = np.flatnonzero(partition.seen[number][minima >> np.uint64(64 - _SEEN_BITS)])
            if not len(hits):
                continue
            # A window is a block and the next two; an agreeing minimum of the window is that of one of its
            # blocks, so the blocks that are minimal in some window around them are the ones to look at.
            for hit in hits[_minimal_around(minima, owner, hits)]:
                low = np.searchsorted(partition.minima[number], minima[hit], side="left")
                high = np.searchsorted(partition.minima[number], minima[hit], side="right")
                for item in partition.items[partition.order[number][low:high]]:
                    found.add((int(owner[hit]), int(item)))
    return found


def _minimal_around(minima: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the blocks `at` hold the minimum of at least one window of three blocks of their text."""
    last = len(minima) - 1

    def not_above(step: int) -> np.ndarray:
        other = np.clip(at + step, 0, last)
        return (owner[other] != owner[at]) | (minima[at] <= minima[other])

    back, back2, ahead, ahead2 = (not_above(step) for step in (-1, -2, 1, 2))
    return (ahead & ahead2) | (back & ahead) | (back & back2)


def _search(batches: Iterator[pa.RecordBatch], index: _Index) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[int] = []
        numbers: list[int] = []
        commons: list[int] = []
        column = batch.column("text")
        for part in words.slices(column):
            found = words.words(part)
            grams = words.shingles(found.hashes, found.bounds, index.width)
            pairs = _candidates(grams, index)
            for row in np.flatnonzero(np.diff(found.bounds) < index.width) if len(index.shortest) else ():
                whole = grams.hashes[grams.bounds[row] : grams.bounds[row + 1]]
                pairs |= {(int(row), int(item)) for value, item in index.shortest if len(whole) and value == whole[0]}
            by_row: dict[int, list[int]] = {}
            for row, item in sorted(pairs):
                by_row.setdefault(row, []).append(item)
            for row, candidates in by_row.items():
                own = words.distinct(grams.hashes[grams.bounds[row] : grams.bounds[row + 1]])
                likely = [
                    item for item in candidates
                    if np.isin(index.hashes[item], own).sum() >= index.threshold * len(index.hashes[item])
                ]
                if not likely:
                    continue
                whole_set = shingle_set(column[part.first + row].as_py(), index.width)
                for item in likely:
                    wanted = shingle_set(index.texts[item], index.width)
                    common = len(wanted & whole_set)
                    if common >= index.threshold * len(wanted):
                        rows.append(part.first + row)
                        numbers.append(item)
                        commons.append(common)
        sizes = [len(index.hashes[item]) for item in numbers]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id").take(pa.array(rows, pa.int64())),
                index.ids.combine_chunks().take(pa.array(numbers, pa.int64())),
                pa.array(sizes, pa.int64()),
                pa.array(commons, pa.int64()),
                pa.array([common / size for common, size in zip(commons, sizes)], pa.float64()),
            ],
            names=["doc_id", "item_id", "n_item", "n_common", "containment"],
        )


def find_contained(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(doc_id, item_id, n_item, n_common, containment) of items that stand in documents.

    `docs` has doc_id and text, `items` item_id and text; other columns are not looked at. An item is
    contained when at least `threshold` of its distinct shingles of `width` words (A-Z lowered) occur in
    the document. Fewer words than `width` make one shingle of them all, which only an equal short
    document has. Null and empty texts contain nothing and are contained nowhere. Ids may be null and
    repeat: every pair of rows gives a row. Empty tables give no rows.
    """
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), text_or_empty("text").alias("text"))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    total = wanted.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    schema = "doc_id long, item_id long, n_item long, n_common long, containment double"
    context = docs.sparkSession.sparkContext
    parts = []
    for block in range(blocks):
        rows = wanted.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else wanted
        shared = context.broadcast(_index(rows.toArrow(), width, threshold))
        parts.append(given.mapInArrow(lambda batches, shared=shared: _search(batches, shared.value), schema))
    return reduce(DataFrame.unionByName, parts)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH) -> DataFrame:
    """The documents, with all their columns, in which no item is contained. A null doc_id is kept only if no
    null-id document is contaminated: rows are told apart by doc_id."""
    # written, so that Spark knows how few there are before it decides how to join
    hits = materialize(find_contained(docs, items, threshold, width).select(F.col("doc_id").alias("_hit")).distinct())
    return docs.join(hits, docs["doc_id"].eqNullSafe(hits["_hit"]), "left_anti")

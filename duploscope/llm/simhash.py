"""SimHash near-duplicates by pigeonhole blocks.

Method: a text's fingerprint has 64 bits; each is set if more than half of the hashes of its shingles set it. The bits are cut into
DISTANCE + EQUAL blocks. Two fingerprints that differ in at most DISTANCE bits differ in at most as many blocks, so that they agree
in at least EQUAL blocks: the join is on every choice of EQUAL blocks, and every pair that meets is verified by its Hamming distance.

Only distinct fingerprints are joined. A bucket (choice of blocks, their bits) of up to BUCKET fingerprints is compared pair by pair in
one task, which returns a tree over its links, not the links. Fuller buckets are cut by the same rule again: their fingerprints agree in
the chosen blocks, so that the other bits are cut into blocks and joined. What is still too full after that is joined on all bits but any
DISTANCE of the few that are left, where a bucket cannot hold more than 2**DISTANCE fingerprints. Nothing is left out at any step.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duploscope.llm.columns import bounded_batches, text_or_empty
from duploscope.operators.grouping import connected_components
from duploscope.session import materialize

WIDTH = 3
SEED = 42
DISTANCE = 3  # differing bits of a link
EQUAL = 3  # blocks of a key
BUCKET = 2048  # fingerprints of a bucket that are compared pair by pair
PIECE = 1 << 20  # bytes of a long text that are cut into words at once
_BITS = 64

_space = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: bytes, width: int = WIDTH) -> Iterator[np.ndarray]:
    """XXH64 of all runs of `width` words, A-Z lowered, repeats included; fewer words make one run of them all."""
    before: list[bytes] = []
    at, whole = 0, False
    while at < len(text):
        gap = _space.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        words = before + text[at:end].lower().split()  # of bytes: A-Z, and space and 0x09-0x0D
        at = end
        if len(words) >= width:
            yield _hashes(words, width)
            before, whole = words[len(words) - width + 1 :], True
        else:
            before = words
    if before and not whole:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(before), SEED)], np.uint64)


def _hashes(words: list[bytes], width: int) -> np.ndarray:
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = len(words) - width + 1
    runs = zip(starts[:last].tolist(), ends[width - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in runs), np.uint64, last)


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    counts = np.zeros(_BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        octets = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return counts


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """The fingerprint as an unsigned number; 0 for a text without words."""
    counts, total = np.zeros(_BITS, np.int64), 0
    for hashes in shingle_hashes(text, width):
        counts += _bit_counts(hashes)
        total += len(hashes)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little") if total else 0


def _signed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(text.as_buffer().to_pybytes(), width) for text in batch.column("text")]
        bits = pa.array(np.array(found, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), bits], names=["doc_id", "bits"])


def _number(mask: int) -> int:
    """The mask as a signed 64-bit number, as Spark has it."""
    return mask - (1 << _BITS) if mask >> (_BITS - 1) else mask


def _choices(free: list[int], fixed: int, distance: int) -> list[int]:
    """Masks of the fixed bits and EQUAL of distance + EQUAL blocks of the free bits."""
    blocks = [sum(1 << bit for bit in part.tolist()) for part in np.array_split(np.array(free), distance + EQUAL)]
    return [fixed | sum(chosen) for chosen in combinations(blocks, EQUAL)]


def _free(mask: int) -> list[int]:
    return [bit for bit in range(_BITS) if not mask >> bit & 1]


def first_masks(distance: int = DISTANCE) -> list[int]:
    """Masks of the join: the bits of EQUAL blocks."""
    return _choices(list(range(_BITS)), 0, distance)


def second_masks(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(mask, a mask below it): the bits of EQUAL blocks of those that a mask leaves free, too."""
    return [(mask, below) for mask in first_masks(distance) for below in _choices(_free(mask), mask, distance)]


def last_masks(distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(mask, a mask below it): all bits but any `distance` of those that a second mask leaves free."""
    every = (1 << _BITS) - 1
    return [
        (mask, every & ~sum(1 << bit for bit in left_out))
        for mask in sorted({below for _, below in second_masks(distance)}) for left_out in combinations(_free(mask), distance)
    ]


def _tree(bits: np.ndarray, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places that links (one, other) join, each with the smallest place it reaches."""
    label = np.arange(len(bits))
    while True:
        low = np.minimum(label[one], label[other])
        before = label.copy()
        np.minimum.at(label, one, low)
        np.minimum.at(label, other, low)
        label = label[label]
        if (label == before).all():
            moved = np.flatnonzero(label != np.arange(len(bits)))
            return moved, label[moved]


def _met(rows: pa.Table, distance: int) -> pa.RecordBatch:
    """A tree over the links of whole buckets, which stand one after the other."""
    bits = rows["bits"].to_numpy()
    mask, value = rows["mask"].to_numpy(), rows["value"].to_numpy()
    place = np.arange(len(bits))
    ones, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = 1
    while True:
        place = place[place + step < len(bits)]
        place = place[(mask[place] == mask[place + step]) & (value[place] == value[place + step])]
        if not len(place):
            break
        near = place[np.bitwise_count((bits[place] ^ bits[place + step]).view(np.uint64)) <= distance]
        ones.append(near)
        others.append(near + step)
        step += 1
    moved, root = _tree(bits, np.concatenate(ones), np.concatenate(others))
    return pa.RecordBatch.from_arrays([pa.array(bits[root]), pa.array(bits[moved])], names=["first_pos", "second_pos"])


def _joined(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Links of buckets in order; only the bucket that a batch leaves unfinished is carried to the next."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*kept, batch])
        mask, value = rows["mask"].to_numpy(), rows["value"].to_numpy()
        last = np.flatnonzero((mask != mask[-1]) | (value != value[-1]))
        upto = int(last[-1]) + 1 if len(last) else 0
        if upto:
            yield _met(rows.slice(0, upto), distance)
        kept = rows.slice(upto).combine_chunks().to_batches()
    if kept:
        yield _met(pa.Table.from_batches(kept), distance)


def _links(keyed: DataFrame, distance: int) -> DataFrame:
    """Links inside the buckets of (mask, value, bits), each of bounded size."""
    return (
        keyed.repartition("mask", "value")
        .sortWithinPartitions("mask", "value", "bits")
        .mapInArrow(lambda batches: _joined(batches, distance), "first_pos long, second_pos long")
    )


def _below(crowded: DataFrame, finer: list[tuple[int, int]]) -> DataFrame:
    """The rows of crowded buckets under the finer masks of their masks."""
    rows = [(_number(mask), _number(below)) for mask, below in finer]
    known = crowded.sparkSession.createDataFrame(rows, "mask long, _below long")
    return (
        crowded.join(F.broadcast(known), "mask")  # a fixed table: 400 masks, or 560 for each of these
        .select(F.col("_below").alias("mask"), "bits")
        .distinct()
        .select("mask", F.col("bits").bitwiseAND(F.col("mask")).alias("value"), "bits")
    )


def _split(keyed: DataFrame, bucket: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of buckets up to `bucket`, and those of fuller ones."""
    crowded = materialize(keyed.groupBy("mask", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket).drop("n"))
    if crowded.isEmpty():
        return keyed, None
    return keyed.join(crowded, ["mask", "value"], "left_anti"), materialize(keyed.join(crowded, ["mask", "value"], "left_semi"))


def close_fingerprints(distinct: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(first_pos, second_pos): fingerprints of the table (bits), each once, that links of up to `distance` bits join; a tree for each bucket."""
    chosen = F.explode(F.array(*[F.lit(_number(mask)).cast("long") for mask in first_masks(distance)]))
    keyed = distinct.select(chosen.alias("mask"), "bits").select("mask", F.col("bits").bitwiseAND(F.col("mask")).alias("value"), "bits")
    sparse, crowded = _split(keyed, bucket)
    parts = [_links(sparse, distance)]
    if crowded is not None:
        sparse, crowded = _split(materialize(_below(crowded, second_masks(distance))), bucket)
        parts.append(_links(sparse, distance))
        if crowded is not None:
            parts.append(_links(_below(crowded, last_masks(distance)), distance))
    return reduce(DataFrame.unionByName, parts).distinct()


def near_duplicates(docs: DataFrame, width: int = WIDTH, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of (doc_id, text).

    `fingerprint` has 16 lowercase hex digits; `component_id` is the smallest doc_id that links of up to `distance` differing bits
    reach. Null texts and texts without words have fingerprint zero and are linked like any other. Rows that repeat a doc_id are
    compared each by its text. A null doc_id is the smallest of nothing: such a row links others and has the component that it
    reaches, null if no row there has an id. Other columns are not looked at. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    signed = materialize(given.mapInArrow(lambda batches: _signed(batches, width), "doc_id long, bits long"))
    nodes = materialize(signed.groupBy("bits").agg(F.min("doc_id").alias("first")))
    linked = connected_components(close_fingerprints(nodes.select("bits"), distance, bucket)).withColumnRenamed("pos", "bits")
    labelled = nodes.join(linked, "bits", "left").select("bits", "first", F.coalesce("component", "bits").alias("component"))
    smallest = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = labelled.select("bits", "component").join(smallest, "component").select("bits", "component_id")
    return signed.join(classes, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )

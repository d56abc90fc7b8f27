"""Codes of vectors by codebooks of their parts, learned by member-resident Lloyd rounds.

Method: a vector is cut into parts; each part position has a codebook. The parts of all vectors are dealt out once, by
(position, entry, salt), in blocks to the owner of their entry, and stay there. In a round, owners compare their resident members with
the codebook; only the parts that change entry migrate, in that round's shuffle, to the owners of their new entries. Entries are updated
from the sums of their resident members: those that arrived less those that left. The salt is the task that dealt a block, so that an
entry with a third of all parts has as many owners as there are tasks.

A round writes the blocks that arrive, its run, and nothing else: residents are never rewritten. Which members of a block are still
there follows from the codebooks since its run, and is worked out again where it is needed; codebooks are small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duploscope.llm.columns import bounded_batches
from duploscope.llm.vectors import as_doubles, first_vectors, is_whole, scaled, squared_distances
from duploscope.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
BLOCK = 4096  # parts of one row

_BLOCKS = "position int, entry int, salt int, n long, sums array<long>, members binary"


def _nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    apart = squared_distances(parts, book)
    entry = apart.argmin(axis=1)
    return entry, apart[np.arange(len(parts)), entry]


class _Dealt:
    """Blocks on their way to the owners of entries, and what their former owners lose."""

    def __init__(self, positions: int, entries: int, width: int) -> None:
        context = TaskContext.get()
        self.salt, self.width = context.partitionId() if context else 0, width
        self.waiting: dict[tuple[int, int], list[np.ndarray]] = {}
        self.lost_n, self.lost = np.zeros((positions, entries), np.int64), np.zeros((positions, entries, width), np.int64)
        self.rows: list[tuple] = []

    def send(self, position: int, entry: np.ndarray, parts: np.ndarray) -> None:
        order = np.argsort(entry, kind="stable")
        for number, mine in zip(*_groups(entry[order])):
            key = position, int(number)
            self.waiting.setdefault(key, []).append(parts[order[mine]])
            if sum(map(len, self.waiting[key])) >= BLOCK:
                self._block(key)

    def lose(self, position: int, entry: int, parts: np.ndarray) -> None:
        self.lost_n[position, entry] -= len(parts)
        self.lost[position, entry] -= parts.sum(axis=0)

    def _block(self, key: tuple[int, int]) -> None:
        parts = np.concatenate(self.waiting.pop(key))
        self.rows.append((*key, self.salt, len(parts), parts.sum(axis=0).tolist(), parts.astype("<i4").tobytes()))

    def batch(self, last: bool = False) -> pa.RecordBatch:
        if last:
            for key in list(self.waiting):
                self._block(key)
            for position, entry in zip(*np.nonzero(self.lost_n)):
                sums = self.lost[position, entry].tolist()
                self.rows.append((int(position), int(entry), self.salt, int(self.lost_n[position, entry]), sums, None))
        rows, self.rows = self.rows, []
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
        columns = list(zip(*rows)) if rows else [[]] * len(kinds)
        names = ["position", "entry", "salt", "n", "sums", "members"]
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def _groups(ordered: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    heads = ordered[np.concatenate(([0], cuts))] if len(ordered) else ordered
    return heads, np.split(np.arange(len(ordered)), cuts)


def _dealt_out(batches: Iterator[pa.RecordBatch], books: np.ndarray, scale: int) -> Iterator[pa.RecordBatch]:
    """All parts, for the owners of their nearest entries. `books` are (position, entry, component)."""
    positions, entries, width = books.shape
    dealt = _Dealt(positions, entries, width)
    for batch in batches:
        if batch.num_rows:
            vectors = scaled(batch.column("vector"), scale, positions * width)
            for position in range(positions):
                parts = vectors[:, position * width : (position + 1) * width]
                dealt.send(position, _nearest(parts, books[position])[0], parts)
            yield dealt.batch()
    yield dealt.batch(last=True)


def _migrants(batches: Iterator[pa.RecordBatch], history: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The residents that the last codebook of `history` sends elsewhere.

    `history` are the codebooks since the blocks arrived: a member that an earlier one sent elsewhere is not there any more.
    """
    positions, entries, width = history[-1].shape
    dealt = _Dealt(positions, entries, width)
    for batch in batches:
        for position, entry, members in zip(*(batch.column(name).to_pylist() for name in ("position", "entry", "members"))):
            parts = np.frombuffer(members, "<i4").astype(np.int64).reshape(-1, width)
            for books in history[:-1]:
                parts = parts[_nearest(parts, books[position])[0] == entry]
            now = _nearest(parts, history[-1][position])[0]
            leaving = now != entry
            if leaving.any():
                dealt.lose(position, entry, parts[leaving])
                dealt.send(position, now[leaving], parts[leaving])
        yield dealt.batch()
    yield dealt.batch(last=True)


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray, scale: int) -> Iterator[pa.RecordBatch]:
    positions, _, width = books.shape
    for batch in batches:
        vectors = scaled(batch.column("vector"), scale, positions * width)
        error, codes = np.zeros(len(vectors), np.int64), np.zeros((len(vectors), positions), np.uint8)
        for position in range(positions):
            entry, apart = _nearest(vectors[:, position * width : (position + 1) * width], books[position])
            codes[:, position] = entry
            error += apart
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("vec_id"), batch.column("label"), pa.array([row.tobytes().hex() for row in codes], pa.string()),
                pa.array(error, pa.int64()),
            ],
            names=["vec_id", "label", "code", "error"],
        )


def _changes(run: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a run adds to the counts and sums of entries: one row per entry and component comes to the driver."""
    counts, totals = np.zeros(books.shape[:2], object), np.zeros(books.shape, object)
    for row in run.groupBy("position", "entry").agg(F.sum("n").alias("n")).collect():
        counts[row.position, row.entry] = row.n
    placed = run.select("position", "entry", F.posexplode("sums").alias("place", "value"))
    for row in placed.groupBy("position", "entry", "place").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("total")).collect():
        totals[row.position, row.entry, row.place] = int(row.total)
    return counts, totals


def common_length(rows: DataFrame, parts: int) -> int:
    """The length that most vectors have, of those that can be cut into `parts`; of equally many the longer. 0 if there is none."""
    lengths = rows.groupBy(F.size("vector").alias("length")).agg(F.count(F.lit(1)).alias("n"))
    found = lengths.filter(f"length > 0 AND length % {int(parts)} = 0").orderBy(F.desc("n"), F.desc("length")).first()
    return found.length if found else 0


def encode_vectors(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
    entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every row whose vector is whole.

    A vector is whole if no component is null, not finite or of a magnitude of 2**27 / scale or more, where squared distances leave the
    range of a long, and if it has the length that most such vectors have, of the lengths that `parts` divides; other rows are left out.
    Components become floor(scale * x). The codebook of a position starts as that part of the vectors with the smallest ids, rows
    without an id last, rows that repeat an id in the order of their components; with fewer vectors than `entries` it has as many
    entries as there are vectors. Every row counts. Ties go to the lower index, entries without parts stay. `label_error` sums the error
    over equal labels, nulls together. Other columns are not looked at. An empty table gives no rows.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for each part: 1 to 256 entries")
    spark = rows.sparkSession
    bounded_batches(spark)
    given = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), as_doubles(vector).alias("vector"))
    given = given.filter(is_whole(F.col("vector"), scale))
    dims = common_length(given, parts)
    kind = given.schema["label"].dataType.simpleString()
    if not dims:
        empty = f"vec_id long, label {kind}, code string, error long, label_error long, codebooks_sha256 string"
        return spark.createDataFrame([], empty)
    given = given.filter(F.size("vector") == dims)
    start = first_vectors(given, [F.col("vec_id").asc_nulls_last()], entries, scale)
    books = np.ascontiguousarray(start.reshape(len(start), parts, dims // parts).transpose(1, 0, 2))

    def owned(blocks: DataFrame) -> DataFrame:
        return materialize(blocks.repartition("position", "entry", "salt"))

    history = [books]
    runs = [owned(given.select("vector").mapInArrow(lambda batches: _dealt_out(batches, books, scale), _BLOCKS))]
    counts, totals = _changes(runs[0], books)
    for number in range(1, rounds + 1):
        now = history[-1].copy()
        for place in np.ndindex(*counts.shape):
            if counts[place]:
                now[place] = totals[place] // counts[place]
        history.append(now)
        if number == rounds or (now == history[-2]).all():  # the same codebooks move no part
            break
        moved = [
            run.filter("members IS NOT NULL")
            .select("position", "entry", "members")
            .mapInArrow(lambda batches, since=history[arrived + 1 :]: _migrants(batches, since), _BLOCKS)
            for arrived, run in enumerate(runs)
        ]
        runs.append(owned(reduce(DataFrame.unionByName, moved)))
        changes = _changes(runs[-1], books)
        counts, totals = counts + changes[0], totals + changes[1]
    final = history[-1]
    coded = materialize(
        given.select("vec_id", "label", "vector").mapInArrow(
            lambda batches: _coded(batches, final, scale), f"vec_id long, label {kind}, code string, error long"
        )
    )
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, final.ravel().tolist())).encode()).hexdigest()
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )

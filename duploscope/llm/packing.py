"""Harmonic packing of documents into sequences of a fixed number of tokens.

Method: lengths fall into reciprocal classes; class k holds pieces of which k, and no more, fit into a
sequence, and each of its sequences takes exactly k of them. Documents may be cut, so most pieces are
made to fill their class: a document gives whole sequences, then of what is left the largest
capacity // k, and so on, until fewer than SHORT tokens are left, which go as they are into their own class.
Every task fills its classes by itself. The pieces left in classes that did not fill up at the end of
a task, at most k - 1 of each, go together, longest first, so that a task leaves one partial sequence.
Nothing is shuffled, and a task holds no more than its open classes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duploscope.llm.columns import text_or_empty
from duploscope.llm.tokens import VOCABULARY, encoder

CAPACITY = 2048
SHORT = 64
END = 1  # id after every document
ROWS = 20_000  # pieces of one output batch

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def cuts(tokens: int, capacity: int, short: int) -> list[int]:
    """Lengths of the pieces of a document."""
    pieces = [capacity] * (tokens // capacity)
    left = tokens % capacity
    while left >= short:
        pieces.append(capacity // -(-capacity // left))
        left -= pieces[-1]
    return pieces + [left] * (left > 0)


class _Worker:
    """The open classes of one task, and the finished rows."""

    def __init__(self, number: int, capacity: int, ids: bool) -> None:
        self.capacity, self.keep_ids = capacity, ids
        self.next_sequence = number << 33
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def add(self, piece: tuple) -> None:
        count = self.capacity // piece[2]
        pieces = self.open.setdefault(count, [])
        pieces.append(piece)
        if len(pieces) == count:
            self._close(self.open.pop(count))

    def _close(self, pieces: list[tuple]) -> None:
        offset = 0
        for piece in pieces:
            self.rows.append((*piece[:5], self.next_sequence, offset, *piece[5:]))
            offset += piece[2]
        self.next_sequence += 1

    def finish(self) -> None:
        by_length: dict[int, list[tuple]] = {}
        for pieces in self.open.values():
            for piece in pieces:
                by_length.setdefault(piece[2], []).append(piece)
        self.open = {}
        while by_length:
            room, taken = self.capacity, []
            for length in sorted(by_length, reverse=True):
                pieces = by_length[length]
                count = min(len(pieces), room // length)
                taken += pieces[len(pieces) - count :]
                del pieces[len(pieces) - count :]
                room -= count * length
                if not pieces:
                    del by_length[length]
            self._close(taken)

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows)) if rows else [()] * (8 if self.keep_ids else 7)
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        arrays = [pa.array(column, pa.int64()) for column in columns[:7]]
        if self.keep_ids:
            names.append("ids")
            arrays.append(pa.array([ids.astype(np.int32) for ids in columns[7]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names=names)


def _packed(
    batches: Iterator[pa.RecordBatch], path: str, capacity: int, short: int, end: int, keep_ids: bool
) -> Iterator[pa.RecordBatch]:
    worker = _Worker(TaskContext.get().partitionId(), capacity, keep_ids)
    encode = encoder(path).ids
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            ids = np.append(encode(text.as_py()), np.uint32(end)).astype("<u4")
            start = 0
            for length in cuts(len(ids), capacity, short):
                own = ids[start : start + length]
                piece = (doc_id, start, length, zlib.crc32(own.tobytes()), len(ids))
                worker.add((*piece, own.copy()) if keep_ids else piece)
                start += length
            if len(worker.rows) >= ROWS:
                yield worker.batch()
    worker.finish()
    yield worker.batch()


def pack(
    docs: DataFrame, tokenizer: str = VOCABULARY, capacity: int = CAPACITY, short: int = SHORT, end: int = END,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` the ids.

    `docs` has doc_id and text; other columns are not looked at. A document's ids are those of the tokenizer file and
    `end`; a null or empty text is `end` alone. `ids_crc32` is over little-endian 32-bit ids. Null and repeated
    doc_ids are documents like others. Sequences are numbered within their task. An empty table gives no rows.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    return given.mapInArrow(
        lambda batches: _packed(batches, tokenizer, capacity, short, end, with_ids),
        SCHEMA + (", ids array<int>" if with_ids else ""),
    )

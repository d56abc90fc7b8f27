"""Reduction of decoded images by area averages, in Arrow batches where the images are decoded, and their orientation."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIDE = 64  # longest side that samples are taken from


@lru_cache(maxsize=256)
def shares(size: int, reduced: int) -> np.ndarray:
    """(reduced, size): which part of each new pixel the old ones cover."""
    edges = np.arange(reduced + 1) * (size / reduced)
    low, high = edges[:-1, None], edges[1:, None]
    pixel = np.arange(size)[None, :]
    covered = np.clip(np.minimum(high, pixel + 1) - np.maximum(low, pixel), 0, 1)
    return covered / covered.sum(axis=1, keepdims=True)


def reduced_size(width: int, height: int, side: int) -> tuple[int, int]:
    scale = min(1.0, side / max(width, height))
    return max(1, round(width * scale)), max(1, round(height * scale))


def averaged(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """(height, width, channels) means of the areas of an image of (rows, columns, channels)."""
    rows, columns = shares(pixels.shape[0], height), shares(pixels.shape[1], width)
    means = np.einsum("yr,rxc->yxc", rows, np.einsum("xk,rkc->rxc", columns, pixels.astype(np.float64)))
    return np.rint(means).astype(np.uint8)


def _reduced(batches: Iterator[pa.RecordBatch], side: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            width, height = reduced_size(row["width"], row["height"], side)
            if (width, height) != (row["width"], row["height"]):
                whole = np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"], row["channels"])
                row |= {"pixels": averaged(whole, width, height).tobytes(), "width": width, "height": height}
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def reduce_images(images: DataFrame, side: int = SIDE) -> DataFrame:
    """Images (width, height, channels, pixels and any other columns) of which no side is longer than `side`; smaller ones stay."""
    return images.mapInArrow(lambda batches: _reduced(batches, side), images.schema)


_ORIENTATION = 274  # fixed value: the tag's number


def orientation(head: bytes) -> int:
    """The orientation tag of a JPEG file from its first bytes, 1 to 8; 1 where there is none or it cannot be read."""
    at = 2
    while head[:2] == b"\xff\xd8" and at + 4 <= len(head) and head[at] == 0xFF:
        kind, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        if kind == 0xDA or size < 2:  # pixels begin
            break
        if kind == 0xE1 and head[at + 4 : at + 10] == b"Exif\0\0":
            return _tag(head[at + 10 : at + 2 + size])
        at += 2 + size
    return 1


def _tag(block: bytes) -> int:
    order = {b"II": "little", b"MM": "big"}.get(block[:2])
    if order is None:
        return 1
    number = lambda at, size: int.from_bytes(block[at : at + size], order)
    start = number(4, 4)
    for entry in range(start + 2, min(start + 2 + 12 * number(start, 2), len(block) - 11), 12):
        if number(entry, 2) == _ORIENTATION and number(entry + 2, 2) == 3:
            return found if 1 <= (found := number(entry + 8, 2)) <= 8 else 1
    return 1


def turned(pixels: np.ndarray, tag: int) -> np.ndarray:
    """Stored pixels (rows, columns, channels) as the tag says they are to be seen."""
    if tag >= 5:
        pixels = pixels.transpose(1, 0, 2)
    down, across = {1: (1, 1), 2: (1, -1), 3: (-1, -1), 4: (-1, 1), 5: (1, 1), 6: (1, -1), 7: (-1, -1), 8: (-1, 1)}[tag]
    return np.ascontiguousarray(pixels[::down, ::across])

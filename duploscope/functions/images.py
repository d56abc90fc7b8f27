"""Perceptual fingerprints of images and the similarity of two of them.

Everything is integer or fixed-order double arithmetic, so that results do not depend on how rows are
distributed. Pixels stay in the JVM; only their samples are described in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sample grid, luminance weights, contrast target, score weights, thresholds and tiers.
SIDE = 16
LUMINANCE_WEIGHTS = {"red": 54, "green": 183, "blue": 19}
CONTRAST_CENTER, CONTRAST_SPREAD = 128, 42
WEIGHTS = {"structure": 0.38, "difference": 0.24, "average": 0.14, "color": 0.14, "aspect": 0.10}
THRESHOLDS = {
    "Strict": {"composite": 0.92, "structure": 0.88, "difference": 0.78, "aspect": 0.90},
    "Balanced": {"composite": 0.84, "structure": 0.76, "difference": 0.66, "aspect": 0.82},
    "Broad": {"composite": 0.76, "structure": 0.64, "difference": 0.56, "aspect": 0.72},
}
TIERS = {"VerySimilar": 0.93, "Similar": 0.84}
LOWEST_TIER = "LooselySimilar"
TIER_ORDER = ("LooselySimilar", "Similar", "VerySimilar")
ASPECT_STEPS = 8
SEGMENTS = 12
DESCRIBED = 256  # images of a batch that are described at once: some 10 MB of numbers

HASHES = ("difference_h", "difference_v", "average")
FINGERPRINT = (
    *HASHES,
    "luminance",
    *[f"center_{name}" for name in HASHES],
    "center_luminance",
    "histogram",
    "aspect",
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _samples(left: Column, top: Column, width: Column, height: Column) -> Column:
    """Bytes (blue, green, red) of 16 by 16 nearest-centre samples inside a window of the image."""

    def offsets(start: Column, span: Column, last: Column, stride: Column) -> Column:
        nearest = lambda n: F.least(last, start + F.shiftright((2 * n + 1) * span, 5)) * stride
        return F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), nearest)

    columns = offsets(left, width, F.col("width") - 1, F.col("channels"))
    rows = offsets(top, height, F.col("height") - 1, F.col("width") * F.col("channels"))

    def taken(size: int) -> Column:
        at = lambda y, x: F.substring(F.col("pixels"), y + x + 1, F.lit(size))
        return _let(columns, lambda xs: F.flatten(F.transform(rows, lambda y: F.transform(xs, lambda x: at(y, x)))))

    return F.when(F.col("channels") >= 3, taken(3)).otherwise(F.transform(taken(1), lambda grey: F.concat(grey, grey, grey)))


def samples() -> Column:
    """Samples of the whole image."""
    return _samples(F.lit(0), F.lit(0), F.col("width"), F.col("height"))


def center_samples() -> Column:
    """Samples of the image without a border of a sixteenth."""
    inset = lambda side: F.greatest(F.lit(1), F.shiftright(F.col(side), 4))
    usable = lambda side: F.greatest(F.lit(1), F.col(side) - 2 * inset(side))
    return _samples(inset("width"), inset("height"), usable("width"), usable("height"))


def normalize_contrast(values: Column) -> Column:
    """Levels moved to mean 128 and deviation 42, rounded half to even and kept in 0..255; flat images become 128.

    Sums and squares are whole numbers, so mean and deviation do not depend on the order of addition.
    """
    zero = F.lit(0).cast("long")
    sums = F.struct(
        F.aggregate(values, zero, lambda acc, v: acc + v).alias("s"),
        F.aggregate(values, zero, lambda acc, v: acc + v * v).alias("q"),
    )
    count = F.size(values).cast("long")

    def rescaled(m: Column) -> Column:
        mean = m["s"].cast("double") / count
        spread = (count * m["q"] - m["s"] * m["s"]).cast("double") / (count * count).cast("double")
        parts = F.struct(mean.alias("mean"), F.sqrt(spread).alias("dev"))
        level = lambda v, p: F.greatest(
            F.lit(0),
            F.least(
                F.lit(255),
                F.rint(CONTRAST_CENTER + ((v - p["mean"]) * CONTRAST_SPREAD / p["dev"])).cast("int"),
            ),
        )
        return _let(
            parts,
            lambda p: F.when(p["dev"] < 1, F.transform(values, lambda v: F.lit(CONTRAST_CENTER))).otherwise(
                F.transform(values, lambda v: level(v, p))
            ),
        )

    return _let(sums, rescaled)


# The 64 cells from last to first: folding them with a shift by one puts cell i at bit i.
CELLS = range(63, -1, -1)


def _cells(values: Column, side: int, right: int = 0, down: int = 0) -> Column:
    """Cells of the 8 by 8 grid in a square of `side`, or their neighbours, which stop at the border."""
    step = side // 8
    at = [min(side - 1, (i // 8 + down) * step) * side + min(side - 1, (i % 8 + right) * step) for i in CELLS]
    return F.transform(F.lit(at), lambda index: F.get(values, index))


def _bits(flags: Column) -> Column:
    return F.aggregate(
        flags, F.lit(0).cast("long"), lambda acc, flag: F.shiftleft(acc, 1).bitwiseOR(flag.cast("long"))
    )


def average_hash(values: Column, side: int = SIDE) -> Column:
    """Bit i: cell i is at least the mean of the 64 cells."""

    def against_mean(cells: Column) -> Column:
        total = F.aggregate(cells, F.lit(0).cast("long"), lambda acc, v: acc + v)
        return _let(total, lambda s: _bits(F.transform(cells, lambda v: v * 64 >= s)))

    return _let(_cells(values, side), against_mean)


def difference_hash(values: Column, vertical: bool, side: int = SIDE) -> Column:
    """Bit i: cell i is at least its right (or lower) neighbour."""
    right, down = (0, 1) if vertical else (1, 0)
    return _let(
        values,
        lambda v: _bits(F.zip_with(_cells(v, side), _cells(v, side, right, down), lambda cell, other: cell >= other)),
    )


def fingerprint(images: DataFrame) -> DataFrame:
    """Fingerprints of images (item_id, path, width, height, channels, pixels); further columns are kept.

    Spark takes the 512 samples out of the pixels, so that 2 KB per image reach the Arrow batches,
    where the arithmetic runs on whole batches at once.
    """
    sampled = images.withColumns({"_whole": samples(), "_center": center_samples()}).drop("pixels")
    kept = [field for field in sampled.schema if field.name not in ("_whole", "_center")]
    names = [field.name for field in kept]
    schema = T.StructType(list(kept))
    for name in FINGERPRINT:
        kind = T.DoubleType() if name == "aspect" else T.LongType() if name.endswith(HASHES) else T.ArrayType(T.IntegerType())
        schema = schema.add(name, kind)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, DESCRIBED):
                yield _described(batch.slice(start, DESCRIBED), names)

    return sampled.mapInArrow(describe, schema)


def _described(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    whole, center = _sample_bytes(batch.column("_whole")), _sample_bytes(batch.column("_center"))
    found = {"histogram": _lists(sample_histogram(whole))}
    for prefix, taken in (("", whole), ("center_", center)):
        levels = normalized_levels(sample_luminance(taken))
        found[f"{prefix}luminance"] = _lists(levels)
        found.update({f"{prefix}{name}": pa.array(bits) for name, bits in grid_hashes(levels).items()})
    sides = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("width", "height")]
    found["aspect"] = pa.array(sides[0] / sides[1])
    columns = [batch.column(name) for name in names] + [found[name] for name in FINGERPRINT]
    return pa.RecordBatch.from_arrays(columns, [*names, *FINGERPRINT])


def _sample_bytes(column: pa.ListArray) -> np.ndarray:
    """Images x samples x (blue, green, red)."""
    taken = column.flatten()
    ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1]
    data = np.frombuffer(taken.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return data.reshape(-1, SIDE * SIDE, 3).astype(np.int64)


def _lists(values: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel().astype(np.int32)))


def sample_luminance(taken: np.ndarray) -> np.ndarray:
    weights = [LUMINANCE_WEIGHTS[name] for name in ("blue", "green", "red")]
    return (taken * np.array(weights)).sum(axis=2) >> 8


def sample_histogram(taken: np.ndarray) -> np.ndarray:
    """Counts of the samples in four equal ranges of red, green and blue."""
    ranges = taken[:, :, ::-1] >> 6
    return np.stack([(ranges[:, :, channel] == k).sum(axis=1) for channel in range(3) for k in range(4)], axis=1)


def normalized_levels(values: np.ndarray) -> np.ndarray:
    """`normalize_contrast` of one row per image."""
    n, total, squares = values.shape[1], values.sum(axis=1, keepdims=True), (values * values).sum(axis=1, keepdims=True)
    spread = np.sqrt((n * squares - total * total) / (n * n))
    flat = spread < 1
    moved = np.rint(CONTRAST_CENTER + ((values - total / n) * CONTRAST_SPREAD / np.where(flat, 1, spread)))
    return np.where(flat, CONTRAST_CENTER, np.clip(moved, 0, 255)).astype(np.int64)


def grid_hashes(levels: np.ndarray) -> dict[str, np.ndarray]:
    """The three hashes of 16 by 16 levels, one row per image."""
    square = levels.reshape(-1, SIDE, SIDE)
    even, following = np.arange(0, SIDE, 2), np.minimum(np.arange(2, SIDE + 2, 2), SIDE - 1)
    cells = square[:, even][:, :, even]
    flags = {
        "difference_h": cells >= square[:, even][:, :, following],
        "difference_v": cells >= square[:, following][:, :, even],
        "average": cells * 64 >= cells.sum(axis=(1, 2), keepdims=True),
    }
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    return {name: (flag.reshape(-1, 64) * bit).sum(axis=1, dtype=np.uint64).view(np.int64) for name, flag in flags.items()}


def _hashes(prefix: str, values: Column, side: int) -> dict[str, Column]:
    return {
        f"{prefix}difference_h": difference_hash(values, vertical=False, side=side),
        f"{prefix}difference_v": difference_hash(values, vertical=True, side=side),
        f"{prefix}average": average_hash(values, side),
    }


def grid_fingerprint(images: DataFrame) -> DataFrame:
    """Fingerprints of square grey images given as 8 by 8 levels in `grid`; the centre is the whole grid."""
    levels = images.withColumn("luminance", normalize_contrast(F.col("grid"))).drop("grid")
    hashed = levels.withColumns(_hashes("", F.col("luminance"), 8))
    return hashed.withColumns(
        {
            **{f"center_{name}": F.col(name) for name in HASHES},
            "center_luminance": F.col("luminance"),
            "histogram": F.array(*[F.lit(0)] * 12),
            "aspect": F.col("width").cast("double") / F.col("height"),
        }
    )


def luminance_similarity(a: Column, b: Column) -> Column:
    """1 - mean absolute difference / 255."""
    total = F.aggregate(
        F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0).cast("long"), lambda acc, v: acc + v
    )
    return 1 - total.cast("double") / F.size(a) / 255.0


def hash_similarity(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def hash_pair_similarity(a: Column, b: Column, a_prefix: str = "", b_prefix: str = "") -> Column:
    of = lambda name: hash_similarity(a[a_prefix + name], b[b_prefix + name])
    return (of("difference_h") + of("difference_v")) / 2


def _best(score: Callable[[str, str], Column]) -> Column:
    """The best of whole against whole and centre against whole, either way."""
    return F.greatest(score("", ""), score("center_", ""), score("", "center_"))


def structure_similarity(a: Column, b: Column) -> Column:
    """Of two fingerprint structs, like the other scores below."""
    return _best(lambda p, q: luminance_similarity(a[p + "luminance"], b[q + "luminance"]))


def difference_similarity(a: Column, b: Column) -> Column:
    return _best(lambda p, q: hash_pair_similarity(a, b, p, q))


def average_similarity(a: Column, b: Column) -> Column:
    return _best(lambda p, q: hash_similarity(a[p + "average"], b[q + "average"]))


def color_similarity(a: Column, b: Column) -> Column:
    total = F.aggregate(
        F.zip_with(a["histogram"], b["histogram"], lambda x, y: F.abs(x - y)),
        F.lit(0).cast("long"),
        lambda acc, v: acc + v,
    )
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - total.cast("double") / float(3 * SIDE * SIDE)))


def aspect_similarity(a: Column, b: Column) -> Column:
    """exp(-|ln(a / b)|), without the functions' rounding."""
    return F.least(a / b, b / a)


def scores(a: Column, b: Column) -> dict[str, Column]:
    """The five scores of two fingerprint structs."""
    return {
        "structure": structure_similarity(a, b),
        "difference": difference_similarity(a, b),
        "average": average_similarity(a, b),
        "color": color_similarity(a, b),
        "aspect": aspect_similarity(a["aspect"], b["aspect"]),
    }


def composite(of: dict[str, Column] | None = None) -> Column:
    """Weighted strength of the five scores, added in this order."""
    terms = [F.lit(weight) * (of[name] if of else F.col(name)) for name, weight in WEIGHTS.items()]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def meets(sensitivity: str, of: dict[str, Column] | None = None) -> Column:
    """Whether scores, by default those in columns, reach the thresholds of a sensitivity."""
    condition = F.lit(True)
    for name, least in THRESHOLDS[sensitivity].items():
        condition = condition & ((of[name] if of else F.col(name)) >= least)
    return condition


PRINT_HASHES = (*HASHES, *[f"center_{name}" for name in HASHES])


def packed(batch: pa.RecordBatch) -> pa.Array:
    """Each fingerprint of a batch as bytes: six hashes and the aspect in 8 bytes each, then levels in 1 and counts in 2."""
    parts = [batch.column(name).to_numpy(zero_copy_only=False).astype("<i8")[:, None] for name in PRINT_HASHES]
    parts.append(batch.column("aspect").to_numpy(zero_copy_only=False).astype("<f8")[:, None])
    for name, kind in (("luminance", "u1"), ("center_luminance", "u1"), ("histogram", "<i2")):
        parts.append(batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1))
    rows = np.concatenate([np.ascontiguousarray(part).view(np.uint8) for part in parts], axis=1)
    return pa.array([row.tobytes() for row in rows], pa.binary())


class Prints(NamedTuple):
    """Fingerprints side by side."""

    hashes: dict[str, np.ndarray]
    aspect: np.ndarray
    levels: dict[str, np.ndarray]  # by prefix
    histogram: np.ndarray

    @classmethod
    def unpacked(cls, content: list[bytes]) -> Prints:
        rows = np.frombuffer(b"".join(content), np.uint8).reshape(len(content), -1)
        at, counts = 8 * len(PRINT_HASHES), 2 * 12
        whole = np.ascontiguousarray(rows[:, :at]).view("<u8")
        levels = rows[:, at + 8 : rows.shape[1] - counts]
        size = levels.shape[1] // 2
        return cls(
            {name: np.ascontiguousarray(whole[:, n]) for n, name in enumerate(PRINT_HASHES)},
            np.ascontiguousarray(rows[:, at : at + 8]).view("<f8")[:, 0],
            {"": np.ascontiguousarray(levels[:, :size]), "center_": np.ascontiguousarray(levels[:, size:])},
            np.ascontiguousarray(rows[:, rows.shape[1] - counts :]).view("<i2"),
        )

    def taken(self, rows: np.ndarray) -> Prints:
        return Prints(
            {name: values[rows] for name, values in self.hashes.items()}, self.aspect[rows],
            {p: values[rows] for p, values in self.levels.items()}, self.histogram[rows],
        )


_WAYS = (("", ""), ("center_", ""), ("", "center_"))
_ROWS, _COLUMNS = 64, 1024  # of a tile that are compared at once
_DENSE, _LARGE = 0.4, 1 << 13  # share and number of the pairs from which all levels of a block are compared, not those of single pairs


class Side:
    """Fingerprints laid out to be compared: each place of all levels, and of all counts, in a row, with the sums over the places."""

    def __init__(self, prints: Prints) -> None:
        self.prints = prints
        self.small = {**prints.levels, "histogram": prints.histogram}
        self.plain = np.array_equal(*prints.levels.values()) and all(
            np.array_equal(prints.hashes[name], prints.hashes[f"center_{name}"]) for name in HASHES
        )

    @cached_property
    def shared(self) -> bytes | None:
        """Aspect and histogram, if all fingerprints have the same and their centre is the whole."""
        aspect, histogram = self.prints.aspect, self.prints.histogram
        if not len(self) or not self.plain or (aspect != aspect[0]).any() or (histogram != histogram[0]).any():
            return None
        return aspect[0].tobytes() + histogram[0].tobytes()

    @cached_property
    def places(self) -> dict[str, np.ndarray]:
        return {name: np.ascontiguousarray(values.T).astype(np.uint16) for name, values in self.small.items()}

    @cached_property
    def used(self) -> dict[str, np.ndarray]:
        return {name: places.any(axis=1) for name, places in self.places.items()}

    @cached_property
    def sums(self) -> dict[str, np.ndarray]:
        return {name: values.sum(axis=1, dtype=np.int32) for name, values in self.small.items()}

    def __len__(self) -> int:
        return len(self.prints.aspect)


def _apart(a: Side, b: Side, rows: slice, name: str, p: str, q: str, columns: slice) -> np.ndarray:
    return np.bitwise_count(a.prints.hashes[p + name][rows, None] ^ b.prints.hashes[q + name][None, columns])


def _sums_apart(a: Side, b: Side, rows: slice, columns: slice, p: str, q: str) -> np.ndarray:
    """Sums of absolute differences, as both sums less twice that of the smaller values; 256 levels stay below 2 ** 16."""
    one, other = a.places[p][:, rows], b.places[q][:, columns]
    common = np.zeros((one.shape[1], other.shape[1]), np.uint16)
    smaller = np.empty_like(common)
    for place in np.flatnonzero(a.used[p] & b.used[q]):
        np.minimum(one[place, :, None], other[place, None, :], out=smaller)
        np.add(common, smaller, out=common)
    return a.sums[p][rows, None] + b.sums[q][None, columns] - 2 * common.astype(np.int32)


def _pairs_apart(a: Side, b: Side, i: np.ndarray, j: np.ndarray, p: str, q: str) -> np.ndarray:
    """The same for single pairs."""
    one, other = a.small[p][i], b.small[q][j]
    apart = np.maximum(one, other)
    np.subtract(apart, np.minimum(one, other), out=apart)
    return apart.sum(axis=1, dtype=np.int32)


def _smallest(values: list[np.ndarray]) -> np.ndarray:
    found = values[0]
    for more in values[1:]:
        found = np.minimum(found, more)
    return found


@lru_cache
def _bounds(sensitivity: str, size: int) -> np.ndarray:
    """The largest sum of differences of `size` levels with which fingerprints that share aspect, histogram and centre reach the thresholds, and
    those of each higher tier as well: by tier, then by differing bits * 65 + differing bits of the average; -1 where none does.

    Each score falls with what is differing, so that the bound is found by halving, with the arithmetic of `_close_block`.
    """
    limits = THRESHOLDS[sensitivity]
    difference, average = np.repeat(1 - np.arange(129) / 128.0, 65), np.tile(1 - np.arange(65) / 64.0, 129)
    one = np.ones(len(average))

    def reached(apart: np.ndarray, least: float) -> np.ndarray:
        scores = {"structure": 1 - apart / size / 255.0, "difference": difference, "average": average, "color": one, "aspect": one}
        scores["composite"] = sum(weight * scores[name] for name, weight in WEIGHTS.items())
        return np.logical_and.reduce([scores[name] >= limit for name, limit in limits.items()]) & (scores["composite"] >= least)

    found = []
    for least in (0.0, TIERS["Similar"], TIERS["VerySimilar"]):
        low, high = np.full(129 * 65, -1), np.full(129 * 65, 255 * size + 1)  # reached (or none) and not reached
        while (high - low > 1).any():
            middle = (low + high) // 2
            good = reached(middle, least) & (middle >= 0)
            low, high = np.where(good, middle, low), np.where(good, high, middle)
        found.append(low.astype(np.int32))
    return np.stack(found)


def _shared_bits(a: Side, b: Side, rows: slice, columns: slice) -> np.ndarray:
    """The place in `_bounds` of each pair."""
    bits = _apart(a, b, rows, "difference_h", "", "", columns).astype(np.intp)
    bits += _apart(a, b, rows, "difference_v", "", "", columns)
    bits *= 65
    bits += _apart(a, b, rows, "average", "", "", columns)
    return bits


def _shared_block(a: Side, b: Side, sensitivity: str, rows: slice, columns: slice, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(differing bits, sums of differences, whether the thresholds are reached) of all pairs of sides that share what `Side.shared` tells."""
    bits, apart = _shared_bits(a, b, rows, columns), _sums_apart(a, b, rows, columns, "", "")
    met = apart <= _bounds(sensitivity, a.small[""].shape[1])[0].take(bits)
    if same:
        met &= np.arange(rows.start, rows.stop)[:, None] < np.arange(columns.start, columns.stop)[None, :]
    return bits, apart, met


def _shared_scores(bits: np.ndarray, apart: np.ndarray, size: int) -> dict[str, np.ndarray]:
    one = np.ones(len(bits))
    scores = {
        "structure": 1 - apart / size / 255.0, "difference": (1 - np.arange(129) / 128.0).take(bits // 65),
        "average": (1 - np.arange(65) / 64.0).take(bits % 65), "color": one, "aspect": one,
    }
    scores["composite"] = sum(weight * scores[name] for name, weight in WEIGHTS.items())
    return scores


def _close_block(
    a: Side, b: Side, sensitivity: str, rows: slice, columns: slice, same: bool
) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """`close_pairs` of some rows of a and of b.

    Where the centre of all images is the whole, ways that give equal scores are gone once.
    """
    limits, slack = THRESHOLDS[sensitivity], 1e-9
    ways = [(p, q) for p, q in _WAYS if not (p and a.plain) and not (q and b.plain)]
    bits = [_apart(a, b, rows, "difference_h", *way, columns) + _apart(a, b, rows, "difference_v", *way, columns) for way in ways]
    difference = (1 - np.arange(129) / 128.0).take(_smallest(bits))
    average = (1 - np.arange(65) / 64.0).take(_smallest([_apart(a, b, rows, "average", *way, columns) for way in ways]))
    aspects = a.prints.aspect[rows, None], b.prints.aspect[None, columns]
    aspect = np.minimum(aspects[0] / aspects[1], aspects[1] / aspects[0])
    known = WEIGHTS["difference"] * difference + WEIGHTS["average"] * average + WEIGHTS["aspect"] * aspect
    least = limits["composite"] - slack
    likely = (difference >= limits["difference"]) & (aspect >= limits["aspect"])
    likely &= known + (WEIGHTS["structure"] + WEIGHTS["color"]) >= least
    if same:
        likely &= np.arange(rows.start, rows.stop)[:, None] < np.arange(columns.start, columns.stop)[None, :]
    at, width = np.flatnonzero(likely), likely.shape[1]
    dense = len(at) > _DENSE * likely.size and likely.size >= _LARGE
    index = lambda: (at // width + rows.start, at % width + columns.start)
    if dense:
        histograms = _sums_apart(a, b, rows, columns, "histogram", "histogram").take(at)
    else:
        histograms = _pairs_apart(a, b, *index(), "histogram", "histogram")
    color = np.clip(1 - histograms / float(3 * SIDE * SIDE), 0.0, 1.0)
    if dense:
        apart = [_sums_apart(a, b, rows, columns, *way).take(at) for way in ways]
    else:
        hopeful = np.flatnonzero(known.take(at) + WEIGHTS["color"] * color + WEIGHTS["structure"] >= least)
        at, color = at.take(hopeful), color.take(hopeful)
        apart = [_pairs_apart(a, b, *index(), *way) for way in ways]
    structure = 1 - _smallest(apart) / a.small[""].shape[1] / 255.0
    scores = {"structure": structure, "difference": difference.take(at), "average": average.take(at), "color": color, "aspect": aspect.take(at)}
    scores["composite"] = sum(weight * scores[name] for name, weight in WEIGHTS.items())
    met = np.flatnonzero(np.logical_and.reduce([scores[name] >= limit for name, limit in limits.items()]))
    at = at.take(met)
    return *index(), {name: score.take(met) for name, score in scores.items()}


def _parts(a: Side, b: Side, same: bool, columns: int = _COLUMNS) -> Iterator[tuple[slice, slice]]:
    width = columns if len(a) >= _ROWS else _ROWS * columns // max(1, len(a))
    for start in range(0, len(a), _ROWS):
        for left in range(start if same else 0, len(b), width):
            yield slice(start, min(start + _ROWS, len(a))), slice(left, min(left + width, len(b)))


def close_pairs(a: Side, b: Side, sensitivity: str, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """(rows of a, rows of b, scores) of all pairs that reach the thresholds; with `same`, a and b are one table and pairs are taken once.

    The arithmetic is that of the columns above, step by step. Hashes and aspects are compared for all pairs; histograms, and then
    levels, only where the scores still missing could make up for what is known, or for a whole block where that is most of its pairs.
    Where all have one aspect and histogram, scores are only needed of the pairs within a bound.
    """
    shared = a.shared is not None and a.shared == b.shared
    for rows, columns in _parts(a, b, same, 2 * _COLUMNS if shared else _COLUMNS):
        if shared:
            bits, apart, met = _shared_block(a, b, sensitivity, rows, columns, same)
            at = np.flatnonzero(met)
            index = at // met.shape[1] + rows.start, at % met.shape[1] + columns.start
            found = *index, _shared_scores(bits.take(at), apart.take(at), a.small[""].shape[1])
        else:
            found = _close_block(a, b, sensitivity, rows, columns, same)
        if len(found[0]):
            yield found


def close_masks(a: Side, b: Side, sensitivity: str, same: bool) -> Iterator[tuple[slice, slice, list[np.ndarray]]]:
    """(rows of a, rows of b, for each tier whether a pair is linked in it or a higher one) of all blocks that have pairs of `close_pairs`."""
    shared = a.shared is not None and a.shared == b.shared
    for rows, columns in _parts(a, b, same, 2 * _COLUMNS if shared else _COLUMNS):
        if shared:
            bits, apart, met = _shared_block(a, b, sensitivity, rows, columns, same)
            masks = [met]
            for bounds in _bounds(sensitivity, a.small[""].shape[1])[1:]:
                likely = masks[-1] & (apart <= bounds.max())
                at = np.flatnonzero(likely)
                if not len(at):
                    break
                likely.ravel()[at] = apart.take(at) <= bounds.take(bits.take(at))
                masks.append(likely)
            if met.any():
                yield rows, columns, masks
        else:
            i, j, scores = _close_block(a, b, sensitivity, rows, columns, same)
            if len(i):
                masks = []
                for least in (0.0, TIERS["Similar"], TIERS["VerySimilar"]):
                    mask, kept = np.zeros((rows.stop - rows.start, columns.stop - columns.start), bool), scores["composite"] >= least
                    mask[i[kept] - rows.start, j[kept] - columns.start] = True
                    masks.append(mask)
                yield rows, columns, masks


def close_to(a: Side, row: int, many: np.ndarray, sensitivity: str) -> np.ndarray:
    """Whether a row reaches the thresholds with each of many of its table, where all share what `Side.shared` tells."""
    hashes, levels = a.prints.hashes, a.small[""]
    bits = sum(np.bitwise_count(hashes[name].take(many) ^ hashes[name][row]).astype(np.intp) * weight for name, weight in zip(HASHES, (65, 65, 1)))
    bounds = _bounds(sensitivity, levels.shape[1])[0].take(bits)
    hopeful = np.flatnonzero(bounds >= 0)
    apart, one = levels.take(many.take(hopeful), axis=0), levels[row]
    np.subtract(np.maximum(apart, one), np.minimum(apart, one), out=apart)
    met = np.zeros(len(many), bool)
    met[hopeful] = apart.sum(axis=1, dtype=np.int32) <= bounds.take(hopeful)
    return met


def tier(strength: Column | str) -> Column:
    strength = F.col(strength) if isinstance(strength, str) else strength
    label = F.when(strength >= TIERS["VerySimilar"], F.lit("VerySimilar"))
    return label.when(strength >= TIERS["Similar"], F.lit("Similar")).otherwise(F.lit(LOWEST_TIER))


def aspect_bucket(aspect: Column | str) -> Column:
    aspect = F.col(aspect) if isinstance(aspect, str) else aspect
    return F.rint(F.log2(aspect) * ASPECT_STEPS).cast("int")


def segment(n: int) -> Column:
    """16 of the 192 hash bits."""
    return F.shiftrightunsigned(F.col(HASHES[n // 4]), 16 * (n % 4)).bitwiseAND(F.lit(0xFFFF)).cast("int")

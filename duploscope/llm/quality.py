"""Quality classifier: naive Bayes support vectors.

Method: a text is the set of its n-grams. Each n-gram is scaled by the log ratio of its smoothed counts in the two classes,
and a linear model with hinge loss is fitted on these by dual coordinate descent; the scores of a part kept
aside turn its margin into a probability. N-grams are single words and pairs of words, and runs of up to three
word shapes: the kinds of characters in the order they appear (with doubled signs), and whether a word is the same as the one before.

Learning takes about SAMPLE labelled texts, picked by a hash of their id, as numbers of n-grams; that bound does not
depend on the corpus. Every text is scored whole, where it stands, with one broadcast table of weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duploscope.llm import words
from duploscope.llm.columns import bounded_batches, text_or_empty
from duploscope.session import materialize

SAMPLE = 4_000  # labelled texts to learn from
SAMPLE_BYTES = 256 << 20  # of the numbers of their n-grams, up to which texts are taken in the order of the hash
BITS = 18  # n-grams are told apart by so many bits of their hash
COST = 0.1  # of the hinge loss
EPOCHS = 40
ACCEPTED = 0.3  # probability from which a text is predicted to be good

_kinds = np.arange(256) + 8  # signs stand for themselves
_kinds[65:91], _kinds[97:123], _kinds[48:58] = 1, 2, 3
_SIGN = _kinds > 3
_KIND_VALUES = words.mixed(_kinds.astype(np.uint64) + np.uint64(77)) | np.uint64(1)
_ALWAYS = 0  # feature of every text


def _shapes(part: words.Slice, found: words.Words) -> np.ndarray:
    """A hash of each word's shape; characters beyond ASCII do not show in it."""
    marks = np.zeros(len(part.data) + 1, np.int64)
    marks[found.starts] = 1
    at = np.flatnonzero(~words._SPACE[part.data] & (part.data < 128))
    owner = np.cumsum(marks)[at] - 1
    kind = _kinds[part.data[at]]
    new = np.ones(len(at), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (kind[1:] != kind[:-1])
    double = np.zeros(len(at), bool)  # a sign that is the second of its run
    double[1:] = ~new[1:] & _SIGN[part.data[at[1:]]] & new[:-1]
    shown = np.flatnonzero(new | double)
    owner = owner[shown]
    up, down = words.powers(len(shown) + 1)
    total = np.zeros(len(shown) + 1, np.uint64)
    np.cumsum(_KIND_VALUES[part.data[at[shown]]] * up[: len(shown)], out=total[1:])
    edges = np.searchsorted(owner, np.arange(len(found.hashes) + 1))
    return words.mixed((total[edges[1:]] - total[edges[:-1]]) * down[edges[:-1]])


def features(part: words.Slice) -> list[np.ndarray]:
    """Sorted numbers of the n-grams of each text of a slice."""
    found = words.words(part)
    h = found.hashes
    text = np.repeat(np.arange(len(part.bounds) - 1), np.diff(found.bounds))
    within = np.concatenate(([False], text[1:] == text[:-1])) if len(h) else np.zeros(0, bool)
    same = within & np.concatenate(([False], h[1:] == h[:-1])) if len(h) else within
    shape = _shapes(part, found) + same.astype(np.uint64) * np.uint64(0x5851F42D4C957F2D)
    grams = [h, shape]
    owners = [text, text]
    for run, salt in ((h, 1), (shape, 2)):
        joined, inside = run, np.ones(len(run), bool)
        for length in range(2, 3 if salt == 1 else 4):
            joined = words.mixed(joined[:-1] * np.uint64(0x2545F4914F6CDD1D) + run[length - 1 :] + np.uint64(salt))
            inside = text[: len(joined)] == text[length - 1 :]
            grams.append(joined[inside])
            owners.append(text[: len(joined)][inside])
    salted = [words.mixed(g + np.uint64(1000 + i)) >> np.uint64(64 - BITS) for i, g in enumerate(grams)]
    keys = np.concatenate([(o.astype(np.int64) << BITS) | np.maximum(s, 1).astype(np.int64) for o, s in zip(owners, salted)])
    keys = np.concatenate((keys, np.arange(len(part.bounds) - 1, dtype=np.int64) << BITS))  # _ALWAYS
    keys = np.unique(keys)
    bounds = np.searchsorted(keys, np.arange(len(part.bounds), dtype=np.int64) << BITS)
    numbers = (keys & ((1 << BITS) - 1)).astype(np.int32)
    return [numbers[a:b] for a, b in zip(bounds, bounds[1:])]


class Model(NamedTuple):
    weights: np.ndarray  # of each n-gram, its log-count ratio included
    slope: float  # probability = 1 / (1 + exp(-(slope * margin + offset)))
    offset: float


def ratios(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Log ratio of each n-gram's share in good texts to that in bad ones, with one added to every count."""
    good = 1.0 + np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == 1] or [[0]]), minlength=1 << BITS)
    bad = 1.0 + np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y != 1] or [[0]]), minlength=1 << BITS)
    ratio = np.log((good / good.sum()) / (bad / bad.sum()))
    ratio[_ALWAYS] = 1.0
    return ratio


def descend(rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, cost: float, epochs: int) -> np.ndarray:
    """Weights of the linear model with hinge loss, by coordinate descent on the dual: one multiplier for each text, from 0 to `cost`."""
    weights, dual = np.zeros(1 << BITS), np.zeros(len(rows))
    squares = np.array([float(v @ v) for v in values])
    order = np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            if squares[i] == 0:
                continue
            gradient = signs[i] * float(weights[rows[i]] @ values[i]) - 1
            updated = min(max(dual[i] - gradient / squares[i], 0.0), cost)
            if updated != dual[i]:
                weights[rows[i]] += (updated - dual[i]) * signs[i] * values[i]
                moved = max(moved, abs(updated - dual[i]))
                dual[i] = updated
        if moved < 1e-3 * cost:
            break
    return weights


def calibrated(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins and labels, by Newton's method on targets drawn in by one count."""
    good, bad = (labels == 1).sum(), (labels != 1).sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, offset = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        gradient = np.array([((target - p) * margins).sum(), (target - p).sum()])
        hessian = np.array([[(w * margins**2).sum(), (w * margins).sum()], [(w * margins).sum(), w.sum()]]) + 1e-6 * np.eye(2)
        step = np.clip(np.linalg.solve(hessian, gradient), -2, 2)
        slope, offset = slope + step[0], offset + step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(slope), float(offset)


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> Model:
    """Fits on four fifths and calibrates on the rest. Without both classes every text gets the same score, 1 if all are good."""
    if not len(rows) or len(set(labels.tolist())) < 2:
        return Model(np.zeros(1 << BITS), 0.0, 10.0 if not len(rows) or labels[0] == 1 else -10.0)
    aside = np.zeros(len(rows), bool)
    for label in (0, 1):  # of each class every fifth
        aside[np.flatnonzero(labels == label)[4::5]] = True
    own = [r for r, a in zip(rows, aside) if not a]
    ratio = ratios(own, labels[~aside])
    values = [ratio[r] / np.sqrt(len(r)) for r in own]
    weights = descend(own, values, np.where(labels[~aside] == 1, 1.0, -1.0), cost, epochs) * ratio
    tried = [r for r, a in zip(rows, aside) if a] if aside.sum() >= 10 else rows
    margins = np.array([weights[r].sum() / np.sqrt(len(r)) for r in tried])
    return Model(weights, *calibrated(margins, labels[aside] if aside.sum() >= 10 else labels))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [numbers for part in words.slices(batch.column("text")) for numbers in features(part)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), batch.column("turn"), pa.array([r.tobytes() for r in rows], pa.binary())],
            names=["label", "turn", "grams"],
        )


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        margins = [
            model.weights[numbers].sum() / np.sqrt(len(numbers))
            for part in words.slices(batch.column("text"))
            for numbers in features(part)
        ]
        scores = 1 / (1 + np.exp(-np.clip(model.slope * np.array(margins, float) + model.offset, -30, 30)))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from (doc_id, text) and (doc_id, label), 1 for good and 0 for bad. About `sample` labelled documents are taken,
    by a hash of their id, and of these the first up to SAMPLE_BYTES of n-grams. Labels that are null, or of ids that have none, do not
    count; of several labels of an id the smallest does. Rows that repeat an id are one document, of different texts the first in order."""
    known = (
        labels.select(F.col("doc_id").alias("doc_id"), F.col("label").cast("int").alias("label"))
        .filter("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    amount = known.count()
    turn = F.xxhash64(F.col("doc_id"), F.lit("quality"))
    limit = -(-(1 << 30) * sample // max(1, amount))
    taken = F.pmod(F.col("turn"), F.lit(1 << 30)) < limit
    chosen = materialize(known.select("doc_id", "label", turn.alias("turn")).filter(taken))
    texts = docs.select("doc_id", text_or_empty("text").alias("text")).join(chosen, "doc_id")
    texts = texts.groupBy("label", "turn").agg(F.min("text").alias("text"))
    extracted = materialize(texts.mapInArrow(_extracted, "label int, turn long, grams binary"))
    sizes = extracted.select("turn", F.octet_length("grams").alias("size")).toArrow().sort_by("turn")
    fitting = np.flatnonzero(np.cumsum(sizes["size"].to_numpy()) <= SAMPLE_BYTES)
    if len(fitting) < sizes.num_rows:
        extracted = extracted.filter(F.col("turn") <= (sizes["turn"][int(fitting[-1])].as_py() if len(fitting) else -(1 << 63)))
    table = extracted.toArrow().sort_by("turn")
    rows = [np.frombuffer(grams.as_buffer(), np.int32) for grams in table["grams"]]
    return fit(rows, table["label"].to_numpy())


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `carry`, text and `score`, from 0 to 1, of every row. Null and empty texts have the score of a text without
    words. Rows may repeat; an empty table gives no rows. Carried columns named text or score are replaced by the result."""
    carry = tuple(name for name in carry if name not in ("text", "score"))
    given = docs.select(*carry, text_or_empty("text").alias("text"))
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInArrow(lambda batches: _scored(batches, shared.value), f"{schema}, score double")

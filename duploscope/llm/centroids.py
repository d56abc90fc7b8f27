"""Centroid clustering with heap-ordered bounds.

Method: a vector's gap is the distance to its second nearest centroid less that to its nearest. When centroids move, the gap of a
member of cluster c shrinks by at most the drift of c plus the largest drift of another; the sum of these since the start is the
cluster's accumulated drift. A vector is put into the heap of its cluster under its gap plus the drift accumulated so far, its due.
While the accumulated drift is below the due, its nearest centroid cannot have changed. After each update, the members whose due is
reached are popped and compared with all centroids again; no other vector is looked at.

A heap is a set of runs: each task's part of a written table, in the order of (cluster, due), so that the popped ones are the front of
each run and the reader skips the rest by the statistics of its pages. A row is popped once, when the drift passes its due, and is then
put into a run of that round: with drifts that only grow, the range (drift before, drift now] of every run is exactly what is popped, and
what lies above the drift is alive. Nothing is ever rewritten, and a cluster that holds most rows has as many runs as any other.

Sums of the clusters change by the vectors that changed cluster. Distances are whole numbers, bounds are kept with a margin for rounding.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duploscope.llm.columns import bounded_batches
from duploscope.llm.vectors import as_doubles, first_vectors, is_whole, packed, scaled, squared_distances, unpacked
from duploscope.session import materialize

CLUSTERS, ROUNDS, DIMS, SCALE = 16, 3, 64, 64
SLACK = 1e-9  # share of the distances that is taken off a gap, and added to a drift, against rounding

_RUN = "kind int, cluster int, due double, vec_id long, vector binary, n long, sums array<long>"
_MEMBER, _SUM = 0, 1


def _dues(distances: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid, the smaller number of equally near ones, and the due of each row of distances."""
    cluster = distances.argmin(axis=1)
    ordered = np.sqrt(np.partition(distances, min(1, distances.shape[1] - 1), axis=1)[:, :2].astype(np.float64))
    if distances.shape[1] == 1:
        return cluster, np.full(len(cluster), np.inf)
    nearest, second = ordered[:, 0], ordered[:, 1]
    due = second - nearest - SLACK * (1 + second + nearest) + drift[cluster]
    return cluster, np.maximum(due, np.nextafter(drift[cluster], np.inf))  # ties are due at the next move, not before


class _Sums:
    """What a task adds to the sums of clusters."""

    def __init__(self, clusters: int, dims: int) -> None:
        self.counts, self.totals = np.zeros(clusters, np.int64), np.zeros((clusters, dims), np.int64)

    def add(self, cluster: np.ndarray, vectors: np.ndarray, sign: int) -> None:
        for number in np.unique(cluster):
            mine = cluster == number
            self.counts[number] += sign * mine.sum()
            self.totals[number] += sign * vectors[mine].sum(axis=0)

    def batch(self) -> pa.RecordBatch:
        rows = np.flatnonzero((self.counts != 0) | (self.totals != 0).any(axis=1))
        return _run_batch(_SUM, rows, None, [None] * len(rows), [None] * len(rows), self.counts[rows], list(self.totals[rows]))


def _run_batch(kind: int, cluster: np.ndarray, due, ids, vectors, n, sums) -> pa.RecordBatch:
    size = len(cluster)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(size, kind), pa.int32()), pa.array(cluster, pa.int32()),
            pa.nulls(size, pa.float64()) if due is None else pa.array(due, pa.float64()), pa.array(ids, pa.int64()),
            pa.array(vectors, pa.binary()), pa.nulls(size, pa.int64()) if n is None else pa.array(n, pa.int64()),
            pa.nulls(size, pa.list_(pa.int64())) if sums is None else pa.array(sums, pa.list_(pa.int64())),
        ],
        names=["kind", "cluster", "due", "vec_id", "vector", "n", "sums"],
    )


def _placed(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, scale: int) -> Iterator[pa.RecordBatch]:
    sums = _Sums(*centroids.shape)
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = scaled(batch.column("vector"), scale, centroids.shape[1])
        cluster, due = _dues(squared_distances(vectors, centroids), np.zeros(len(centroids)))
        sums.add(cluster, vectors, 1)
        yield _run_batch(_MEMBER, cluster, due, batch.column("vec_id"), packed(vectors), None, None)
    yield sums.batch()


def _rescanned(batches: Iterator[pa.RecordBatch], centroids: np.ndarray, drift: np.ndarray) -> Iterator[pa.RecordBatch]:
    sums = _Sums(*centroids.shape)
    for batch in batches:
        if not batch.num_rows:
            continue
        vectors = unpacked(batch.column("vector"), centroids.shape[1])
        cluster, due = _dues(squared_distances(vectors, centroids), drift)
        before = batch.column("cluster").to_numpy()
        changed = cluster != before
        sums.add(before[changed], vectors[changed], -1)
        sums.add(cluster[changed], vectors[changed], 1)
        yield _run_batch(_MEMBER, cluster, due, batch.column("vec_id"), batch.column("vector"), None, None)
    yield sums.batch()


def _measured(batches: Iterator[pa.RecordBatch], centroids: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = unpacked(batch.column("vector"), centroids.shape[1])
        cluster = batch.column("cluster").to_numpy()
        apart = ((vectors - centroids[cluster]) ** 2).sum(axis=1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("vec_id"), batch.column("cluster"), pa.array(apart, pa.int64())], names=["vec_id", "cluster", "distance"]
        )


def _totals(run: DataFrame, clusters: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums of a run by cluster, as exact numbers: one row per cluster and component comes to the driver."""
    added = run.filter(F.col("kind") == _SUM)
    counts, totals = np.zeros(clusters, object), np.zeros((clusters, dims), object)
    for row in added.groupBy("cluster").agg(F.sum("n").alias("n")).collect():
        counts[row.cluster] = row.n
    placed = added.select("cluster", F.posexplode("sums").alias("place", "value"))
    for row in placed.groupBy("cluster", "place").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("total")).collect():
        totals[row.cluster, row.place] = int(row.total)
    return counts, totals


def _popped(run: DataFrame, before: np.ndarray, now: np.ndarray) -> Column:
    """The front of each heap: dues above the drift before, up to the drift now."""
    fronts = [
        (F.col("cluster") == cluster) & (F.col("due") > float(low)) & (F.col("due") <= float(high))
        for cluster, (low, high) in enumerate(zip(before, now)) if high > low
    ]
    return (F.col("kind") == _MEMBER) & reduce(Column.__or__, fronts, F.lit(False))


def cluster_vectors(
    rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
    dims: int = DIMS, scale: int = SCALE,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every row whose vector is whole.

    A vector is whole if it has `dims` components, none null, not finite or of a magnitude of 2**27 / scale or more, where squared
    distances leave the range of a long; other rows are left out. Components become floor(scale * x). The first centroids are the
    vectors with the smallest sha256 of `1:<vec_id>`, rows without an id last, rows that repeat an id in the order of their components;
    with fewer vectors than `clusters` there are as many centroids as vectors. Every row counts, also one that repeats another.
    Ties go to the smaller cluster, empty clusters keep their centroid. Other columns of the input are not looked at. An empty table
    gives no rows.
    """
    bounded_batches(rows.sparkSession)
    given = rows.select(F.col(vec_id).cast("long").alias("vec_id"), as_doubles(vector).alias("vector"))
    given = given.filter(is_whole(F.col("vector"), scale) & (F.size("vector") == dims))
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    centroids = first_vectors(given, [digest.asc_nulls_last()], clusters, scale)
    if not len(centroids):
        names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return rows.sparkSession.createDataFrame([], names)
    size = len(centroids)

    def run_of(found: DataFrame) -> DataFrame:
        return materialize(found.sortWithinPartitions("kind", "cluster", "due"))

    start = centroids
    runs = [run_of(given.mapInArrow(lambda batches: _placed(batches, start, scale), _RUN))]
    counts, totals = _totals(runs[0], size, dims)
    drift = np.zeros(size)
    for _ in range(rounds):
        moved_to = np.array([totals[c] // counts[c] if counts[c] else centroids[c] for c in range(size)], np.int64)
        moves = np.sqrt(((moved_to - centroids) ** 2).sum(axis=1).astype(np.float64))
        others = np.array([np.delete(moves, c).max(initial=0.0) for c in range(size)])
        before, drift = drift, drift + (moves + others) * (1 + SLACK)
        centroids = moved_to
        fronts = [run.filter(_popped(run, before, drift)).select("cluster", "vec_id", "vector") for run in runs]
        popped = reduce(DataFrame.unionByName, fronts)
        runs.append(run_of(popped.mapInArrow(lambda batches, c=centroids, d=drift: _rescanned(batches, c, d), _RUN)))
        changes = _totals(runs[-1], size, dims)
        counts, totals = counts + changes[0], totals + changes[1]
    alive = (F.col("kind") == _MEMBER) & (F.col("due") > F.array(*map(F.lit, drift.tolist()))[F.col("cluster")])
    final = centroids
    members = reduce(DataFrame.unionByName, [run.filter(alive).select("cluster", "vec_id", "vector") for run in runs])
    measured = materialize(
        members.mapInArrow(lambda batches: _measured(batches, final), "vec_id long, cluster int, distance long")
    )
    inertia = {row.cluster: row.total for row in measured.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    digests = [hashlib.sha256(",".join(map(str, row.tolist())).encode()).hexdigest() for row in final]
    return measured.select(
        "vec_id", "cluster", "distance",
        F.array(*[F.lit(inertia.get(c, 0)).cast("long") for c in range(size)])[F.col("cluster")].alias("cluster_inertia"),
        F.lit(sum(inertia.values())).cast("long").alias("inertia"),
        F.array(*map(F.lit, digests))[F.col("cluster")].alias("centroid_sha256"),
    )

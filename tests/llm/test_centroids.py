import hashlib
import math
import random

import numpy as np
import pytest
from duploscope.llm import centroids as ct
from duploscope.llm.vectors import squared_distances

from tests.llm.test_queries import SF_DIR


def brute_force(rows, clusters=16, rounds=3, dims=64, scale=64):
    kept = [
        (vec_id, [math.floor(scale * x) for x in vector]) for vec_id, vector in rows
        if vector is not None and len(vector) == dims and all(x is not None and math.isfinite(x) and abs(x) < (1 << 27) // scale for x in vector)
    ]
    name = lambda row: (row[0] is None, hashlib.sha256(f"1:{row[0]}".encode()).hexdigest() if row[0] is not None else "", row[1])
    centres = [vector for _, vector in sorted(kept, key=name)[:clusters]]

    def nearest(vector):
        return min((sum((a - b) ** 2 for a, b in zip(vector, centre)), n) for n, centre in enumerate(centres))

    for _ in range(rounds):
        owners = [nearest(vector)[1] for _, vector in kept]
        for n in range(len(centres)):
            mine = [vector for (_, vector), owner in zip(kept, owners) if owner == n]
            if mine:
                centres[n] = [sum(column) // len(mine) for column in zip(*mine)]
    final = [nearest(vector) for _, vector in kept]
    own = [sum(d for d, c in final if c == n) for n in range(len(centres))]
    digests = [hashlib.sha256(",".join(map(str, centre)).encode()).hexdigest() for centre in centres]
    return sorted(((vec_id, c, d, own[c], sum(own), digests[c]) for (vec_id, _), (d, c) in zip(kept, final)), key=str)


def vectors(spark, rows, extra=True):
    table = [(vec_id, vector, 1, 0.5, "k", 7) for vec_id, vector in rows]
    return spark.createDataFrame(table, "vec_id long, embedding array<double>, cluster int, due double, kind string, distance long")


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_random_vectors(spark):
    rng = random.Random(1)
    centres = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(5)]
    rows = [(n, [x + rng.gauss(0, 0.2) for x in rng.choice(centres)]) for n in range(400)]
    assert got(ct.cluster_vectors(vectors(spark, rows))) == brute_force(rows)
    for clusters, rounds in ((1, 2), (40, 6), (16, 0)):
        assert got(ct.cluster_vectors(vectors(spark, rows), clusters=clusters, rounds=rounds)) == brute_force(rows, clusters, rounds)


def test_ties_copies_and_small_dimensions(spark):
    rng = random.Random(2)
    rows = [(n, [rng.randrange(-2, 3) / 4, rng.randrange(-2, 3) / 4]) for n in range(200)] + [(7, [0.25, 0.25])] * 300 + [(None, [0.5, 0.5])] * 2
    rows += [(7, [-0.25, 0.0])]
    for clusters in (16, 30):
        found = ct.cluster_vectors(vectors(spark, rows), clusters=clusters, rounds=5, dims=2)
        assert got(found) == brute_force(rows, clusters, 5, 2)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    zero = [0.0] * 64
    rows = [(1, None), (2, []), (3, zero[:63]), (4, [None, *zero[1:]]), (5, [nan, *zero[1:]]), (6, [inf, *zero[1:]]), (8, zero + [1.0]), (9, [-inf, *zero[1:]])]
    assert got(ct.cluster_vectors(vectors(spark, rows))) == [] and got(ct.cluster_vectors(vectors(spark, []))) == []
    rows += [(10, zero), (11, [1e9, *zero[1:]]), (None, [1.0, *zero[1:]]), (12, [2e6, *zero[1:]]), (12, [-2e6, *zero[1:]]), (10, zero)]
    found = got(ct.cluster_vectors(vectors(spark, rows)))
    assert found == brute_force(rows) and len(found) == 5


def test_only_expired_members_are_scanned_again(spark, monkeypatch):
    """Two far apart clouds: after the first round nobody's gap expires, so that runs are empty."""
    rng = random.Random(3)
    rows = [(n, [(-1) ** n * 10 + rng.gauss(0, 0.1) for _ in range(8)]) for n in range(300)]
    sizes = []
    keep = ct._totals
    monkeypatch.setattr(ct, "_totals", lambda run, *rest: (sizes.append(run.filter(f"kind = {ct._MEMBER}").count()), keep(run, *rest))[1])
    found = ct.cluster_vectors(vectors(spark, rows), clusters=2, rounds=4, dims=8)
    assert got(found) == brute_force(rows, 2, 4, 8)
    assert sizes[0] == 300 and sum(sizes[1:]) < 600 and sizes[-1] == 0


@pytest.mark.parametrize("size", [10, 1 << 26])
def test_distances_are_exact(size):
    rng = np.random.default_rng(4)
    left, right = rng.integers(-size, size, (50, 64)), rng.integers(-size, size, (16, 64))
    exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in right] for x in left]
    assert squared_distances(left, right).tolist() == exact


def test_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    assert got(ct.cluster_vectors(spark.read.parquet(f"{SF_DIR}/embeddings.parquet"))) == brute_force(rows)

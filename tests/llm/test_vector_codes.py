import hashlib
import math
import random

import pytest
from duploscope.llm import vector_codes as vc

from tests.llm.test_queries import SF_DIR


def brute_force(rows, parts=8, entries=16, rounds=6, scale=4096):
    whole = [
        (vec_id, label, [math.floor(scale * x) for x in vector]) for vec_id, label, vector in rows
        if vector is not None and all(x is not None and math.isfinite(x) and abs(x) < (1 << 27) // scale for x in vector)
    ]
    lengths = [len(v) for *_, v in whole if v and len(v) % parts == 0]
    if not lengths:
        return []
    dims = max(set(lengths), key=lambda n: (lengths.count(n), n))
    kept = [row for row in whole if len(row[2]) == dims]
    width = dims // parts
    first = [v for *_, v in sorted(kept, key=lambda row: (row[0] is None, row[0] or 0, row[2]))[:entries]]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in first] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), n) for n, entry in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            owners = [nearest(cut(v, p), book)[1] for *_, v in kept]
            for n in range(len(book)):
                mine = [cut(v, p) for (*_, v), owner in zip(kept, owners) if owner == n]
                if mine:
                    book[n] = [sum(column) // len(mine) for column in zip(*mine)]
    final = [[nearest(cut(v, p), books[p]) for p in range(parts)] for *_, v in kept]
    errors = [sum(d for d, _ in own) for own in final]
    by_label = {}
    for (_, label, _), error in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted(
        (
            (vec_id, label, "".join(f"{n:02x}" for _, n in own), error, by_label[label], digest)
            for (vec_id, label, _), own, error in zip(kept, final, errors)
        ),
        key=str,
    )


def vectors(spark, rows):
    table = [(vec_id, label, vector, 3, "x", 1.0, 5) for vec_id, label, vector in rows]
    return spark.createDataFrame(table, "vec_id long, label int, embedding array<double>, entry int, code string, error double, n long")


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def cloud(seed, count, dims=16, spread=0.3):
    rng = random.Random(seed)
    centres = [[rng.uniform(-1, 1) for _ in range(dims)] for _ in range(4)]
    return [(n, rng.choice([None, 1, 2]), [x + rng.gauss(0, spread) for x in rng.choice(centres)]) for n in range(count)]


def test_random_vectors(spark):
    rows = cloud(1, 300)
    assert got(vc.encode_vectors(vectors(spark, rows))) == brute_force(rows)
    for parts, entries, rounds in ((4, 3, 9), (16, 40, 2), (1, 1, 1), (2, 16, 0)):
        found = vc.encode_vectors(vectors(spark, rows), parts=parts, entries=entries, rounds=rounds)
        assert got(found) == brute_force(rows, parts, entries, rounds)


def test_ties_copies_and_unused_entries(spark):
    rng = random.Random(2)
    rows = [(n, n % 3, [rng.randrange(-1, 2) / 4 for _ in range(8)]) for n in range(120)] + [(5, None, [0.25] * 8)] * 200 + [(None, None, [0.5] * 8), (5, 1, [0.0] * 8)]
    assert got(vc.encode_vectors(vectors(spark, rows))) == brute_force(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    zero = [0.0] * 16
    rows = [(1, 1, None), (2, 1, []), (3, 1, zero[:15]), (4, 1, [None, *zero[1:]]), (5, 1, [nan, *zero[1:]]), (6, 1, [-inf, *zero[1:]])]
    assert got(vc.encode_vectors(vectors(spark, rows))) == [] and got(vc.encode_vectors(vectors(spark, []))) == []
    rows += [(9, 1, zero), (8, None, [1.0] * 16), (None, 2, [0.5] * 16), (7, 2, [0.5] * 8), (10, 2, [1e9, *zero[1:]]), (11, 1, [30_000.0] * 16)]
    found = got(vc.encode_vectors(vectors(spark, rows)))
    assert found == brute_force(rows) and len(found) == 4
    with pytest.raises(ValueError):
        vc.encode_vectors(vectors(spark, rows), entries=257)


def test_only_migrants_are_shuffled(spark, monkeypatch):
    rows = cloud(3, 400, 16, 0.02)
    blocks = []
    keep = vc._changes
    monkeypatch.setattr(vc, "_changes", lambda run, books: (blocks.append(run.filter("members IS NOT NULL").selectExpr("sum(n)").first()[0] or 0), keep(run, books))[1])
    assert got(vc.encode_vectors(vectors(spark, rows))) == brute_force(rows)
    assert blocks[0] == 400 * 8 and sum(blocks[1:]) < blocks[0]  # each part at most once again, on the whole


def test_small_blocks_and_salts(spark, monkeypatch):
    rows = cloud(4, 200)
    monkeypatch.setattr(vc, "BLOCK", 3)
    assert got(vc.encode_vectors(vectors(spark, rows).repartition(7))) == brute_force(rows)


def test_given_vectors(spark):
    table = spark.read.parquet(f"{SF_DIR}/embeddings.parquet")
    rows = [(r.vec_id, r.label, r.embedding) for r in table.collect()]
    assert got(vc.encode_vectors(table)) == brute_force(rows)

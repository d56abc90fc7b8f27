import random
import re

import numpy as np
import pytest

from duploscope.llm import near_dedup as nd
from tests.llm.odd import empty_documents, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {c: c + 32 for c in range(65, 91)}


def sets_of(rows, width):
    out = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(UPPER))
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def brute_force(rows, width):
    sets, parent = sets_of(rows, width), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            linked = a and b and 100 * len(a & b) >= 80 * len(a | b) or rows[i][0] == rows[j][0] and a and b
            if linked and rows[i][0] is not None and rows[j][0] is not None:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(
        ((d, len(s), least.get(find(i)) if d is not None else None, d is None or d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))),
        key=str,
    )


def got(spark, rows, width):
    return sorted(map(tuple, nd.near_duplicates(odd_documents(spark, rows), width=width).collect()), key=str)


@pytest.mark.parametrize("width", [2, 5])
def test_odd_tables(spark, width):
    rows = [(r.doc_id, r.text) for r in odd_documents(spark).collect()]
    rows += [(30, "other words under this id altogether now"), (30, "and again quite different ones that follow"), (31, "and again quite different ones that follow")]
    assert got(spark, rows, width) == brute_force(rows, width)


def test_empty(spark):
    assert nd.near_duplicates(empty_documents(spark)).count() == 0


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for width in (2, 5):
        assert got(spark, rows, width) == brute_force(rows, width)


def test_large_groups_of_near_copies(spark):
    """Copies of one text, each with its own edits: most are like the original, some only like another copy."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmn", k=4))
    rows = []
    for group in range(3):
        original = [word() for _ in range(120)]
        rows.append((len(rows), " ".join(original)))
        for _ in range((500, 150, 40)[group]):
            copy = list(original)
            for _ in range(rng.randrange(1, 9)):
                copy[rng.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
            if rng.random() < 0.05:  # an exact copy, and a copy of the copy
                rows.append((len(rows), " ".join(copy).upper()))
                copy[5:9] = [word() for _ in range(4)]
                rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, " ".join(word() for _ in range(60))) for i in range(200)]
    assert got(spark, rows, 2) == brute_force(rows, 2)


def test_lone_pairs_of_an_over_full_region(spark):
    """Pairs at 0.8 that share the first two values of one tree only, among many sets that do so too."""
    rng = np.random.default_rng(7)
    values = rng.integers(0, 1 << 32, (600, nd.DEPTH))
    codes = rng.integers(0, 256, (600, nd.TREES * nd.DEPTH)).astype(np.uint8)
    values[:, : nd.MIN_DEPTH], codes[:, : nd.MIN_DEPTH] = 1, 1
    for one in range(0, 600, 2):
        equal = rng.permutation(np.arange(nd.MIN_DEPTH, nd.TREES * nd.DEPTH))[:100]
        codes[one + 1, equal] = codes[one, equal]
    order = np.lexsort(values.T[::-1])
    finder = nd._Finder(80)
    finder.search(nd._Region(values[order], order, np.full(600, 100), codes[order]))
    found = set(zip(*[column.to_pylist() for column in finder.batch().columns[:2]]))
    assert {(one, one + 1) for one in range(0, 600, 2)} <= found


def test_neighbours_come_from_the_common_prefix_as_deep_as_a_region_is_full(monkeypatch):
    """Estimates that say nothing: pairs are those of leaves, whose depth differs from part to part."""
    rng = np.random.default_rng(9)
    values = np.ones((400, nd.DEPTH), np.int64)
    values[:100, 2] = np.arange(100) // 5  # twenty parts of five at depth 3
    values[100:, 2] = 50
    values[100:, 3] = rng.integers(0, 9, 300)  # parts of some thirty at depth 4
    order = np.lexsort(values.T[::-1])
    monkeypatch.setattr(nd._Finder, "_bands", lambda *rest: np.zeros(0, np.int64))
    monkeypatch.setattr(nd._Finder, "_pivots", lambda *rest: None)
    monkeypatch.setattr(nd._Finder, "_like", lambda self, region, one, others: np.ones(len(others)))
    finder = nd._Finder(80)
    codes = np.zeros((400, nd.TREES * nd.DEPTH), np.uint8)
    finder.search(nd._Region(values[order], order, np.full(400, 100), codes))
    found = set(zip(*[column.to_pylist() for column in finder.batch().columns[:2]]))
    assert found == {(i, j) for i in range(400) for j in range(i + 1, 400) if (values[i, :4] == values[j, :4]).all()}


def test_regions_larger_than_a_task(spark, monkeypatch):
    """200 lone pairs at 0.8 to 0.82 among documents that share most of their text, in regions that tasks cut: none is missed."""
    monkeypatch.setattr(nd, "REGION", 60)
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    common = [word() for _ in range(140)]
    rows = []
    for number in range(700):
        one = common + [word() for _ in range(60)]  # two such documents are at 0.53 or less
        rows.append((len(rows), " ".join(one)))
        if number < 200:
            other = list(one)
            for place in range(rng.choice([20, 21, 22])):
                other[-1 - place] = word()
            rows.append((len(rows), " ".join(other)))
    pairs = [100 * len(a & b) / len(a | b) for a, b in zip(*[iter(sets_of(rows[:400], 2))] * 2)]
    assert 79.9 < min(pairs) and max(pairs) < 82.5
    assert got(spark, rows, 2) == brute_force(rows, 2)


def crowd(like_a, like_b):
    """Pairs by reason of 200 sets near A = 0 and 100 near B = 300, and of the last, with the given codes in common with A and B."""
    rng = np.random.default_rng(8)
    codes = np.zeros((401, nd.TREES * nd.DEPTH), np.uint8)
    codes[300:400, 75:] = 1  # B is like A in 75 of 128 codes
    for row in (*range(1, 300), *range(301, 400)):
        codes[row, rng.integers(0, 75, 4)] = rng.integers(2, 256, 4)
    codes[400] = 9
    codes[400, like_a], codes[400, like_b] = codes[0, like_a], codes[300, like_b]
    finder = nd._Finder(80)
    finder.search(nd._Region(np.ones((401, nd.DEPTH), np.int64), np.arange(401), np.full(401, 100), codes))
    return {(a, b): why for a, b, why in zip(*[column.to_pylist() for column in finder.batch().columns])}


def test_crowded_sets_are_named_with_every_pivot(spark):
    named = crowd(slice(0, 110), slice(110, 112))
    partners = {a if b == 400 else b for (a, b), why in named.items() if 400 in (a, b) and why & 4}
    assert any(p < 300 for p in partners) and any(300 <= p < 400 for p in partners)
    # sets clearly like B are named with the pivot of more sets, as both may be linked with one set
    assert sum(a < 300 <= b < 400 and bool(why & 4) for (a, b), why in named.items()) >= 99


def test_sets_that_seem_clearly_like_a_pivot_are_named(spark):
    named = crowd(slice(0, 124), slice(124, 124))
    assert any(b == 400 and why & 8 for (_, b), why in named.items())


def test_queries_of_crowded_regions_in_blocks(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=12))) for i in range(120)]
    signed = spark.createDataFrame(rows, "doc_id long, text string").mapInArrow(lambda b: nd._full_sets(b, 2), "id long, shingles binary")
    found = nd._linked_with(signed.filter("id % 3 = 0"), signed, 80, 4).distinct().collect()
    sets = sets_of(rows, 2)
    linked = lambda i, j: 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    assert {tuple(r) for r in found} == {
        (i, j) for i in range(120) for j in range(i + 1, 120) if (i % 3 == 0 or j % 3 == 0) and linked(i, j)
    }

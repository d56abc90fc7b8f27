import random
import re

import numpy as np
import pytest
import xxhash
from duploscope.llm import simhash as sh
from duploscope.llm.queries import QUERIES
from duploscope.operators.grouping import connected_components

from tests.llm.odd import LONG, empty_documents, odd_documents

SF_DIR = "/root/testdata/sf0.01"


def plain_fingerprint(text, width=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    runs = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(run.encode(), seed=42) for run in runs]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_force(rows):
    """(fingerprint, component) of each row, every pair compared."""
    prints = [plain_fingerprint(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    different = sorted(set(prints))
    first = {p: prints.index(p) for p in different}
    for i, p in enumerate(prints):
        root[find(i)] = find(first[p])
    values = np.array(different, np.uint64)
    for n, p in enumerate(different):
        for other in values[n + 1 :][np.bitwise_count(values[n + 1 :] ^ np.uint64(p)) <= 3].tolist():
            root[find(first[p])] = find(first[other])
    smallest = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            smallest[find(i)] = min(smallest.get(find(i), doc_id), doc_id)
    return sorted(((doc_id, f"{prints[i]:016x}", smallest.get(find(i))) for i, (doc_id, _) in enumerate(rows)), key=str)


def got(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_odd_and_empty_tables(spark):
    rows = [(r.doc_id, r.text) for r in odd_documents(spark).collect()]
    found = sh.near_duplicates(odd_documents(spark))
    assert found.columns == ["doc_id", "fingerprint", "component_id"] and got(found) == brute_force(rows)
    zero = [r for r in found.collect() if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {7, 8, 9} and {r.component_id for r in zero} == {7}
    assert sh.near_duplicates(empty_documents(spark)).count() == 0


def test_long_texts_are_cut_between_words(monkeypatch):
    rng = random.Random(1)
    texts = [LONG, "a b", "A", "", " \t", "x" * 5_000] + [
        "".join(rng.choice(["Word", "é😀", " ", "\n", "\x0b", "x", " ", "  "]) for _ in range(400)) for _ in range(30)
    ]
    whole = [sh.fingerprint(t.encode()) for t in texts]
    assert whole == [plain_fingerprint(t) for t in texts]
    monkeypatch.setattr(sh, "PIECE", 7)
    assert [sh.fingerprint(t.encode()) for t in texts] == whole


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    found = QUERIES["op11_simhash_near_dedup"](spark, SF_DIR)
    assert got(found) == brute_force([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_masks_let_every_close_pair_meet():
    rng = random.Random(2)
    first, second = sh.first_masks(), {}
    for mask, below in sh.second_masks():
        second.setdefault(mask, []).append(below)
    assert len(first) == 20 and all(mask.bit_count() in (31, 32, 33) for mask in first)
    last = {}
    for mask, below in sh.last_masks():
        last.setdefault(mask, set()).add(below)
    assert {below for own in second.values() for below in own} == set(last)
    for _ in range(300):
        flips = sum(1 << bit for bit in rng.sample(range(64), rng.randrange(4)))
        for mask in (m for m in first if not m & flips):
            finer = [below for below in second[mask] if not below & flips]
            assert finer and all(any(not m & flips for m in last[below]) for below in finer)
        assert any(not mask & flips for mask in first)


def components(spark, values, bucket):
    rows = spark.createDataFrame([(int(v),) for v in np.array(values, np.uint64).view(np.int64)], "bits long")
    linked = connected_components(sh.close_fingerprints(rows, bucket=bucket)).collect()
    label = {r.pos: r.component for r in linked}
    return [label.get(int(v), int(v)) for v in np.array(values, np.uint64).view(np.int64)]


@pytest.mark.parametrize("bucket", [2048, 40, 3])
def test_crowded_buckets_lose_no_link(spark, bucket):
    """Balls of fingerprints around a few centres, and a few far away: all depths of the cut give the same components."""
    rng = random.Random(3)
    values = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        values.add(centre)
        free = rng.sample(range(64), 14)
        while len(values) % 160:
            values.add(centre ^ sum(1 << bit for bit in rng.sample(free, rng.randrange(1, 9))))
    values = sorted(values | {rng.getrandbits(64) for _ in range(50)})
    array = np.array(values, np.uint64)
    root = np.arange(len(values))
    near = np.bitwise_count(array[:, None] ^ array[None, :]) <= 3
    while True:
        lower = np.where(near, root[None, :], len(values)).min(axis=1)
        if (lower == root).all():
            break
        root = lower
    found = components(spark, values, bucket)
    same = lambda labels: {tuple(np.flatnonzero(np.array(labels) == one)) for one in set(labels)}
    assert same(found) == same(root.tolist())


def test_links_of_a_bucket_are_a_tree(spark):
    centre = random.Random(4).getrandbits(64)
    values = [centre ^ n for n in range(256)]
    rows = spark.createDataFrame([(int(v),) for v in np.array(values, np.uint64).view(np.int64)], "bits long")
    assert sh.close_fingerprints(rows).count() <= 20 * 255  # of 32,640 pairs

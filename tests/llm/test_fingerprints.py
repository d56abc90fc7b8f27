import hashlib
import re

import xxhash

from duploscope.llm import fingerprints as fp
from tests.llm.odd import ODD, empty_documents, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def hashed(words):
    h = 42
    for word in words:
        h = xxhash.xxh64(word.encode(), seed=h % 2**64).intdigest()
    return h - 2**64 if h >= 2**63 else h


def sketch(text):
    words = WORD.findall(text or "")
    hashes = sorted({hashed(words[i : i + 5]) for i in range(max(1, len(words) - 4))}) if words else []
    below = [h for h in hashes if h < fp.LIMIT]
    return below if len(below) >= fp.FLOOR else hashes[: fp.FLOOR]


def text_of(hashes):
    return ",".join(f"{h % 2**64:016X}" for h in hashes)


def expected(rows):
    by_id = {}
    for doc_id, text in rows:
        by_id.setdefault(doc_id, []).append(text or "")
    order = sorted((i for i in by_id if i is not None), reverse=True) + [None] * (None in by_id)
    following = dict(zip(order, order[1:] + order[:1]))
    out = []
    for doc_id, text in rows:
        text = text or ""
        longest = max(map(len, by_id[doc_id])) // 3
        prefix, nxt = min((t[:longest], t) for t in by_id[following[doc_id]])
        third = len(text) // 3
        edited = text[: len(text) - third] + prefix[:third]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), text_of(sketch(text)), text_of(sketch(edited))))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rows = fp.edited_likeness(odd_documents(spark)).collect()
    assert sorted((tuple(r)[:5] for r in rows), key=str) == expected(ODD)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_against_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = fp.edited_likeness(docs).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected(rows)
    assert sum(r.near_edited for r in got) / len(got) > 0.6 > 0.1 > sum(r.near_next for r in got) / len(got)


def test_one_document_follows_itself(spark):
    row = fp.edited_likeness(odd_documents(spark, [(1, "abcdef")])).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and row.near_next == 1.0


def test_empty(spark):
    assert fp.edited_likeness(empty_documents(spark)).count() == 0


def likeness(spark, first, second):
    df = spark.createDataFrame([(first, second)], "a string, b string")
    df = fp.with_sketch(fp.with_sketch(df, "a", "sa"), "b", "sb")
    return df.select(fp.likeness("sa", "sb").alias("l")).first().l


def test_containment_between_unequal_lengths(spark):
    words = [f"w{i}" for i in range(60_000)]
    part = " ".join(words[1_000:13_000])
    assert likeness(spark, " ".join(words), part) == 1.0
    first, second = " ".join(words[:30_000]), " ".join(words[20_000:50_000])
    one, other = set(sketch(first)), set(sketch(second))
    assert likeness(spark, first, second) == len(one & other) / min(len(one), len(other)) > 0.3


def test_likeness_of_short_and_empty_texts(spark):
    assert likeness(spark, "a b c d e f g", "a b c d e f h") == 2 / 3
    assert likeness(spark, "", None) == 1.0
    assert likeness(spark, "", "a b") == 0.0


def test_merged_is_the_sketch_of_both(spark):
    first, second = " ".join(f"a{i}" for i in range(900)), " ".join(f"b{i}" for i in range(300))
    df = spark.createDataFrame([(first, second)], "a string, b string")
    df = fp.with_sketch(fp.with_sketch(df, "a", "sa"), "b", "sb")
    both = df.select(fp.merged("sa", "sb").alias("m")).first().m
    union = sorted({*[hashed(first.split()[i : i + 5]) for i in range(896)], *[hashed(second.split()[i : i + 5]) for i in range(296)]})
    below = [h for h in union if h < fp.LIMIT]
    assert both == (below if len(below) >= fp.FLOOR else union[: fp.FLOOR])


def test_no_python_in_the_plan(spark):
    plan = fp.edited_likeness(odd_documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "MapInArrow"))

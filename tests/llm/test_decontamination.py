import random

from duploscope.llm import decontamination as dc
from tests.llm.odd import LONG, empty_documents, odd_documents


def brute_force(docs, items, threshold=0.8, width=5):
    out = []
    for doc_id, text in docs:
        own = dc.shingle_set(text or "", width)
        for item_id, item in items:
            wanted = dc.shingle_set(item or "", width)
            if wanted and len(own & wanted) >= threshold * len(wanted):
                out.append((doc_id, item_id, len(wanted), len(own & wanted)))
    return sorted(out, key=str)


def items_of(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "item_id long, text string, doc_id string")


def found(spark, docs, items, **how):
    got = dc.find_contained(docs, items_of(spark, items), **how).collect()
    assert all(r.containment == r.n_common / r.n_item for r in got)
    return sorted((tuple(r)[:4] for r in got), key=str)


def test_odd_tables(spark):
    rows = [(r.doc_id, r.text) for r in odd_documents(spark).collect()]
    items = [
        (1, "Quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "ONE"), (5, "ein wort"), (None, "some words in it and more"),
        (7, LONG[:200]), (7, LONG[:200]), (8, "no id at all but some words"),
    ]
    expected = brute_force(rows, items)
    assert found(spark, odd_documents(spark), items) == expected and len(expected) >= 8
    assert found(spark, odd_documents(spark), items, block_bytes=100) == expected


def test_short_items_inside_long_documents(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    items = [(i, " ".join(word() for _ in range(rng.choice([5, 9, 17, 40, 90, 300])))) for i in range(60)]
    docs = []
    for n in range(60):
        body = [word() for _ in range(rng.choice([50, 400, 5_000]))]
        item = items[n][1].split()
        if n % 3 == 1 and len(item) > 40:  # a word is changed
            item[len(item) // 2] = "changed"
        if n % 3 == 2:  # only half of it
            item = item[: len(item) // 2]
        place = rng.randrange(len(body))
        docs.append((n, " ".join(body[:place] + item + body[place:])))
    expected = brute_force(docs, items)
    assert found(spark, odd_documents(spark, docs), items) == expected and 35 <= len(expected) <= 45


def test_common_passages_and_no_rows(spark):
    docs = [(n, f"{n} the same passage of ten words is found in every document {n}") for n in range(500)]
    assert len(found(spark, odd_documents(spark, docs), [(1, "same passage of ten words is found in every document")])) == 500
    assert found(spark, odd_documents(spark, docs), []) == []
    assert found(spark, empty_documents(spark), [(1, "a b c d e f")]) == []


def test_decontaminate_keeps_the_rest(spark):
    left = dc.decontaminate(odd_documents(spark), items_of(spark, [(1, "quick brown fox jumps over the lazy dog")]))
    assert left.columns == odd_documents(spark).columns
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, [7, 8, 9, None, 11, 12, 13, 14, 20, 21]))

import numpy as np
import pyarrow as pa

from duploscope.llm import quality as ql
from duploscope.llm import words
from duploscope.llm.columns import fold_of
from duploscope.llm.queries import QUERIES
from tests.llm.odd import empty_documents, odd_documents

SF_DIR = "/root/testdata/sf0.01"


def features(texts):
    return [row for part in words.slices(pa.array(texts, pa.string())) for row in ql.features(part)]


def test_features_do_not_depend_on_the_neighbours():
    texts = ["One two, two!! THREE", "", "x", None, "a b c d e f", "One two, two!! THREE", "ünï cödé"]
    together = features(texts)
    for text, row in zip(texts, together):
        assert np.array_equal(row, features([text])[0]) and (np.diff(row) > 0).all() and row[0] == ql._ALWAYS
    assert len(together[1]) == len(together[3]) == 1


def test_shapes_tell_signs_and_repetition():
    plain, shouted, again = features(["here are some words", "HERE!! ARE!! SOME!! WORDS!!", "words words words words"])
    shape = lambda a, b: len(set(a) & set(b))
    assert shape(plain, features(["four more lower terms"])[0]) > shape(plain, shouted)
    assert not np.array_equal(again, plain)


def test_descent_finds_the_optimum_of_the_dual():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(40, 6, replace=False)).astype(np.int32) for _ in range(60)]
    signs = np.where([3 in r or 5 in r for r in rows], 1.0, -1.0)
    values = [np.ones(6) for _ in rows]
    weights = ql.descend(rows, values, signs, 0.5, 2_000)
    dense = np.zeros((60, 40))
    for i, r in enumerate(rows):
        dense[i, r] = 1

    def primal(w):
        return 0.5 * w @ w + 0.5 * np.maximum(0, 1 - signs * (dense @ w)).sum()

    w = weights[:40]
    best = primal(w)
    for _ in range(3_000):  # no step in any direction improves
        assert primal(w + rng.normal(size=40) * rng.choice([1e-3, 1e-2, 0.1])) > best - 1e-3


def test_odd_texts_and_no_labels(spark):
    model = ql.train(odd_documents(spark), spark.createDataFrame([], "doc_id long, label int"))
    got = ql.score(odd_documents(spark), model).collect()
    assert len(got) == 13 and len({r.score for r in got}) == 1
    labels = spark.createDataFrame([(5, 1, "x"), (8, 0, "x"), (7, 0, "x"), (11, 1, "x"), (None, 1, "x"), (99, 0, "x"), (12, None, "x")], "doc_id long, label int, text string")
    model = ql.train(odd_documents(spark), labels)
    got = ql.score(odd_documents(spark), model).collect()
    scores = {r.doc_id: r.score for r in got}
    assert scores[7] == scores[8] == scores[9] and all(0 <= r.score <= 1 for r in got)
    assert ql.score(empty_documents(spark), model).count() == 0


def test_held_out_accuracy(spark):
    got = QUERIES["op6_quality_classifier"](spark, SF_DIR).toPandas()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", (fold_of("doc_id", 5) == 0).alias("h")).toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) and (both.held_out == both.h).all() and (got.predicted == (got.score >= 0.3)).all()
    labelled = both[both.h].merge(spark.read.parquet(f"{SF_DIR}/labels.parquet").toPandas(), on="doc_id")
    good, bad = labelled[labelled.quality == 1], labelled[labelled.quality == 0]
    assert (good.predicted == 1).mean() > 0.97 and (bad.predicted == 0).mean() > 0.8


def test_repeated_rows_are_learned_once_and_bytes_are_bounded(spark, monkeypatch):
    rows = [(n, f"good plain words number{n}" if n % 2 else f"BAD!! BAD!! {n}") for n in range(60)]
    labels = spark.createDataFrame([(n, n % 2) for n in range(60)], "doc_id long, label int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, again = ql.train(docs, labels), ql.train(docs.unionByName(docs).unionByName(docs.limit(7)), labels)
    assert np.array_equal(model.weights, again.weights) and model[1:] == again[1:]
    taken = []
    monkeypatch.setattr(ql, "fit", lambda rows, labels: taken.append(sum(len(r) * 4 for r in rows)))
    monkeypatch.setattr(ql, "SAMPLE_BYTES", 900)
    ql.train(docs, labels)
    monkeypatch.setattr(ql, "SAMPLE_BYTES", 1)
    ql.train(docs, labels)
    assert 700 < taken[0] <= 900 and taken[1] == 0


def test_clashing_names_are_replaced(spark):
    model = ql.train(odd_documents(spark), spark.createDataFrame([], "doc_id long, label int"))
    assert ql.score(odd_documents(spark), model, ("doc_id", "text", "score", "lang")).columns == ["doc_id", "lang", "text", "score"]


def test_scores_against_brute_force(spark):
    """Every document of the query, by the trained weights over sets of n-grams built word by word."""
    import math

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", (fold_of("doc_id", 5) == 0).alias("held_out"))
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").filter(fold_of("doc_id", 5) != 0).selectExpr("doc_id", "quality AS label")
    model = ql.train(docs, labels)
    got = {r.doc_id: r for r in QUERIES["op6_quality_classifier"](spark, SF_DIR).collect()}
    for doc in docs.collect():
        grams = features([doc.text])[0]
        margin = sum(model.weights[g] for g in set(grams.tolist())) / math.sqrt(len(grams))
        wanted = 1 / (1 + math.exp(-min(30, max(-30, model.slope * margin + model.offset))))
        assert math.isclose(got[doc.doc_id].score, wanted, rel_tol=1e-9) and got[doc.doc_id].held_out == doc.held_out

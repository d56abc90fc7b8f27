import numpy as np
import pytest

from duploscope.llm import language as lg
from duploscope.llm.columns import fold_of
from duploscope.llm.queries import QUERIES
from tests.llm.odd import LONG, empty_documents, odd_documents

SF_DIR = "/root/testdata/sf0.01"


def sum_of_segmentations(word, chances):
    if not word:
        return 1.0
    return sum(p * sum_of_segmentations(word[len(piece) :], chances) for piece, p in chances.items() if word.startswith(piece))


def small_model():
    vocabulary = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b" ab", b"bc", b"ca"]
    counted = {b" abc": np.array([5.0, 1.0]), b" cab": np.array([1.0, 4.0]), b" bcabcabcab": np.array([2.0, 2.0])}
    return lg.fit(counted, ["x", "y"], vocabulary), counted


def test_forward_sums_all_segmentations():
    model, _ = small_model()
    lengths = np.array([0, *map(len, model.vocabulary)])
    for column in (0, 1):
        plain = {piece: model.chances[n + 1, column] / lg._SCALE ** lengths[n + 1] for n, piece in enumerate(model.vocabulary)}
        assert sum(plain.values()) == pytest.approx(1)
        for word in (b" abc", b" cabca", b" bcabcabc", b" zq"):
            own = np.frombuffer(word, np.uint8).reshape(1, -1)
            sums = lg._forward(lg._matches(own, lg.trie(model.vocabulary)), len(word), model.chances)[len(word)]
            assert sums[0, column] / lg._SCALE ** len(word) == pytest.approx(sum_of_segmentations(word, plain), rel=1e-9)


def test_learning_raises_the_likelihood():
    _, counted = small_model()
    vocabulary = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b" ab", b"bc", b"ca"]

    def likelihood(rounds):
        model = lg.fit(counted, ["x", "y"], vocabulary, rounds)
        total = 0.0
        for word, numbers in counted.items():
            own = np.frombuffer(word, np.uint8).reshape(1, -1)
            sums = lg._forward(lg._matches(own, lg.trie(model.vocabulary)), len(word), model.chances)[len(word)][0]
            total += float(numbers @ (np.log(sums) - len(word) * np.log(lg._SCALE)))
        return total

    assert likelihood(1) < likelihood(2) < likelihood(6)


def test_odd_texts(spark):
    model, _ = small_model()
    rows = {r.doc_id: r for r in lg.predict(odd_documents(spark), model).collect() if r.doc_id is not None}
    for doc_id in (7, 8, 9):
        assert (rows[doc_id].lang_pred, rows[doc_id].score) == ("und", 0.0)
    assert rows[13].lang_pred in ("x", "y") and rows[14].lang_pred in ("x", "y")
    assert lg.predict(odd_documents(spark), model).count() == 13
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert LONG and lg.predict(empty_documents(spark), model).count() == 0


def test_a_word_has_the_same_score_alone_and_in_company(spark):
    model, _ = small_model()
    rows = odd_documents(spark, [(1, "abc"), (2, "ABC, abc! 123 abc"), (3, "cab"), (4, "12 . !")])
    got = {r.doc_id: (r.lang_pred, r.score) for r in lg.predict(rows, model).collect()}
    assert got[1][0] == got[2][0] == "x" and got[3][0] == "y" and got[4] == ("und", 0.0)
    odds = got[1][1] / (1 - got[1][1])
    assert got[2][1] == pytest.approx(odds**3 / (1 + odds**3))


def test_without_training_rows_nothing_is_predicted(spark):
    model = lg.train(empty_documents(spark))
    assert {r.lang_pred for r in lg.predict(odd_documents(spark), model).collect()} == {"und"}


def test_held_out_accuracy(spark):
    got = QUERIES["op4_language_id"](spark, SF_DIR).toPandas()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang", (fold_of("doc_id", 3) == 1).alias("h")).toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) and (both.held_out == both.h).all()
    assert (both[both.h].lang == both[both.h].lang_pred).mean() > 0.98


def test_long_words_are_summed_whole():
    model, _ = small_model()
    tree = lg.trie(model.vocabulary)
    lengths = np.array([0, *map(len, model.vocabulary)])
    plain = [{piece: model.chances[n + 1, c] / lg._SCALE ** lengths[n + 1] for n, piece in enumerate(model.vocabulary)} for c in (0, 1)]
    rng = np.random.default_rng(5)
    for length in (33, 47, 48, 49, 300):
        word = b" " + rng.choice(np.frombuffer(b"abcz", np.uint8), length - 1).tobytes()
        own = np.frombuffer(word, np.uint8).reshape(1, -1)
        for column in (0, 1):
            sums = [np.longdouble(1)]  # by the definition, in wider numbers
            for end in range(1, length + 1):
                sums.append(sum(np.longdouble(p) * sums[end - len(x)] for x, p in plain[column].items() if len(x) <= end and word[end - len(x) : end] == x))
            wanted = float(np.log(sums[-1])) + length * np.log(lg._SCALE)
            assert lg._log_sums(own, tree, model.chances)[0, column] == pytest.approx(wanted, rel=1e-9)
            values, logs = lg._rescaled(lg._matches(own, tree), length, model.chances, tree.longest)
            assert np.log(values[length][0, column]) + logs[length][0, column] == pytest.approx(wanted, rel=1e-9)


def test_learning_from_long_words_keeps_counts():
    vocabulary = [bytes([b]) for b in range(256)] + [b"ab", b"abc"]
    short = lg.fit({b" " + b"abc" * 9: np.array([7.0])}, ["x"], vocabulary, 3)
    long = lg.fit({b" " + b"abc" * 60: np.array([7.0 * 9 / 60])}, ["x"], vocabulary, 3)
    pieces = [n for n, piece in enumerate(short.vocabulary, 1) if piece in (b"ab", b"abc", b"c")]
    ratio = lambda m: m.chances[pieces, 0] / m.chances[pieces, 0].sum()
    assert ratio(long) == pytest.approx(ratio(short), rel=0.05)


def test_every_piece_of_the_vocabulary_counts():
    assert max(map(len, lg.pieces(lg.VOCABULARY))) > 16


def test_a_word_of_a_megabyte(spark):
    model, _ = small_model()
    rows = odd_documents(spark, [(1, "abc" * 100_000), (2, "cab" * 100_000), (3, "abc" * 1_000), (4, "cab" * 1_000)])
    got = {r.doc_id: r.lang_pred for r in lg.predict(rows, model).collect()}
    assert got[1] == got[3] and got[2] == got[4]


def test_more_languages_than_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(lg, "LANGUAGES", 2)
    rows = [(n, "abc def", "aa") for n in range(5)] + [(n, "ghi jkl", "bb") for n in range(10, 14)] + [(20, "mno", "cc"), (21, "pqr", "dd")]
    model = lg.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb"]


def test_rows_that_repeat_an_id_are_learned_once(spark):
    once = spark.createDataFrame([(1, "abc", "x"), (2, "cab", "y"), (None, "q", "y"), (3, None, "x")], "doc_id long, text string, lang string")
    model, again = lg.train(once), lg.train(once.unionByName(once).unionByName(once))
    assert np.array_equal(model.chances, again.chances)


def test_clashing_names_are_replaced(spark):
    model, _ = small_model()
    rows = odd_documents(spark).withColumnRenamed("source", "letters").withColumnRenamed("shard", "lang_pred")
    got = lg.predict(rows, model, ("doc_id", "letters", "lang_pred", "score"))
    assert got.columns == ["doc_id", "letters", "lang_pred", "score"] and {r.letters for r in got.collect()} == {"src"}


def test_predictions_against_brute_force(spark):
    """Every document of the query, by sums over segmentations word by word."""
    import math
    import re

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("held_out", fold_of("doc_id", 3) == 1)
    model = lg.train(docs.filter("NOT held_out"))
    lengths = [0, *map(len, model.vocabulary)]
    chances = {piece: model.chances[n + 1] / lg._SCALE ** lengths[n + 1] for n, piece in enumerate(model.vocabulary)}
    longest, known = max(lengths), {}

    def logs(word):
        if word not in known:
            sums = [np.ones(len(model.languages))]
            for end in range(1, len(word) + 1):
                starts = range(max(0, end - longest), end)
                sums.append(sum(sums[at] * chances[word[at:end]] for at in starts if word[at:end] in chances))
            known[word] = np.log(sums[-1])
        return known[word]

    got = {r.doc_id: r for r in QUERIES["op4_language_id"](spark, SF_DIR).collect()}
    for doc in docs.collect()[:300]:
        words = re.findall(r"[^\W\d_]+", (doc.text or "").lower())
        if not words:
            assert (got[doc.doc_id].lang_pred, got[doc.doc_id].score) == ("und", 0.0)
            continue
        total = sum(logs(b" " + word.encode()) for word in words)
        assert got[doc.doc_id].lang_pred == model.languages[int(total.argmax())]
        assert math.isclose(got[doc.doc_id].score, 1 / np.exp(total - total.max()).sum(), abs_tol=1e-6)

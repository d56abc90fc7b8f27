"""Packing and token counts: exact round trips against the tokenizer file."""

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from duploscope.llm import packing, token_counts, tokens
from tests.llm.odd import empty_documents, odd_documents

DOCUMENTS = "/root/testdata/sf0.001/documents.parquet"


def ids_of(text, whole=Tokenizer.from_file(tokens.VOCABULARY)):
    return whole.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def documents(spark):
    docs = spark.read.parquet(DOCUMENTS).select("doc_id", "text", "source")
    return docs.unionByName(odd_documents(spark).selectExpr("doc_id + 1000000 AS doc_id", "text", "source"))


def test_encoder_gives_the_ids_of_the_file():
    encode = tokens.encoder(tokens.VOCABULARY).ids
    for text in ("", "a  b\n\n c", "<|endoftext|>", "x<|endoftext|>y", "é😀 \x00 1234's", " " * 3000 + "a", "ab" * 5000):
        assert encode(text).tolist() == ids_of(text)


def test_cuts_fill_classes():
    for tokens_ in [*range(1, 4200), 100_000]:
        pieces = packing.cuts(tokens_, 2048, 64)
        assert sum(pieces) == tokens_ and all(0 < p <= 2048 for p in pieces)
        for p in pieces:
            assert p < 64 or p == 2048 // (2048 // p)


@pytest.mark.parametrize("partitions", [1, 7])
def test_round_trip(spark, documents, partitions):
    packed = packing.pack(documents.repartition(partitions), with_ids=True).toPandas()
    expected = Counter((r.doc_id, tuple([*ids_of(r.text), 1])) for r in documents.collect())
    got = Counter()
    # a doc_id may repeat with the same or other text: pieces are told apart by the order in which they were made
    for key, rows in packed.groupby(["doc_id", "doc_tokens"], dropna=False):
        copies = Counter(rows.start)
        assert len(set(copies.values())) == 1
        if max(copies.values()) == 1:
            whole = np.concatenate(list(rows.sort_values("start").ids))
            assert (rows.sort_values("start").length.cumsum() == rows.sort_values("start").start + rows.sort_values("start").length).all()
            got[(None if np.isnan(key[0]) else int(key[0]), tuple(whole.tolist()))] += 1
    repeated = {k for k, n in expected.items() if n > 1}
    assert {k: n for k, n in expected.items() if k not in repeated}.items() <= got.items()
    assert packed.length.sum() == sum(len(k[1]) * n for k, n in expected.items())
    assert (packed.ids_crc32 == [zlib.crc32(np.asarray(i, "<u4").tobytes()) for i in packed.ids]).all()


def test_sequences(spark, documents):
    packed = packing.pack(documents.coalesce(1)).toPandas().sort_values(["sequence_id", "offset"])
    for _, rows in packed.groupby("sequence_id"):
        ends = (rows.offset + rows.length).tolist()
        assert rows.offset.tolist() == [0, *ends[:-1]] and ends[-1] <= 2048
    filled = packed.groupby("sequence_id").length.sum()
    padding = sum(2048 - n for n in filled if n & (n - 1))
    assert padding < 0.02 * packed.length.sum() + 2048


def test_empty(spark):
    assert packing.pack(empty_documents(spark)).count() == 0
    histogram = token_counts.length_histogram(empty_documents(spark))
    assert token_counts.length_table(histogram).count() == 0
    assert [tuple(r) for r in token_counts.at_limits(histogram, [0, 9]).collect()] == [(0, 0, 0), (9, 0, 0)]


def test_counts(spark, documents):
    lengths = sorted(len(ids_of(r.text)) for r in documents.collect())
    histogram = token_counts.length_histogram(documents)
    assert {(r.n_tokens, r.documents) for r in histogram.collect()} == set(Counter(lengths).items())
    for row in token_counts.length_table(histogram).collect():
        n = row.n_tokens
        assert row.longer_documents == sum(x > n for x in lengths) and row.tokens_up_to == sum(x for x in lengths if x <= n)
        assert row.truncated_tokens == sum(min(x, n) for x in lengths) and row.all_tokens == sum(lengths)
        assert row.quantile == pytest.approx(sum(x <= n for x in lengths) / len(lengths))
    limits = [0, 1, 100, 513, 2048, 10**6]
    got = {r.context_limit: (r.truncated_tokens, r.cut_documents) for r in token_counts.at_limits(histogram, limits).collect()}
    assert got == {n: (sum(min(x, n) for x in lengths), sum(x > n for x in lengths)) for n in limits}
    shares = {r.share: r.n_tokens for r in token_counts.quantiles(histogram, [0.0, 0.5, 0.9, 1.0]).collect()}
    for share, n in shares.items():
        assert n == min(x for x in lengths if sum(y <= x for y in lengths) >= share * len(lengths))

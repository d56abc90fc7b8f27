"""Registered queries against their SQL, and the pipeline stage by stage."""

import pytest

import corpus_pipeline
from duploscope.llm import decontamination, quality
from duploscope.llm.queries import ORACLES, QUERIES
from tests.llm.odd import empty_documents, odd_documents
from tests.llm.test_near_dedup import brute_force as components
from tests.llm.test_pii import base_spans
from tests.oracle import Oracle, compare

SF_DIR = "/root/testdata/sf0.001"


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR).toPandas(), Oracle(SF_DIR).run(ORACLES[name])) is None


@pytest.mark.parametrize("name", [name for name in QUERIES if name not in ORACLES])
def test_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    before = rows(docs)
    good = stage("quality")(spark, docs, SF_DIR)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    kept = rows(good)
    assert all(before[i] == r for i, r in kept.items()) and 0 < len(kept) < len(before)
    assert sum(labels[i] == 1 for i in kept if i in labels) >= 0.95 * sum(q == 1 for i, q in labels.items() if i in before)
    single = stage("near_duplicates")(spark, docs, SF_DIR)
    wanted = {r[0] for r in components([(i, r.text) for i, r in before.items()], 5) if r[3]}
    assert set(rows(single)) == wanted and single.columns == docs.columns
    clean = stage("decontamination")(spark, docs, SF_DIR)
    items = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    sets = [decontamination.shingle_set(t, 5) for t in items]
    hit = {i for i, r in before.items() if any(len(s & decontamination.shingle_set(r.text, 5)) >= 0.8 * len(s) for s in sets)}
    assert set(rows(clean)) == set(before) - hit and hit
    hidden = rows(stage("personal_data")(spark, docs, SF_DIR))
    assert all((hidden[i].text != r.text) == bool(base_spans(r.text)) for i, r in before.items())
    assert all(r.n_chars == len(r.text) and not base_spans(r.text) for r in hidden.values())


def test_pipeline_runs_through(spark):
    result = corpus_pipeline.run(spark, SF_DIR)
    assert result.count() > 0 and "sequence_id" in result.columns


def test_pipeline_on_odd_and_empty_tables(spark):
    for table in (odd_documents(spark), empty_documents(spark)):
        docs = table
        for name, run in corpus_pipeline.STAGES:
            docs = run(spark, docs, SF_DIR)
            if name != "packing":
                assert docs.columns == list(corpus_pipeline.COLUMNS)
        assert docs.count() >= 0


def test_null_texts_stay_null(spark):
    model_accepts = quality.ACCEPTED
    assert 0 < model_accepts < 1
    hidden = stage("personal_data")(spark, odd_documents(spark), SF_DIR)
    assert hidden.filter("text IS NULL").count() == 1 and hidden.count() == odd_documents(spark).count()

import zlib

import pytest

from duploscope.llm.queries import QUERIES
from duploscope.llm.sharding import balanced_shards
from tests.llm.odd import empty_documents, odd_documents


def brute_force(rows, shards):
    measured = sorted(
        ((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    )
    total, before, out, slots = sum(r[1] for r in measured), 0, [], {}
    for row in measured:
        shard = min(int((before + row[1] - row[1] // 2) / total * shards), shards - 1)
        slots[shard] = slots.get(shard, -1) + 1
        out.append((*row, shard, slots[shard]))
        before += row[1]
    return sorted(out, key=str)


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_odd_tables(spark, shards):
    rows = [(r.doc_id, r.text) for r in odd_documents(spark).collect()]
    got = balanced_shards(odd_documents(spark).repartition(5), shards).collect()
    assert sorted(map(tuple, got), key=str) == brute_force(rows, shards)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = QUERIES["op8_sharding"](spark, "/root/testdata/sf0.001").toPandas()
    columns = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sorted(got[columns].itertuples(index=False, name=None), key=str) == brute_force(rows, 40)
    per_shard = got.groupby("shard")["size"].sum()
    assert (per_shard - got["size"].sum() / 40).abs().max() <= got["size"].max()
    assert set(got.law) == {"bytes"} and got.grown_shard.isna().all()


def test_empty(spark):
    assert balanced_shards(empty_documents(spark), 4).count() == 0

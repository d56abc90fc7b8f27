"""URL rules behind sorted arrays of 64-bit digests.

Method: the keys of the rules, host and path with a sign between that neither can have in a url, are hashed with xxhash64. Spark sorts
the digests and cuts them into ranges; the digests of a range, the offsets and the full strings form one file in the shared folder, which
Spark hands to every executor and workers map into memory. A url's possible keys, its host and parent domains with each rule length of its
path, are hashed and probed by vectorised binary search in their ranges; a digest that is found counts only if the stored string is the
same. A list of any size is some more ranges: none passes through the driver with another, and pages are judged where they stand, without
a shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duploscope.session import materialize, shared_dir

RANGE_BYTES = 64 << 20  # of the keys of one file
ALLOW, BLOCK = "allow", "block"
SEED = 42  # that of Spark's own xxhash64

_BETWEEN = "#"  # ends a host and a path, so that neither has it
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lowered; empty without `://` and for null."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: str) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: str) -> Column:
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", text)
    return F.when(at > 0, F.substr(text, at + 3)).otherwise("")


class Rules(NamedTuple):
    """What workers know of a list before they open a file."""

    names: list[str]  # of the files
    firsts: list[int]  # least digest of each
    lengths: dict[int, list[int]]  # of rule hosts: of the paths with a host of that length


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One file of the digests of a task, which come in order: number of keys, digests, ends of the keys, verdicts, keys."""
    digests, blocks, keys = [np.zeros(0, np.int64)], [np.zeros(0, bool)], []
    for batch in batches:
        digests.append(batch.column("digest").to_numpy())
        blocks.append(batch.column("blocks").to_numpy(zero_copy_only=False))
        keys += [key.encode() for key in batch.column("key").to_pylist()]
    if keys:
        every = np.concatenate(digests)
        ends = np.cumsum([0] + [len(key) for key in keys], dtype=np.int64)
        content = len(keys).to_bytes(8, "little") + every.tobytes() + ends.tobytes()
        content += np.concatenate(blocks).astype(np.uint8).tobytes() + b"".join(keys)
        yield pa.RecordBatch.from_arrays([pa.array(every[:1]), pa.array([content], pa.binary())], names=["first", "content"])


def build(spark: SparkSession, rules: DataFrame) -> Rules:
    """Writes the index of `rules` (host, path, verdict), a file for each RANGE_BYTES of its keys, for `judge`.

    A rule's host is lowered as those of urls are; nulls count as empty. Of rules with the same host and path, one that
    blocks counts. Rules without a host, and those with a sign in host or path that ends it in a url, fit nothing and are left out.
    """
    keyed = materialize(
        rules.select(
            F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"),
            F.coalesce("path", F.lit("")).alias("path"),
            F.coalesce(F.col("verdict") != ALLOW, F.lit(True)).alias("blocks"),
        )
        .filter(~F.col("host").rlike("[/?#]") & ~F.col("path").rlike("[?#]") & (F.col("host") != ""))
        .groupBy("host", "path")
        .agg(F.max("blocks").alias("blocks"))
        .withColumn("key", F.concat("host", F.lit(_BETWEEN), "path"))
        .withColumn("digest", F.xxhash64("key"))
    )
    lengths: dict[int, list[int]] = defaultdict(list)
    for row in keyed.select(F.length("host").alias("h"), F.length("path").alias("p")).distinct().toLocalIterator():
        lengths[row.h].append(row.p)
    size = keyed.agg(F.sum(F.octet_length("key") + 17)).first()[0] or 0
    files = materialize(
        keyed.select("digest", "key", "blocks")
        .repartitionByRange(-(-size // RANGE_BYTES) or 1, "digest")
        .sortWithinPartitions("digest", "key")
        .mapInArrow(_files, "first long, content binary")
    )
    names, firsts = [], []
    for row in files.orderBy("first").toLocalIterator():  # one file at a time
        names.append(_shared(spark, bytes(row.content)))
        firsts.append(row.first)
    return Rules(names, firsts, {h: sorted(own, reverse=True) for h, own in lengths.items()})


def _shared(spark: SparkSession, content: bytes) -> str:
    name = f"url-rules-{xxhash.xxh3_128_hexdigest(content)}"
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        out = system.create(where, True)
        out.write(bytearray(content))
        out.close()
    spark.sparkContext.addFile(system.makeQualified(where).toString())
    return name


class _Index(NamedTuple):
    digests: np.ndarray
    ends: np.ndarray
    blocks: np.ndarray
    keys: np.ndarray


@lru_cache(maxsize=1024)
def _mapped(file: str) -> _Index:
    content = np.memmap(file, np.uint8, mode="r")
    size = int.from_bytes(content[:8].tobytes(), "little")
    bounds = np.cumsum([8, 8 * size, 8 * size + 8, size])
    digests, ends, blocks = (content[a:b] for a, b in zip(bounds, bounds[1:]))
    return _Index(digests.view(np.int64), ends.view(np.int64), blocks, content[bounds[-1] :])


def _keys(host: str, path: str, lengths: dict[int, list[int]]) -> list[str]:
    """Possible keys, from longest to shortest; of equally long ones that with the longer host first.

    Only hosts as long as a rule's are looked at, so that a url of any length has no more keys than the list has lengths.
    """
    sizes = [h for h in lengths if 0 < h <= len(host) and (h == len(host) or host[-h - 1] == ".")]
    pairs = sorted(((h + p, h) for h in sizes for p in lengths[h] if p <= len(path)), reverse=True)
    return [host[-h:] + _BETWEEN + path[: both - h] for both, h in pairs]


def _found(index: _Index, probes: np.ndarray, keys: list[bytes], wanted: np.ndarray) -> Iterator[tuple[int, bool]]:
    """(number of a key, whether its rule blocks) of the wanted keys that are in the index."""
    places = np.searchsorted(index.digests, probes[wanted], side="left")
    inside = places < len(index.digests)
    hit = np.zeros(len(wanted), bool)
    hit[inside] = index.digests[places[inside]] == probes[wanted[inside]]
    for number, place in zip(wanted[hit].tolist(), places[hit].tolist()):
        while place < len(index.digests) and index.digests[place] == probes[number]:
            if index.keys[index.ends[place] : index.ends[place + 1]].tobytes() == keys[number]:
                yield number, bool(index.blocks[place])
            place += 1


def _judged(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    firsts = np.array(rules.firsts, np.int64)
    for batch in batches:
        keys: list[bytes] = []
        owners: list[int] = []
        for row, pair in enumerate(zip(batch.column("host").to_pylist(), batch.column("path").to_pylist())):
            own = [key.encode() for key in _keys(*pair, rules.lengths)]
            keys += own
            owners += [row] * len(own)
        probes = np.array([xxhash.xxh64_intdigest(key, SEED) for key in keys], np.uint64).view(np.int64)
        low = np.searchsorted(firsts, probes, side="left") - 1  # equal digests may lie in two ranges
        high = np.searchsorted(firsts, probes, side="right") - 1
        found: dict[int, tuple[int, bool]] = {}
        for number in range(len(firsts)):
            wanted = np.flatnonzero((low <= number) & (number <= high))
            if len(wanted):
                for key, blocks in _found(_mapped(SparkFiles.get(rules.names[number])), probes, keys, wanted):
                    row = owners[key]
                    if row not in found or key < found[row][0]:  # a url's longest key comes first
                        found[row] = key, blocks
        hits = [found.get(row) for row in range(len(batch))]
        columns = [batch.column(c) for c in ("page_id", "host", "path")]
        yield pa.RecordBatch.from_arrays(
            [
                *columns, pa.array([hit and keys[hit[0]].decode().replace(_BETWEEN, "", 1) for hit in hits], pa.string()),
                pa.array([BLOCK if hit and hit[1] else ALLOW for hit in hits], pa.string()),
            ],
            names=["page_id", "host", "path", "rule", "verdict"],
        )


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page by the longest rule that fits its url.

    `pages` has page_id and url, `rules` host, path and verdict (`allow` or `block`); other columns are not looked at. A
    rule fits its host and all subdomains where the url's path starts with the rule's; the longest counts, of equally long
    ones that with the longer host. `rule` is host and path, null where
    none fits, and the verdict is then `allow`: what is not on the list passes. Null urls and urls without `://` have
    an empty host and path, which nothing fits. Repeated pages are judged each. No rules: all pass.
    """
    index = build(pages.sparkSession, rules)
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), host("url").alias("host"), path("url").alias("path"))
    return given.mapInArrow(
        lambda batches: _judged(batches, index), "page_id long, host string, path string, rule string, verdict string"
    )

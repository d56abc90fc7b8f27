"""The named queries over the given tables, each next to SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


# Shared beginnings of the SQL: the bindings of `duploscope.plans.bindings`.
DOCS = """
WITH docs AS (
  SELECT doc_id * 2 + a AS item_id, doc_id, lang, '/' || source AS root,
         '/' || source || '/' || lang || CASE WHEN a = 1 THEN '/links/' ELSE '/' END || 'doc-' || doc_id || '.' || ext AS path,
         'doc-' || doc_id || '.' || ext AS file_name, '.' || ext AS extension,
         strlen(text) AS length, TIMESTAMP '2024-01-01' + to_hours(CAST((doc_id * 37) % 1000 AS INTEGER)) AS modified_at,
         coalesce(toxic, 0) = 1 AS hidden, text, a
  FROM (SELECT d.*, l.toxic, (['txt', 'JPG', 'mp3', 'mkv', 'zip', 'blend'])[doc_id % 6 + 1] AS ext, v.a
        FROM documents d LEFT JOIN labels l USING (doc_id), (VALUES (0), (1)) v(a)
        WHERE v.a = 0 OR doc_id % 25 = 0))
"""
ITEMS = DOCS + """,
items AS (SELECT * EXCLUDE (rn) FROM
            (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY upper(path), path) AS rn FROM docs) WHERE rn = 1)
"""
GROUPS = ITEMS + """,
grps AS (SELECT arg_min(item_id, upper(path)) AS group_id, arg_min(path, upper(path)) AS first_path,
                arg_min(modified_at, upper(path)) AS first_modified_at, length, text,
                count(*) AS members, CAST((count(*) - 1) * length AS BIGINT) AS reclaimable
         FROM items GROUP BY length, text HAVING count(*) > 1),
mem AS (SELECT i.*, g.group_id, g.first_path FROM items i JOIN grps g USING (length, text)),
indexed AS (SELECT *, row_number() OVER (ORDER BY upper(first_path), first_path) - 1 AS group_index FROM grps)
"""
REVIEW_TYPE = """CASE lower({0}) WHEN '.txt' THEN 'Documents' WHEN '.jpg' THEN 'Photos' WHEN '.mp3' THEN 'Audio'
  WHEN '.mkv' THEN 'Videos' WHEN '.zip' THEN 'Archives' ELSE 'Other' END"""
FILE_TYPE = """CASE lower({0}) WHEN '.txt' THEN 'Documents' WHEN '.jpg' THEN 'Images' WHEN '.mp3' THEN 'Audio'
  WHEN '.mkv' THEN 'Video' WHEN '.zip' THEN 'Archives' ELSE 'Other' END"""
SIZE_BUCKET = """CASE WHEN {0} < 1048576 THEN 'LessThan1Mb' WHEN {0} < 10485760 THEN 'OneTo10Mb'
  WHEN {0} < 104857600 THEN 'TenTo100Mb' WHEN {0} <= 1073741824 THEN 'OneHundredMbTo1Gb' ELSE 'MoreThan1Gb' END"""
FORMAT_BYTES = """CASE WHEN {0} < 1024 THEN format('{{:,}} B', {0})
  WHEN {0} < 1048576 THEN format('{{:,.1f}} KB', round({0} / 1024.0, 1)) ELSE format('{{:,.1f}} MB', round({0} / 1048576.0, 1)) END"""
ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00'"

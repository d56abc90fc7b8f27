"""Queries on duplicate folders and folder comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duploscope.functions import ranking
from duploscope.operators import compare, exact, trees
from duploscope.plans import bindings
from duploscope.plans.registry import DOCS, query
from duploscope.plans.scanning import MIRROR_RIGHT
from duploscope.session import materialize
from duploscope.sources import reports


def _proved(items: DataFrame, content: DataFrame) -> DataFrame:
    return materialize(exact.verify_content(items, content))


def _twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _proved(bindings.twin_trees(spark, sf_dir), bindings.mirror_content(spark, sf_dir))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of `order_trees`, proved on their bytes."""
    files = materialize(bindings.order_files(spark, sf_dir))
    return _proved(bindings.order_trees(files), bindings.order_content(files))


DOC_FOLDERS = DOCS + """,
placed AS (SELECT *, unnest(CASE WHEN a = 1 THEN [root, root || '/' || lang, root || '/' || lang || '/links']
                                 ELSE [root, root || '/' || lang] END) AS folder FROM docs)
"""


@query("folder_metrics", DOC_FOLDERS + """
SELECT folder, CAST(sum(n) AS BIGINT) AS logical_files, count(*) AS distinct_identities, CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(sum(one) AS BIGINT) AS distinct_bytes
FROM (SELECT folder, doc_id, count(*) AS n, sum(length) AS bytes, min(length) AS one FROM placed GROUP BY folder, doc_id) GROUP BY folder""")
def folder_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.folder_metrics(trees.expand_folders(bindings.docs(spark, sf_dir)))


@query("root_metrics", DOCS + """
SELECT root AS folder, count(*) AS logical_files, count(DISTINCT doc_id) AS distinct_identities, CAST(sum(length) AS BIGINT) AS total_bytes,
       CAST(sum(CASE WHEN a = 0 THEN length ELSE 0 END) AS BIGINT) AS distinct_bytes FROM docs GROUP BY root""")
def root_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without recursion there is one folder per root, with all files below it."""
    return trees.folder_metrics(trees.expand_folders(bindings.docs(spark, sf_dir), recursive=False))


ORDERS = """
WITH lines AS (SELECT '/orders/' || l_orderkey AS folder, l_linenumber || l_returnflag AS rel, min(l_linestatus) AS status
               FROM lineitem GROUP BY l_orderkey, l_linenumber, l_returnflag),
shapes AS (SELECT folder, string_agg(rel, '|' ORDER BY rel) AS shape, string_agg(rel || status, '|' ORDER BY rel) AS tree, count(*) AS n FROM lines GROUP BY folder)
"""


@query("structural_candidates", ORDERS + """
SELECT folder, min(folder) OVER (PARTITION BY shape) AS first_folder FROM shapes QUALIFY count(*) OVER (PARTITION BY shape) > 1""")
def structural_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.equal_folders(_orders(spark, sf_dir), ["length"])


@query("duplicate_trees", ORDERS + """
SELECT folder, min(folder) OVER (PARTITION BY tree) AS group_folder FROM shapes QUALIFY count(*) OVER (PARTITION BY tree) > 1""")
def duplicate_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.tree_groups(_orders(spark, sf_dir)).members


@query("tree_reclaimable", ORDERS + """
SELECT min(folder) AS group_folder, count(*) AS folders, min(n) AS logical_files, CAST(sum(n) AS BIGINT) AS distinct_identities, min(n) AS total_bytes,
       CAST(sum(n) - min(n) AS BIGINT) AS reclaimable FROM shapes GROUP BY tree HAVING count(*) > 1""")
def tree_reclaimable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.tree_groups(_orders(spark, sf_dir)).groups


TWINS = """
WITH files AS (SELECT doc_id, top, '/' || source || '/' || lang || '/doc-' || doc_id || '.' || (['txt', 'JPG', 'mp3', 'mkv', 'zip', 'blend'])[doc_id % 6 + 1] AS rel,
                      source, lang, text, strlen(text) AS length
               FROM documents, (VALUES ('/a'), ('/c')) v(top) WHERE top = '/a' OR doc_id % 50 <> 0),
placed AS (SELECT *, unnest([top, top || '/' || source, top || '/' || source || '/' || lang]) AS folder FROM files),
sets AS (SELECT folder, string_agg(substr(top || rel, length(folder) + 2) || ' ' || sha256(text), '|' ORDER BY top || rel) AS tree,
                count(*) AS n, CAST(sum(placed.length) AS BIGINT) AS bytes FROM placed GROUP BY folder),
found AS (SELECT folder, n, bytes, min(folder) OVER (PARTITION BY tree) AS group_folder FROM sets QUALIFY count(*) OVER (PARTITION BY tree) > 1),
nested AS (SELECT group_folder FROM found f GROUP BY group_folder HAVING count(*) = count(*) FILTER (
             EXISTS (SELECT 1 FROM found p WHERE p.folder = regexp_extract(f.folder, '^(.*)/[^/]*$', 1)))),
kept AS (SELECT * FROM found WHERE group_folder NOT IN (FROM nested)),
results AS (SELECT k.*, (SELECT (count(*) - 1) * k.bytes FROM kept o WHERE o.group_folder = k.group_folder) AS reclaimable FROM kept k),
numbered AS (SELECT *, dense_rank() OVER (ORDER BY group_folder) AS g FROM results)
"""


@query("nested_suppression", TWINS + "SELECT folder, group_folder FROM kept")
def nested_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal folders of both trees, without those inside larger equal folders."""
    return trees.find_duplicate_folders(_twins(spark, sf_dir)).members


@query("folder_results", TWINS + """
SELECT row_number() OVER (ORDER BY bytes DESC, folder) AS place, folder, n AS logical_files, bytes AS total_bytes, CAST(reclaimable AS BIGINT) AS reclaimable
FROM results WHERE n >= 3 AND contains(upper(folder), 'SRC1')""")
def folder_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching folders with their places, the largest first."""
    results = trees.folder_results(trees.find_duplicate_folders(_twins(spark, sf_dir)))
    kept = trees.filter_folder_results(results, min_files=3, search="Src1 ", sort="size")
    placed = ranking.global_rank(kept, trees.folder_order("size"), "place")
    return placed.select((F.col("place") + 1).alias("place"), "folder", "logical_files", "total_bytes", "reclaimable")


def _numbered(found: trees.FolderGroups) -> DataFrame:
    return ranking.global_rank(found.groups, [F.col("group_folder")], "group_index")


@query("folder_report_rows", TWINS + """
SELECT g AS "Group", folder AS "Folder root", n AS "Logical file count", n AS "Independent physical files", bytes AS "Total logical bytes",
       CAST(reclaimable AS BIGINT) AS "Potential reclaimable bytes" FROM numbered""")
def folder_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _twins(spark, sf_dir)
    found = trees.find_duplicate_folders(items)
    metrics = trees.folder_metrics(trees.expand_folders(items))
    return reports.folder_report_rows(trees.folder_results(found), _numbered(found), metrics)


@query("folder_report_text", TWINS + """
SELECT DISTINCT g AS "Group", line FROM (
  SELECT g, unnest(['Group ' || g, 'Logical files: ' || n, 'Independent physical files: ' || (SELECT CAST(sum(o.n) AS BIGINT) FROM kept o WHERE o.group_folder = numbered.group_folder),
    'Potential reclaimable bytes: ' || CAST(reclaimable AS BIGINT), '  ' || folder, '']) AS line FROM numbered)""")
def folder_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trees.find_duplicate_folders(_twins(spark, sf_dir))
    return reports.folder_report_text(found.groups, found.members, _numbered(found)).select("Group", "line")


COMPARED = MIRROR_RIGHT + """,
left_side AS (SELECT doc_id, source || '/' || lang || '/doc-' || doc_id || '.' || (['txt', 'JPG', 'mp3', 'mkv', 'zip', 'blend'])[doc_id % 6 + 1] AS rel,
                     text, TIMESTAMP '2024-01-01' + to_hours(CAST((doc_id * 37) % 1000 AS INTEGER)) AS modified FROM documents),
targets AS (SELECT '/b' AS target, (['', 'moved/', 'copy/'])[r.place + 1] || l.rel AS rel, r.body AS text, l.modified + to_hours(CASE WHEN r.changed THEN 5 ELSE 0 END) AS modified
            FROM right_side r JOIN left_side l USING (doc_id)
            UNION ALL SELECT '/c', rel, text, modified FROM left_side WHERE doc_id % 50 <> 0),
masters AS (SELECT v.target, l.* FROM left_side l, (VALUES ('/b'), ('/c')) v(target)),
pairs AS (SELECT coalesce(m.target, t.target) AS target, coalesce(m.rel, t.rel) AS rel, m.rel AS mrel, t.rel AS trel, m.text AS mtext, t.text AS ttext,
                 m.modified AS mmod, t.modified AS tmod FROM masters m FULL JOIN targets t ON m.target = t.target AND m.rel = t.rel),
extra AS (SELECT target, ttext AS text, count(*) AS n, list(target || '/' || trel ORDER BY trel) AS found, arg_min(tmod, trel) AS tmod
          FROM pairs WHERE mrel IS NULL GROUP BY target, ttext),
compared AS (
  SELECT target, rel AS relative, CASE WHEN mtext = ttext THEN 'Identical' ELSE 'Different' END AS status, '/a/' || mrel AS master_path,
         [target || '/' || trel] AS found, CAST(1 AS BIGINT) AS n, strlen(mtext) AS msize, strlen(ttext) AS tsize, mmod, tmod, CAST(NULL AS VARCHAR) AS mset
  FROM pairs WHERE mrel IS NOT NULL AND trel IS NOT NULL
  UNION ALL SELECT p.target, p.rel, CASE WHEN e.n IS NULL THEN 'OnlyInMaster' ELSE 'MovedRenamedExactMatch' END, '/a/' || p.mrel, e.found, coalesce(e.n, 0),
         strlen(p.mtext), CASE WHEN e.n > 0 THEN strlen(p.mtext) END, p.mmod, e.tmod, CASE WHEN e.n > 0 THEN sha256(p.mtext) END
  FROM pairs p LEFT JOIN extra e ON e.target = p.target AND e.text = p.mtext WHERE p.trel IS NULL
  UNION ALL SELECT p.target, p.rel, 'OnlyInTarget', NULL, [p.target || '/' || p.trel], 1, NULL, strlen(p.ttext), NULL, p.tmod, NULL
  FROM pairs p WHERE p.mrel IS NULL AND NOT EXISTS (SELECT 1 FROM pairs o WHERE o.trel IS NULL AND o.target = p.target AND o.mtext = p.ttext))
"""


def compared(spark: SparkSession, sf_dir: str) -> compare.Comparison:
    """/a against /b and /c; the master is named among the targets once more and left out."""
    master, changed = bindings.mirror(spark, sf_dir)
    twins = bindings.twin_trees(spark, sf_dir).filter("root = '/c'")
    content = bindings.mirror_content(spark, sf_dir)
    everything = _proved(master.unionByName(changed).unionByName(twins), content)
    return compare.compare_master(
        everything.filter("root = '/a'"), everything.filter("root <> '/a'"), "/a", ["/c", "/b/", "/A", "/b"]
    )


@query("compare_rows", COMPARED + """
SELECT target, relative, status, master_path, found[1] AS compared_path, n AS compared_count, msize AS master_size, tsize AS compared_size FROM compared""")
def compare_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.sort_compare_rows(compared(spark, sf_dir).rows).select(
        "target", "relative", "status", "master_path", "compared_path", "compared_count", "master_size", "compared_size"
    )


@query("match_sets", COMPARED + """
SELECT p.target, '/' || p.trel AS compared_relative FROM pairs p
WHERE p.mrel IS NULL AND EXISTS (SELECT 1 FROM pairs o WHERE o.trel IS NULL AND o.target = p.target AND o.mtext = p.ttext)""")
def match_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = compared(spark, sf_dir).match_sets
    return sets.select("target", F.concat(F.lit("/"), "compared_relative").alias("compared_relative"))


@query("compare_summary", COMPARED + """
SELECT target, (SELECT count(*) FROM left_side) AS master_files, (SELECT count(*) FROM targets t WHERE t.target = compared.target) AS target_files,
       count(*) FILTER (status = 'Identical') AS identical, count(*) FILTER (status = 'Different') AS different,
       count(*) FILTER (status = 'OnlyInMaster') AS only_in_master, count(*) FILTER (status = 'OnlyInTarget') AS only_in_target,
       count(*) FILTER (status = 'MovedRenamedExactMatch') AS moved, CAST(coalesce(sum(msize) FILTER (status = 'Identical'), 0) AS BIGINT) AS identical_bytes
FROM compared GROUP BY target""")
def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(spark, sf_dir).summary


@query("compare_filtered", COMPARED + "SELECT target, relative FROM compared WHERE status = 'OnlyInMaster' AND contains(upper(relative), 'SRC1')")
def compare_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.filter_compare_rows(compared(spark, sf_dir).rows, "OnlyInMaster", " src1").select("target", "relative")


ISO_OR_EMPTY = "coalesce(strftime({0}, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00', '')"


@query("comparison_report_rows", COMPARED + f"""
SELECT target AS "Target", status AS "Status", relative AS "Relative path", coalesce(master_path, '') AS "Master path",
       coalesce(found[1] || CASE WHEN n > 1 THEN ' (+' || (n - 1) || ')' ELSE '' END, '') AS "Compared path", coalesce(CAST(msize AS VARCHAR), '') AS "Master size",
       coalesce(CAST(tsize AS VARCHAR), '') AS "Compared size", {ISO_OR_EMPTY.format('mmod')} AS "Master modified UTC",
       {ISO_OR_EMPTY.format('tmod')} AS "Compared modified UTC", coalesce(mset, '') AS "Match set" FROM compared""")
def comparison_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = compared(spark, sf_dir)
    return reports.comparison_report_rows(result.rows)


@query("comparison_report_moved", COMPARED + """
SELECT p.target AS "Target", CAST(strlen(p.ttext) AS VARCHAR) AS "Size", sha256(p.ttext) AS "Content", '/' || p.trel AS "Relative path",
       p.target || '/' || p.trel AS "Compared path" FROM pairs p
WHERE p.mrel IS NULL AND EXISTS (SELECT 1 FROM pairs o WHERE o.trel IS NULL AND o.target = p.target AND o.mtext = p.ttext)""")
def comparison_report_moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = reports.comparison_report_moved(compared(spark, sf_dir).match_sets)
    return moved.withColumn("Relative path", F.concat(F.lit("/"), F.col("Relative path")))


@query("comparison_report_head", COMPARED + """
SELECT target, CAST(i AS BIGINT) AS line_no, CASE i WHEN 0 THEN 'Master: /a' WHEN 1 THEN 'Compared: ' || target ELSE '' END AS line
FROM (SELECT DISTINCT target FROM compared), (VALUES (0), (1), (2)) v(i)""")
def comparison_report_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = reports.comparison_report_head(compared(spark, sf_dir).summary, "/a")
    return head.withColumn("line_no", F.col("line_no").cast("long"))


@query("comparison_report_text", COMPARED + """
SELECT target, relative, CAST(i AS BIGINT) AS line_no, CASE i WHEN 0 THEN status || ' | ' || relative WHEN 1 THEN '  Master: ' || coalesce(master_path, '(none)')
       ELSE '  Compared: ' || coalesce(found[1] || CASE WHEN n > 1 THEN ' (+' || (n - 1) || ')' ELSE '' END, '(none)') END AS line
FROM compared, (VALUES (0), (1), (2)) v(i)""")
def comparison_report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = compared(spark, sf_dir)
    lines = reports.comparison_report_text(result.rows)
    return lines.select("target", "relative", F.col("line_no").cast("long").alias("line_no"), "line")

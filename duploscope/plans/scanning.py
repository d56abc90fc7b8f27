"""Queries on paths, filters and exact detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duploscope.functions import formats, paths
from duploscope.operators import eligibility, exact
from duploscope.plans import bindings
from duploscope.plans.registry import DOCS, FILE_TYPE, FORMAT_BYTES, GROUPS, ISO, ITEMS, REVIEW_TYPE, SIZE_BUCKET, query

CRITERIA = eligibility.Criteria(
    types=frozenset({"Documents", "Images", "Audio"}), custom_extensions=("blend",), min_bytes=200, max_bytes=20_000
)
POLICY = eligibility.Policy(criteria=CRITERIA, excluded_folders=("/src7/en",), excluded_extensions=("mp3",))
REASON_SQL = """CASE WHEN length < 200 THEN 'BelowMinimumSize' WHEN length > 20000 THEN 'AboveMaximumSize'
  WHEN lower(extension) IN ('.txt', '.jpg', '.mp3', '.blend') THEN NULL ELSE 'FileTypeExcluded' END"""
EXCLUDING_SQL = "CASE WHEN lower(extension) = '.mp3' THEN 'ExtensionExcluded' ELSE " + REASON_SQL + " END"


def exact_result(spark: SparkSession, sf_dir: str, funnel: exact.Funnel | None = None) -> exact.ExactDuplicates:
    return exact.find_exact_duplicates(
        bindings.docs_listing(spark, sf_dir), bindings.docs_content(spark, sf_dir), bindings.docs_digests(spark, sf_dir), funnel
    )


@query("path_functions", r"""
SELECT page_id AS item_id, regexp_extract(url, '([^/\\]*)$', 1) AS file_name,
       regexp_extract(url, '(\.[^./\\]+)$', 1) AS extension, regexp_extract(url, '^(.*)[/\\][^/\\]*$', 1) AS folder,
       regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, CAST(length(url) - length(replace(url, '/', '')) AS BIGINT) AS depth,
       substr(url, length(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)) + 2) AS relative
FROM pages""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.page_items(spark, sf_dir).select(
        "item_id",
        "file_name",
        "extension",
        paths.containing_folder("path").alias("folder"),
        "root",
        paths.path_depth("path").cast("long").alias("depth"),
        paths.relative_path("root", "path").alias("relative"),
    )


@query("item_labels", DOCS + f"""
SELECT item_id, lower(extension) AS normalized, {FILE_TYPE.format('extension')} AS file_type,
       {REVIEW_TYPE.format('extension')} AS review_type, {SIZE_BUCKET.format('length * 100000')} AS size_bucket,
       {FORMAT_BYTES.format('length')} AS size_text, {ISO.format('modified_at')} AS modified, sha256(text) AS digest
FROM docs""")
def item_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension, type, size and time functions on every item; sizes are scaled up to reach all buckets."""
    return bindings.docs(spark, sf_dir).select(
        "item_id",
        paths.normalize_extension("extension").alias("normalized"),
        paths.classify_file_type("extension").alias("file_type"),
        paths.review_type("extension").alias("review_type"),
        formats.size_bucket(F.col("length") * 100_000).alias("size_bucket"),
        formats.format_bytes("length").alias("size_text"),
        formats.iso_utc("modified_at").alias("modified"),
        "digest",
    )


@query("folder_ancestors", DOCS + """
SELECT item_id, folder, substr(path, length(folder) + 2) AS relative
FROM (SELECT item_id, path, unnest(CASE WHEN a = 1 THEN [root, root || '/' || lang, root || '/' || lang || '/links']
                                        ELSE [root, root || '/' || lang] END) AS folder FROM docs)""")
def folder_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        bindings.docs(spark, sf_dir)
        .select("item_id", "path", F.explode(paths.ancestors("path", "root")).alias("folder"))
        .select("item_id", "folder", paths.relative_path("folder", "path").alias("relative"))
    )


PAGE_FOLDERS = r"""
WITH folders AS (SELECT DISTINCT regexp_replace(regexp_extract(url, '^(.*)[/\\][^/\\]*$', 1), '/+$', '') AS root FROM pages)
"""


def _page_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.table(spark, sf_dir, "pages").select(paths.containing_folder("url").alias("root")).distinct()


@query("collapsed_roots", PAGE_FOLDERS + """
SELECT root FROM folders f
WHERE NOT EXISTS (SELECT 1 FROM folders o WHERE starts_with(upper(f.root), upper(o.root) || '/'))""")
def collapsed_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.collapse_roots(_page_folders(spark, sf_dir))


@query("location_resolution", PAGE_FOLDERS + """
SELECT page_id AS item_id, arg_max(root, length(root)) AS location
FROM pages JOIN folders ON starts_with(upper(url), upper(root) || '/') OR upper(url) = upper(root) GROUP BY page_id""")
def location_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest known folder over each page."""
    items = bindings.page_items(spark, sf_dir).select("item_id", "path")
    return paths.resolve_location_by_table(items, _page_folders(spark, sf_dir)).select("item_id", "location")


@query("descendants", DOCS + """
SELECT item_id, starts_with(path, '/src1/') OR starts_with(path, '/src2/en/') AS inside,
       starts_with(path, '/src1/en/links/') AS below_links FROM docs""")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.docs(spark, sf_dir).select(
        "item_id",
        paths.under_any("path", ["/SRC1/", "/src2/en"]).alias("inside"),
        paths.is_strict_descendant("path", F.lit("/src1/en/LINKS")).alias("below_links"),
    )


@query("search_hits", DOCS + """
SELECT item_id FROM docs WHERE contains(upper(path), 'C1/EN') OR contains(upper(extension), 'C1/EN')""")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bindings.docs(spark, sf_dir).filter(paths.search_match("c1/en", "file_name", "extension", "path")).select("item_id")


MIRROR_RIGHT = """
WITH right_side AS (
  SELECT doc_id, place, doc_id % 11 = 0 AND place = 0 AS changed,
         CASE WHEN doc_id % 11 = 0 AND place = 0 THEN text || 'x' ELSE text END AS body, text, source, lang
  FROM (SELECT *, unnest(CASE WHEN doc_id % 17 = 0 THEN [first_place, 2] ELSE [first_place] END) AS place
        FROM (SELECT *, CASE WHEN doc_id % 11 = 0 THEN 0 WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS first_place
              FROM documents WHERE doc_id % 7 <> 0)))
"""


@query("content_equality", """
SELECT doc_id, text = CASE WHEN doc_id % 11 = 0 THEN text || 'x' WHEN doc_id % 13 = 0 THEN upper(text) ELSE text END AS equal FROM documents""")
def content_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against a copy, some of which are longer or written otherwise."""
    doc, text = F.col("doc_id"), F.col("text")
    body = F.when(doc % 11 == 0, F.concat(text, F.lit("x"))).when(doc % 13 == 0, F.upper(text)).otherwise(text)
    copies = bindings.table(spark, sf_dir, "documents").withColumn("body", body)
    return copies.select("doc_id", formats.content_equal("text", "body").alias("equal"))


@query("criteria_waterfall", DOCS + f"SELECT item_id, coalesce({REASON_SQL}, 'Accepted') AS reason FROM docs")
def criteria_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = eligibility.evaluate_criteria("extension", "length", CRITERIA)
    return bindings.docs(spark, sf_dir).select("item_id", F.coalesce(reason, F.lit("Accepted")).alias("reason"))


@query("extension_exclusion", DOCS + f"SELECT item_id, coalesce({EXCLUDING_SQL}, 'Accepted') AS reason FROM docs")
def extension_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = eligibility.evaluate_criteria("extension", "length", CRITERIA, ["*.bad", " MP3 "])
    return bindings.docs(spark, sf_dir).select("item_id", F.coalesce(reason, F.lit("Accepted")).alias("reason"))


@query("type_profile", DOCS + """
SELECT profile, count(*) AS items, CAST(sum(length) AS BIGINT) AS bytes
FROM (SELECT length, unnest(list_filter(['all-files', CASE WHEN length >= 104857600 THEN 'large-files' END,
        CASE WHEN lower(extension) IN ('.jpg', '.mkv') THEN 'photos-videos' END,
        CASE WHEN lower(extension) = '.txt' THEN 'documents' END,
        CASE WHEN lower(extension) = '.mp3' THEN 'music' END], lambda p: p IS NOT NULL)) AS profile FROM docs)
GROUP BY profile""")
def type_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each built-in profile takes in, in one scan."""
    accepted = F.array_compact(
        F.array(
            *[
                F.when(eligibility.evaluate_criteria("extension", "length", criteria).isNull(), F.lit(name))
                for name, criteria in eligibility.PROFILES.items()
            ]
        )
    )
    return (
        bindings.docs(spark, sf_dir)
        .select("length", F.explode(accepted).alias("profile"))
        .groupBy("profile")
        .agg(F.count(F.lit(1)).alias("items"), F.sum("length").alias("bytes"))
    )


@query("attribute_rules", DOCS + "SELECT item_id, CASE WHEN hidden THEN 'HiddenByPolicy' ELSE 'Accepted' END AS reason FROM docs")
def attribute_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = eligibility.attribute_policy("attributes", eligibility.Policy())
    return bindings.docs(spark, sf_dir, with_labels=True).select("item_id", F.coalesce(reason, F.lit("Accepted")).alias("reason"))


@query("folder_exclusion", DOCS + """
SELECT 'kept' AS kind, path FROM docs WHERE NOT starts_with(path, '/src7/en/') AND NOT starts_with(path, '/src1/')
UNION ALL SELECT DISTINCT 'FolderExcluded', CASE WHEN starts_with(path, '/src1/') THEN '/src1' ELSE '/src7/en' END
FROM docs WHERE starts_with(path, '/src7/en/') OR starts_with(path, '/src1/')""")
def folder_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = eligibility.exclude_folders(bindings.docs(spark, sf_dir), ["/src7/en", "/src1/", "/SRC1/en"])
    return split.accepted.select(F.lit("kept").alias("kind"), "path").unionByName(
        split.skipped.select(F.col("reason").alias("kind"), "path")
    )


@query("direct_children", ITEMS + """
SELECT 'kept' AS kind, path FROM docs WHERE a = 0
UNION ALL SELECT DISTINCT 'SubfolderExcluded', root || '/' || lang || '/links' FROM docs WHERE a = 1""")
def direct_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language folder as a root: aliases lie in a subfolder."""
    rooted = bindings.docs(spark, sf_dir).withColumn("root", F.regexp_extract("path", "^(/[^/]+/[^/]+)/", 1))
    split = eligibility.include_subfolders(rooted, include=False)
    return split.accepted.select(F.lit("kept").alias("kind"), "path").unionByName(
        split.skipped.select(F.col("reason").alias("kind"), "path")
    )


ENTRIES = DOCS + f""",
folders AS (SELECT DISTINCT root || '/' || lang AS path FROM docs),
bad AS (SELECT path, CASE WHEN path = '/src5/es' THEN 'ReparsePoint' WHEN path = '/src7/en' THEN 'FolderExcluded'
                          ELSE 'HiddenByPolicy' END AS reason
        FROM folders WHERE path IN ('/src3/de', '/src4/fr', '/src5/es', '/src7/en')),
judged AS (SELECT d.item_id, d.path, d.length, CASE WHEN hidden THEN 'HiddenByPolicy' ELSE {EXCLUDING_SQL} END AS reason
           FROM docs d WHERE root || '/' || lang NOT IN (SELECT path FROM bad)),
skipped AS (SELECT path, reason FROM judged WHERE reason IS NOT NULL UNION ALL SELECT path, reason FROM bad)
"""


@query("eligible_entries", ENTRIES + """
SELECT path, 'Accepted' AS reason FROM judged WHERE reason IS NULL UNION ALL SELECT path, reason FROM skipped""")
def eligible_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = eligibility.split_eligible(bindings.docs_entries(spark, sf_dir), POLICY)
    return split.accepted.select("path", F.lit("Accepted").alias("reason")).unionByName(split.skipped)


@query("skip_summary", ENTRIES + "SELECT reason, count(*) AS n FROM skipped GROUP BY reason")
def skip_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eligibility.skip_summary(eligibility.split_eligible(bindings.docs_entries(spark, sf_dir), POLICY).skipped)


@query("image_policy", ENTRIES + """
SELECT item_id, path FROM docs WHERE lower(extension) = '.jpg' AND length BETWEEN 200 AND 20000 AND NOT hidden
  AND root || '/' || lang NOT IN (SELECT path FROM bad)""")
def image_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = eligibility.split_eligible(bindings.docs_entries(spark, sf_dir), eligibility.image_policy(POLICY))
    return split.accepted.select("item_id", "path")


@query("root_split", """
SELECT DISTINCT '/' || source AS root, 'Accepted' AS reason FROM documents
UNION ALL SELECT DISTINCT '//' || source, 'NetworkLocation' FROM documents
UNION ALL SELECT DISTINCT source, 'InvalidRoot' FROM documents""")
def root_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots written well, as network shares, as relative names and as folders below other roots."""
    spellings = F.array(
        F.concat(F.lit("/"), "source"), F.concat(F.lit("//"), "source"), F.col("source"), F.concat(F.lit("/"), "source", F.lit("/"), "lang")
    )
    roots = bindings.table(spark, sf_dir, "documents").select(F.explode(spellings).alias("root")).distinct()
    split = eligibility.split_roots(roots)
    return split.accepted.select("root", F.lit("Accepted").alias("reason")).unionByName(
        split.skipped.select(F.col("path").alias("root"), "reason")
    )


@query("identity_dedupe", ITEMS + "SELECT item_id, path, length FROM items")
def identity_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedupe_identity(bindings.docs(spark, sf_dir)).select("item_id", "path", "length")


@query("size_candidates", ITEMS + """
SELECT item_id, length FROM items WHERE length IN (SELECT length FROM items GROUP BY length HAVING count(*) > 1)""")
def size_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.size_candidates(exact.dedupe_identity(bindings.docs(spark, sf_dir))).select("item_id", "length")


@query("digest_buckets", ITEMS + """
SELECT length, sha256(text) AS digest, count(*) AS members FROM items GROUP BY length, sha256(text) HAVING count(*) > 1""")
def digest_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.digest_buckets(exact.dedupe_identity(bindings.docs(spark, sf_dir)))


@query("exact_groups", GROUPS + """
SELECT group_index, group_id, first_path, length, members, reclaimable FROM indexed""")
def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact.with_group_index(exact_result(spark, sf_dir).groups)
    return groups.select("group_index", "group_id", "first_path", "length", "members", "reclaimable")


@query("exact_members", GROUPS + "SELECT group_id, item_id, path, length FROM mem")
def exact_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_result(spark, sf_dir).members.select("group_id", "item_id", "path", "length")


@query("exact_totals", GROUPS + "SELECT CAST(coalesce(sum(reclaimable), 0) AS BIGINT) AS reclaimable FROM grps")
def exact_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.total_reclaimable(exact_result(spark, sf_dir).groups)


FAILURES = ITEMS + """,
readable AS (SELECT *, doc_id % 5 = 3 AS compare_failed, doc_id % 19 = 0 AS validate_failed FROM items WHERE doc_id % 29 <> 0),
whole AS (SELECT *, min(upper(path)) OVER (PARTITION BY length, text) AS whole_key,
                 row_number() OVER (PARTITION BY length, text ORDER BY upper(path)) AS pos,
                 count(*) OVER (PARTITION BY length, text) AS n FROM readable),
flagged AS (SELECT *, pos - sum(CAST(compare_failed AS INT)) OVER (PARTITION BY whole_key ORDER BY pos) AS run FROM whole WHERE n > 1),
runs AS (SELECT *, min(pos) OVER (PARTITION BY whole_key, compare_failed, run) AS start FROM flagged),
ending AS (SELECT *, compare_failed AND (pos - start + CASE WHEN start = 1 THEN 1 ELSE 0 END) % 2 = 0 AS ends FROM runs),
sets AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY whole_key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS set_no FROM ending),
verdicts AS (SELECT *, bool_or(ends) OVER w AS lost, bool_or(validate_failed) OVER w AS stale, count(*) OVER w AS size
             FROM sets WINDOW w AS (PARTITION BY whole_key, set_no))
"""


@query("detection_failures", FAILURES + """
SELECT item_id, 'group ' || min(upper(path)) OVER (PARTITION BY whole_key, set_no) AS state
FROM verdicts WHERE NOT lost AND NOT stale AND size > 1
UNION ALL SELECT item_id, CASE WHEN lost THEN 'ComparisonFailed' ELSE 'ChangedDuringAnalysis' END
FROM verdicts WHERE lost OR (stale AND size > 1)
UNION ALL SELECT item_id, 'HashFailed' FROM items
WHERE doc_id % 29 = 0 AND length IN (SELECT length FROM items GROUP BY length HAVING count(*) > 1)""")
def detection_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unreadable items, failed comparisons and failed final checks, each with its own reach."""
    doc = F.col("identity.id_low")
    inv = (
        bindings.docs(spark, sf_dir)
        .withColumn("digest", F.when(doc % 29 != 0, F.col("digest")))
        .withColumn("compare_failed", doc % 5 == 3)
        .withColumn("validate_failed", doc % 19 == 0)
    )
    result = exact.find_exact_duplicates(inv, bindings.docs_content(spark, sf_dir))
    named = result.members.join(result.groups.select("group_id", "first_path"), "group_id")
    grouped = named.select("item_id", F.concat(F.lit("group "), F.upper("first_path")).alias("state"))
    return grouped.unionByName(result.skipped.select("item_id", F.col("reason").alias("state")))


@query("scan_funnel", GROUPS + f""",
folders AS (SELECT DISTINCT root || '/' || lang AS path FROM docs),
sized AS (SELECT length FROM items GROUP BY length HAVING count(*) > 1)
SELECT 1 AS stage_no, 'found' AS stage, (SELECT count(*) FROM docs) + (SELECT count(*) FROM folders) AS items, (SELECT CAST(sum(length) AS BIGINT) FROM docs) AS bytes
UNION ALL SELECT 2, 'accepted', count(*), CAST(coalesce(sum(length), 0) AS BIGINT) FROM docs WHERE NOT hidden AND ({EXCLUDING_SQL}) IS NULL
   AND root || '/' || lang NOT IN ('/src3/de', '/src4/fr', '/src5/es', '/src7/en')
UNION ALL SELECT 3, 'distinct identity', count(*), CAST(sum(length) AS BIGINT) FROM items
UNION ALL SELECT 4, 'size candidates', count(*), CAST(coalesce(sum(length), 0) AS BIGINT) FROM items WHERE length IN (FROM sized)
UNION ALL SELECT 5, 'hashed', count(*), CAST(coalesce(sum(length), 0) AS BIGINT) FROM items WHERE length IN (FROM sized)
UNION ALL SELECT 6, 'verified groups', count(*), CAST(coalesce(sum(members * length), 0) AS BIGINT) FROM grps
UNION ALL SELECT 7, 'members', CAST(sum(members) AS BIGINT), CAST(coalesce(sum(members * length), 0) AS BIGINT) FROM grps
UNION ALL SELECT 8, 'reclaimable', CAST(sum(members - 1) AS BIGINT), CAST(coalesce(sum(reclaimable), 0) AS BIGINT) FROM grps""")
def scan_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage is counted by the run that passes it."""
    funnel = exact.Funnel()
    listed = bindings.docs_entries(spark, sf_dir).withColumn("digest", F.lit(None).cast("string"))  # nothing is hashed for its entry
    accepted = eligibility.split_eligible(funnel.watch(1, "found", listed), POLICY).accepted
    return funnel.table(accepted, exact_result(spark, sf_dir, funnel))


@query("snapshot_changes", MIRROR_RIGHT + """
SELECT '/' || d.source || '/' || d.lang || '/doc-' || d.doc_id || '.' || (['txt', 'JPG', 'mp3', 'mkv', 'zip', 'blend'])[d.doc_id % 6 + 1] AS path,
       r.doc_id IS NOT NULL AS present, r.doc_id IS NOT NULL AND NOT r.changed AS unchanged
FROM documents d LEFT JOIN (SELECT * FROM right_side WHERE place = 0) r ON r.doc_id = d.doc_id""")
def snapshot_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two sides of the mirror as one tree before and after."""
    before, after = bindings.mirror(spark, sf_dir)
    return exact.snapshot_unchanged(_below(before), _below(same_identities(after)))


def _below(items: DataFrame) -> DataFrame:
    return items.withColumn("path", F.concat(F.lit("/"), paths.relative_path("root", "path")))


def same_identities(after: DataFrame) -> DataFrame:
    """The /b side as a later state of /a: a moved or unmoved document keeps its identity."""
    place = F.col("identity.id_low") % 4
    doc = F.floor(F.col("identity.id_low") / 4)
    return after.withColumn(
        "identity",
        F.when(place == 2, F.col("identity")).otherwise(
            F.struct(F.lit(1).cast("long").alias("volume"), doc.alias("id_low"), F.lit(0).cast("long").alias("id_high"))
        ),
    )

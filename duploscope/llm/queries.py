"""The numbered queries over the given tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duploscope.llm import (
    centroids, decontamination, fingerprints, language, near_dedup, packing, pii, quality, sharding, simhash, token_counts, url_filter,
    vector_codes,
)
from duploscope.llm.columns import fold_of, table

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


@query("op1_document_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against its edited text and the next document."""
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


_WORDS = r"""regexp_split_to_array(trim(regexp_replace(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')), ' ')"""
_SHINGLES = """(SELECT {0}, unnest(CASE WHEN w = [''] THEN [] WHEN len(w) < {1} THEN [array_to_string(w, ' ')]
  ELSE list_transform(generate_series(1, len(w) - {1} + 1), lambda i: array_to_string(w[i:i + {1} - 1], ' ')) END) AS s
  FROM (SELECT {0}, {2} AS w FROM {3}))"""

OP2_SQL = f"""
WITH d AS (SELECT DISTINCT * FROM {_SHINGLES.format("doc_id", 5, _WORDS.format("text"), "documents")}),
i AS (SELECT DISTINCT * FROM {_SHINGLES.format("item_id", 5, _WORDS.format("text"), "benchmark")}),
sizes AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
common AS (SELECT doc_id, item_id, count(*) AS n_common FROM d JOIN i USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_item, n_common, n_common / n_item AS containment FROM common JOIN sizes USING (item_id)
WHERE n_common >= 0.8 * n_item"""


@query("op2_benchmark_decontamination", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that stands in a document."""
    return decontamination.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@query("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per encoded length of documents: how many, and the totals of all documents cut at that length."""
    return token_counts.length_table(token_counts.length_histogram(table(spark, sf_dir, "documents")))


@query("op8_sharding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 contiguous shards of nearly equal bytes."""
    placed = sharding.balanced_shards(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


URL_RULES = [  # host, path, verdict
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

OP9_SQL = rf"""
WITH rules(rule_host, rule_path, verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
best AS (SELECT page_id, host, path, arg_max(struct_pack(rule := rule_host || rule_path, verdict := verdict), length(rule_host || rule_path)) AS b
         FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
         GROUP BY ALL)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM best"""


@query("op9_url_filters", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page by the longest of the rules that fits its url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


@query("op10_pii")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    return pii.span_report(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
s AS (SELECT DISTINCT * FROM {_SHINGLES.format("doc_id", 2, "w", "words")}),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (SELECT a, b FROM edges UNION SELECT reach.doc_id, edges.b FROM reach JOIN edges ON edges.a = reach.other)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(m, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id) USING (doc_id)"""


@query("op3_minhash_near_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the component of its near duplicates, by runs of two words."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; a third of them is not learned from."""
    documents = table(spark, sf_dir, "documents").withColumn("held_out", fold_of("doc_id", 3) == 1)
    model = language.train(documents.filter("NOT held_out"))
    return language.predict(documents, model, ("doc_id", "held_out"))


@query("op6_quality_classifier")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; the labels of a fifth of them are not learned from."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", (fold_of("doc_id", 5) == 0).alias("held_out"))
    labels = table(spark, sf_dir, "labels").filter(fold_of("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    model = quality.train(documents, labels)
    scored = quality.score(documents, model, ("doc_id", "held_out"))
    return scored.select(
        "doc_id", "held_out", "score", F.when(F.col("score") >= quality.ACCEPTED, 1).otherwise(0).alias("predicted")
    )


@query("op11_simhash_near_dedup")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the component of its near duplicates."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


# whole numbers as doubles, in which all sums below are exact
_WHOLE = """SELECT row_number() OVER () AS r, {0}, list_transform(embedding, lambda x: floor({1} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
_APART = "list_dot_product(v, v) + list_dot_product(m, m) - 2 * list_dot_product(v, m)"


def _op12_sql(clusters: int = 16, rounds: int = 3) -> str:
    steps = [
        f"v AS MATERIALIZED (SELECT * FROM ({_WHOLE.format('vec_id', 64)}) WHERE len(v) = 64)",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v AS m FROM v"
        f" ORDER BY sha256('1:' || vec_id), v LIMIT {clusters})",
    ]
    for n in range(rounds + 1):
        steps.append(f"a{n} AS MATERIALIZED (SELECT r, arg_min(c, ({_APART}) * {clusters} + c) AS c, min({_APART}) AS d FROM v, c{n} GROUP BY r)")
        if n < rounds:
            steps.append(
                f"s{n} AS (SELECT c, i, floor(sum(x) / count(*)) AS x FROM (SELECT c, unnest(v) AS x, generate_subscripts(v, 1) AS i"
                f" FROM v JOIN a{n} USING (r)) GROUP BY c, i)"
            )
            steps.append(
                f"c{n + 1} AS MATERIALIZED (SELECT c, coalesce(new.m, c{n}.m) AS m FROM c{n}"
                f" LEFT JOIN (SELECT c, list(x ORDER BY i) AS m FROM s{n} GROUP BY c) new USING (c))"
            )
    return f"""
WITH {", ".join(steps)},
sums AS (SELECT c, sum(d) AS own FROM a{rounds} GROUP BY c)
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, own::BIGINT AS cluster_inertia, (SELECT sum(own) FROM sums)::BIGINT AS inertia,
       sha256(array_to_string(list_transform(m, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM v JOIN a{rounds} USING (r) JOIN sums USING (c) JOIN c{rounds} USING (c)"""


@query("op12_centroid_clustering", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its cluster after three rounds."""
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


def _op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    steps = [
        f"w AS MATERIALIZED ({_WHOLE.format('vec_id, label', 4096)})",
        f"n AS (SELECT len(v) AS n FROM w WHERE len(v) > 0 AND len(v) % {parts} = 0 GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)",
        "k AS MATERIALIZED (SELECT w.* FROM w JOIN n ON len(v) = n)",
        f"p AS MATERIALIZED (SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS v FROM k, range({parts}) t(p))",
        f"first AS (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS c FROM k ORDER BY vec_id, v LIMIT {entries})",
        "c0 AS MATERIALIZED (SELECT p, c, v AS m FROM p JOIN first USING (r))",
    ]
    for n in range(rounds + 1):
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT r, p, arg_min(c, ({_APART}) * {entries} + c) AS c, min({_APART}) AS d FROM p JOIN c{n} USING (p) GROUP BY r, p)"
        )
        if n < rounds:
            steps.append(
                f"s{n} AS (SELECT p, c, i, floor(sum(x) / count(*)) AS x FROM (SELECT p, c, unnest(v) AS x, generate_subscripts(v, 1) AS i"
                f" FROM p JOIN a{n} USING (r, p)) GROUP BY p, c, i)"
            )
            steps.append(
                f"c{n + 1} AS MATERIALIZED (SELECT p, c, coalesce(new.m, c{n}.m) AS m FROM c{n}"
                f" LEFT JOIN (SELECT p, c, list(x ORDER BY i) AS m FROM s{n} GROUP BY p, c) new USING (p, c))"
            )
    return f"""
WITH {", ".join(steps)},
coded AS (SELECT r, string_agg(lpad(to_hex(c), 2, '0'), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, label, lower(code) AS code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(m, lambda x: x::BIGINT), ','), ',' ORDER BY p, c)) FROM c{rounds}) AS codebooks_sha256
FROM k JOIN coded USING (r)"""


@query("op13_vector_codes", _op13_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its code after six rounds."""
    return vector_codes.encode_vectors(table(spark, sf_dir, "embeddings"))

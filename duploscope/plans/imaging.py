"""Queries on similar images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duploscope.functions import images, ranking
from duploscope.operators import grouping, similar
from duploscope.plans import bindings
from duploscope.plans.registry import DOCS, GROUPS, ITEMS, query
from duploscope.plans.removing import _tiered
from duploscope.plans.reviewing import START_SQL, _start


def placed_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.with_positions(images.grid_fingerprint(bindings.grid_images(spark, sf_dir)))


def _bits(test: str) -> str:
    total = f"list_sum(list_transform(range(0, 64), lambda i: CASE WHEN {test} THEN CAST(pow(2, i) AS HUGEINT) ELSE 0 END))"
    return f"CAST(CASE WHEN {total} >= 9223372036854775808 THEN {total} - 18446744073709551616 ELSE {total} END AS BIGINT)"


def _normal(values: str, n: int) -> str:
    """Contrast of a list column with its columns s and q beside it."""
    dev = f"sqrt(CAST({n} * q - s * s AS DOUBLE) / CAST({n * n} AS DOUBLE))"
    level = f"least(255, greatest(0, CAST(round_even(128 + ((v - CAST(s AS DOUBLE) / {n}) * 42 / {dev}), 0) AS INTEGER)))"
    return f"CASE WHEN {dev} < 1 THEN list_transform({values}, lambda v: 128) ELSE list_transform({values}, lambda v: {level}) END"


GRIDS = f"""
WITH raw AS (SELECT vec_id AS item_id, '/img/' || (vec_id % 7) || '/v' || vec_id || '.png' AS path,
    list_transform(embedding, lambda v: least(255, greatest(0, CAST(floor(CAST(v AS DOUBLE) * 256 + 128) AS BIGINT)))) AS g FROM embeddings),
sums AS (SELECT *, CAST(list_sum(g) AS BIGINT) AS s, CAST(list_sum(list_transform(g, lambda v: v * v)) AS BIGINT) AS q FROM raw),
levels AS (SELECT item_id, path, {_normal('g', 64)} AS lum FROM sums),
prints AS (SELECT item_id, path, lum,
    {_bits('lum[i + 1] >= lum[(i // 8) * 8 + least(7, i % 8 + 1) + 1]')} AS difference_h,
    {_bits('lum[i + 1] >= lum[least(7, i // 8 + 1) * 8 + i % 8 + 1]')} AS difference_v,
    {_bits('lum[i + 1] * 64 >= list_sum(lum)')} AS average FROM levels),
placed AS (SELECT *, row_number() OVER (ORDER BY upper(path), path) - 1 AS pos FROM prints)
"""
CANDIDATES = GRIDS + """,
parts AS (SELECT pos, seg, substr(bits, seg * 16 + 1, 16) AS val
          FROM (SELECT pos, CAST(CAST(difference_h AS BIT) AS VARCHAR) || CAST(CAST(difference_v AS BIT) AS VARCHAR) || CAST(CAST(average AS BIT) AS VARCHAR) AS bits FROM placed),
               (SELECT unnest(range(0, 12)) AS seg)),
stored AS (SELECT *, row_number() OVER (PARTITION BY seg, val ORDER BY pos) AS seq FROM parts),
near AS (SELECT DISTINCT p.pos AS first_pos, c.pos AS second_pos FROM stored c JOIN stored p ON p.seg = c.seg AND p.val = c.val AND p.seq < c.seq AND p.seq >= c.seq - 64),
shared AS (SELECT n.first_pos, n.second_pos, count(*) AS shared FROM near n JOIN parts a ON a.pos = n.first_pos JOIN parts b ON b.pos = n.second_pos AND a.seg = b.seg AND a.val = b.val
           GROUP BY ALL),
best AS (SELECT * FROM shared QUALIFY row_number() OVER (PARTITION BY second_pos ORDER BY shared DESC, first_pos) <= 64),
same AS (SELECT min(pos) OVER (PARTITION BY difference_h, difference_v, average) AS first_pos, pos AS second_pos FROM placed QUALIFY first_pos <> second_pos),
cands AS (SELECT first_pos, second_pos FROM best UNION SELECT first_pos, second_pos FROM same)
"""
SCORES_SQL = """1 - CAST(list_sum(list_transform(range(1, 65), lambda i: abs(a.lum[i] - b.lum[i]))) AS DOUBLE) / 64 / 255.0 AS structure,
    ((1 - bit_count(xor(a.difference_h, b.difference_h)) / 64.0) + (1 - bit_count(xor(a.difference_v, b.difference_v)) / 64.0)) / 2 AS difference,
    1 - bit_count(xor(a.average, b.average)) / 64.0 AS average, CAST(1 AS DOUBLE) AS color, CAST(1 AS DOUBLE) AS aspect"""
COMPOSITE_SQL = "0.38::DOUBLE * structure + 0.24::DOUBLE * difference + 0.14::DOUBLE * average + 0.14::DOUBLE * color + 0.10::DOUBLE * aspect AS composite"
SCORED = CANDIDATES + f""",
scored AS (SELECT a.item_id AS first_id, b.item_id AS second_id, {SCORES_SQL}
  FROM cands c JOIN placed a ON a.pos = c.first_pos JOIN placed b ON b.pos = c.second_pos),
strong AS (SELECT *, {COMPOSITE_SQL} FROM scored)
"""


@query("image_hashes", GRIDS + """
SELECT item_id, pos, difference_h, difference_v, average, array_to_string(lum, ',') AS luminance FROM placed""")
def image_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placed_grids(spark, sf_dir).select("item_id", "pos", *images.HASHES, F.array_join("luminance", ",").alias("luminance"))


def _window(window: str) -> str:
    """Samples of `text` as an image 24 wide: whole, or without a border of a sixteenth."""
    if window == "whole":
        x, y = "(2 * (i % 16) + 1) * 24 // 32", "(2 * (i // 16) + 1) * height // 32"
    else:
        x = "1 + (2 * (i % 16) + 1) * 22 // 32"
        y = "greatest(1, height // 16) + (2 * (i // 16) + 1) * greatest(1, height - 2 * greatest(1, height // 16)) // 32"
    at = f"(least(height - 1, {y}) * 24 + least(23, {x})) * 3"
    return f"list_transform(range(0, 256), lambda i: substr(bytes, 2 * ({at}) + 1, 6))"


def _byte(sample: str, n: int) -> str:
    return f"CAST('0x' || substr({sample}, {2 * n + 1}, 2) AS BIGINT)"


def _grey(samples: str) -> str:
    return f"list_transform({samples}, lambda x: (54 * {_byte('x', 2)} + 183 * {_byte('x', 1)} + 19 * {_byte('x', 0)}) // 256)"


def _sample_hashes(lum: str, prefix: str) -> str:
    at = lambda right, down: f"{lum}[least(15, (i // 8 + {down}) * 2) * 16 + least(15, (i % 8 + {right}) * 2) + 1]"
    mean = f"list_sum(list_transform(range(0, 64), lambda j: {lum}[(j // 8) * 32 + (j % 8) * 2 + 1]))"
    return (
        f"{_bits(at(0, 0) + ' >= ' + at(1, 0))} AS {prefix}difference_h, {_bits(at(0, 0) + ' >= ' + at(0, 1))} AS {prefix}difference_v, "
        f"{_bits(at(0, 0) + ' * 64 >= ' + mean)} AS {prefix}average"
    )


PRINTS = f"""
WITH pics AS (SELECT doc_id AS item_id, (strlen(text) + 71) // 72 AS height, hex(text) || repeat('00', CAST((72 - strlen(text) % 72) % 72 AS BIGINT)) AS bytes
         FROM documents WHERE strlen(text) > 0),
samples AS (SELECT item_id, height, {_window('whole')} AS whole, {_window('center')} AS center FROM pics),
greys AS (SELECT item_id, height, whole, {_grey('whole')} AS g, {_grey('center')} AS c FROM samples),
sums AS (SELECT *, CAST(list_sum(g) AS BIGINT) AS s, CAST(list_sum(list_transform(g, lambda v: v * v)) AS BIGINT) AS q,
                CAST(list_sum(c) AS BIGINT) AS cs, CAST(list_sum(list_transform(c, lambda v: v * v)) AS BIGINT) AS cq FROM greys),
levels AS (SELECT item_id, height, whole, {_normal('g', 256)} AS lum, {_normal('c', 256).replace('q - s * s', 'cq - cs * cs').replace('CAST(s AS', 'CAST(cs AS')} AS clum FROM sums),
prints AS MATERIALIZED (SELECT item_id, lum, clum, CAST(24 AS DOUBLE) / height AS aspect,
       list_transform(range(0, 12), lambda k: len(list_filter(whole, lambda x:
         CASE WHEN k < 4 THEN {_byte('x', 2)} WHEN k < 8 THEN {_byte('x', 1)} ELSE {_byte('x', 0)} END // 64 = k % 4))) AS hist,
       {_sample_hashes('lum', '')}, {_sample_hashes('clum', 'center_')}
  FROM levels)
"""
PIXELS = PRINTS + """
SELECT item_id, array_to_string(lum, ',') AS luminance, array_to_string(clum, ',') AS center_luminance, aspect, array_to_string(hist, ',') AS histogram,
       difference_h, difference_v, average, center_difference_h, center_difference_v, center_average FROM prints"""


@query("pixel_fingerprints", PIXELS)
def pixel_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole fingerprints of images whose pixels are the bytes of the documents."""
    prints = images.fingerprint(bindings.text_images(spark, sf_dir))
    listed = {name: F.array_join(name, ",") for name in ("luminance", "center_luminance", "histogram")}
    return prints.withColumns(listed).select("item_id", *images.FINGERPRINT)


@query("lsh_candidates", CANDIDATES + "SELECT first_pos, second_pos FROM cands")
def lsh_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.candidates(placed_grids(spark, sf_dir))


@query("unbounded_candidates", CANDIDATES + """,
every AS (SELECT a.pos AS first_pos, b.pos AS second_pos, count(*) AS shared FROM parts a JOIN parts b ON a.seg = b.seg AND a.val = b.val AND a.pos < b.pos GROUP BY ALL)
SELECT first_pos, second_pos, shared FROM every""")
def unbounded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs with a segment in common, without the bounds for each bucket and image."""
    found = similar.segment_candidates(placed_grids(spark, sf_dir), newest=None, best=None)
    return found.withColumn("shared", F.col("shared").cast("long"))


@query("segment_candidates", CANDIDATES + "SELECT first_pos, second_pos, shared FROM best")
def segment_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.segment_candidates(placed_grids(spark, sf_dir)).withColumn("shared", F.col("shared").cast("long"))


TEXT_PAIRS = PRINTS + """,
placed AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS pos, CAST(round_even(log2(aspect) * 8, 0) AS INT) AS class FROM prints),
parts AS (SELECT pos, class, seg, substr(bits, seg * 16 + 1, 16) AS val
          FROM (SELECT pos, class, CAST(CAST(difference_h AS BIT) AS VARCHAR) || CAST(CAST(difference_v AS BIT) AS VARCHAR) || CAST(CAST(average AS BIT) AS VARCHAR) AS bits FROM placed),
               (SELECT unnest(range(0, 12)) AS seg)),
near AS (SELECT DISTINCT first_pos, second_pos FROM (
           SELECT p.pos AS first_pos, c.pos AS second_pos FROM parts c JOIN parts p ON p.seg = c.seg AND p.val = c.val AND abs(p.class - c.class) <= 1 AND p.pos < c.pos
           QUALIFY row_number() OVER (PARTITION BY c.pos, c.seg, p.class ORDER BY p.pos DESC) <= 64)),
shared AS (SELECT n.first_pos, n.second_pos, count(*) AS shared FROM near n JOIN parts a ON a.pos = n.first_pos JOIN parts b ON b.pos = n.second_pos AND a.seg = b.seg AND a.val = b.val
           GROUP BY ALL),
best AS (SELECT * FROM shared QUALIFY row_number() OVER (PARTITION BY second_pos ORDER BY shared DESC, first_pos) <= 64),
same AS (SELECT min(pos) OVER (PARTITION BY difference_h, difference_v, average) AS first_pos, pos AS second_pos FROM placed QUALIFY first_pos <> second_pos),
cands AS (SELECT first_pos, second_pos FROM best UNION SELECT first_pos, second_pos FROM same)
"""


def _three_ways(score: str) -> str:
    """Whole with whole, centre with whole, whole with centre; A and B stand for the prefixes."""
    return "greatest(" + ", ".join(score.replace("{A}", a).replace("{B}", b) for a, b in (("", ""), ("center_", ""), ("", "center_"))) + ")"


def _meets(sensitivity: str) -> str:
    return " AND ".join(f"{name} >= {least}::DOUBLE" for name, least in images.THRESHOLDS[sensitivity].items())


TIER = "CASE WHEN composite >= 0.93::DOUBLE THEN 'VerySimilar' WHEN composite >= 0.84::DOUBLE THEN 'Similar' ELSE 'LooselySimilar' END"


# All pairs: the first image of each look with those of all others, and every other image of a look with its first.
TEXT_LOOKS = PRINTS + """,
placed AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM prints),
looks AS MATERIALIZED (SELECT pos, item_id, aspect, hist, lum AS luminance, clum AS center_luminance, difference_h, difference_v, average, center_difference_h, center_difference_v, center_average,
       first_value(item_id) OVER (PARTITION BY lum, clum, hist, difference_h, difference_v, average, center_difference_h, center_difference_v, center_average, aspect ORDER BY pos) AS look FROM placed),
sides AS MATERIALIZED (SELECT * FROM looks WHERE look = item_id)
"""


def _text_links(sensitivity: str) -> str:
    least = images.THRESHOLDS[sensitivity]
    difference = _three_ways(
        "((1 - bit_count(xor(a.{A}difference_h, b.{B}difference_h)) / 64.0::DOUBLE) + (1 - bit_count(xor(a.{A}difference_v, b.{B}difference_v)) / 64.0::DOUBLE)) / 2"
    )
    structure = _three_ways(
        "1 - CAST(list_sum(list_transform(range(1, 257), lambda i: abs(a.{A}luminance[i] - b.{B}luminance[i]))) AS DOUBLE) / 256 / 255.0::DOUBLE"
    )
    return TEXT_LOOKS + f""",
close AS MATERIALIZED (SELECT a.pos AS p, b.pos AS q, {difference} AS difference,
    {_three_ways("1 - bit_count(xor(a.{A}average, b.{B}average)) / 64.0::DOUBLE")} AS average, exp(-abs(ln(a.aspect / b.aspect))) AS aspect
  FROM sides a JOIN sides b ON a.pos < b.pos AND {difference} >= {least["difference"]}::DOUBLE),
scored AS (SELECT a.item_id AS first_id, b.item_id AS second_id, {structure} AS structure, n.difference, n.average,
    least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - CAST(list_sum(list_transform(range(1, 13), lambda i: abs(a.hist[i] - b.hist[i]))) AS DOUBLE) / 768)) AS color, n.aspect
  FROM close n JOIN sides a ON a.pos = p JOIN sides b ON b.pos = q),
strong AS (SELECT first_id, second_id, 0.38::DOUBLE * structure + 0.24::DOUBLE * difference + 0.14::DOUBLE * average + 0.14::DOUBLE * color + 0.10::DOUBLE * aspect AS composite,
                  structure, difference, aspect FROM scored),
linked AS (SELECT first_id, second_id, composite FROM strong WHERE {_meets(sensitivity)} UNION ALL SELECT look, item_id, 1.0::DOUBLE FROM looks WHERE look <> item_id)
"""


def placed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.with_positions(images.fingerprint(bindings.text_images(spark, sf_dir)))


@query("identical_candidates", TEXT_PAIRS + "SELECT first_pos, second_pos FROM same")
def identical_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.candidates_identical(placed_texts(spark, sf_dir))


@query("text_image_candidates", TEXT_PAIRS + "SELECT first_pos, second_pos FROM cands")
def text_image_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates among images of many shapes, so that neighbouring aspect classes meet."""
    return similar.candidates(placed_texts(spark, sf_dir))


@query("pair_scores", SCORED + """
SELECT first_id, second_id, round(structure, 6) AS structure, round(difference, 6) AS difference, round(average, 6) AS average,
       round(color, 6) AS color, round(aspect, 6) AS aspect, round(composite, 6) AS composite FROM strong""")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = placed_grids(spark, sf_dir)
    return similar.pair_explain(similar.pair_scores(similar.candidates(placed), placed))


def _text_links_of(spark: SparkSession, sf_dir: str, sensitivity: str) -> DataFrame:
    found = similar.distinct_looks(placed_texts(spark, sf_dir))
    return similar.links(found, similar.close_looks(found.looks, sensitivity, scores=()))


@query("relationships_strict", _text_links("Strict") + f"SELECT first_id, second_id, round(composite, 6) AS composite, {TIER} AS tier FROM linked")
def relationships_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among the images of the documents."""
    return _text_links_of(spark, sf_dir, "Strict").select("first_id", "second_id", F.round("composite", 6).alias("composite"), "tier")


@query("relationships_balanced", _text_links("Balanced") + f"SELECT first_id, second_id, {TIER} AS tier FROM linked")
def relationships_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_links_of(spark, sf_dir, "Balanced").select("first_id", "second_id", "tier")


# All pairs of the grids: few of them are equal, so that every image is compared here.
ALL_SCORED = GRIDS + f""",
scored AS (SELECT a.item_id AS first_id, b.item_id AS second_id, a.pos AS p, b.pos AS q, {SCORES_SQL} FROM placed a JOIN placed b ON a.pos < b.pos),
strong AS (SELECT *, {COMPOSITE_SQL} FROM scored)
"""
GRID_LOOKS = ALL_SCORED + f""",
looks AS (SELECT pos, item_id, first_value(pos) OVER (PARTITION BY lum ORDER BY pos) AS look FROM placed),
linked AS (SELECT strong.* FROM strong JOIN looks a ON a.pos = p JOIN looks b ON b.pos = q WHERE {_meets('Broad')} AND a.look = p AND (b.look = q OR b.look = p))
"""


def _grid_looks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, similar.Looks, DataFrame]:
    """The grids, their looks, and how many links these have: a third of all pairs are linked, so that pairs are not written."""
    placed = placed_grids(spark, sf_dir)
    found = similar.distinct_looks(placed)
    return placed, found, similar.materialize(similar.close_counts(found.looks, "Broad"))


@query("relationships_broad", ALL_SCORED + f"SELECT first_id, second_id, {TIER} AS tier FROM strong WHERE {_meets('Broad')}")
def relationships_broad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of grids that reach the thresholds, those of copies too."""
    found = similar.distinct_looks(placed_grids(spark, sf_dir))
    return similar.links_of_images(found, similar.close_looks(found.looks, "Broad", scores=())).select("first_id", "second_id", "tier")


@query("similar_tiers", GRID_LOOKS + f"SELECT {TIER} AS tier, count(*) AS pairs FROM linked GROUP BY ALL")
def similar_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, counts = _grid_looks(spark, sf_dir)
    return similar.links_by_tier(found, counts)


@query("candidate_recall", _text_links("Balanced").replace("placed AS (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS pos FROM prints)", TEXT_PAIRS.removeprefix(PRINTS).lstrip(",\n")) + f"""
SELECT {TIER} AS tier, count(*) AS links, count(cands.first_pos) AS found FROM linked JOIN placed a ON a.item_id = first_id JOIN placed b ON b.item_id = second_id
LEFT JOIN cands ON cands.first_pos = a.pos AND cands.second_pos = b.pos GROUP BY ALL""")
def candidate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per tier: all links, and how many of them the bounded candidate search finds."""
    placed = placed_texts(spark, sf_dir)
    found = similar.distinct_looks(placed)
    every = similar.links(found, similar.close_looks(found.looks, "Balanced", scores=())).select("first_pos", "second_pos", "tier")
    hits = similar.candidates(placed).withColumn("hit", F.lit(True))
    return every.join(hits, ["first_pos", "second_pos"], "left").groupBy("tier").agg(
        F.count(F.lit(1)).alias("links"), F.count("hit").alias("found")
    )


# The anchors' turns one after the other: a walk over (anchor, neighbour) in order, with what the anchor has and what is used.
LINKED = ALL_SCORED.replace("WITH raw", "WITH RECURSIVE raw", 1) + f""",
related AS MATERIALIZED (SELECT p, q, composite FROM strong WHERE {_meets('Broad')}),
ways AS (SELECT p AS a, q AS b, composite FROM related UNION ALL SELECT q, p, composite FROM related),
degrees AS (SELECT a, count(*) AS d FROM ways GROUP BY a),
meeting AS (SELECT DISTINCT x.b AS p, y.b AS q FROM ways x JOIN ways y ON x.a = y.a AND x.b < y.b),
weighed AS (SELECT p, q, {SCORES_SQL} FROM meeting JOIN placed a ON a.pos = p JOIN placed b ON b.pos = q),
fitting AS (SELECT p, q FROM (SELECT *, {COMPOSITE_SQL} FROM weighed) WHERE {_meets('Broad')}),
fits AS (SELECT p AS b, list(q) AS ok FROM (SELECT p, q FROM fitting UNION ALL SELECT q, p FROM fitting) GROUP BY p),
turns AS MATERIALIZED (SELECT row_number() OVER (ORDER BY d DESC, a, b) AS k, a, b, coalesce(ok, []) AS ok FROM ways JOIN degrees USING (a) LEFT JOIN fits USING (b)),
walk(k, a, mine, used) AS (
  SELECT CAST(0 AS BIGINT), CAST(-1 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[])
  UNION ALL
  SELECT k, a, CASE WHEN NOT list_contains(used, a) AND NOT list_contains(used, b) AND len(list_intersect(mine, ok)) = len(mine) THEN list_append(mine, b) ELSE mine END, used
  FROM (SELECT t.k, t.a, t.b, t.ok, CASE WHEN t.a = w.a THEN w.mine ELSE [] END AS mine,
               CASE WHEN t.a = w.a OR len(w.mine) = 0 THEN w.used ELSE list_concat(w.used, list_append(w.mine, w.a)) END AS used
        FROM walk w JOIN turns t ON t.k = w.k + 1)),
ended AS (SELECT a, arg_max(mine, k) AS mine FROM walk GROUP BY a HAVING len(arg_max(mine, k)) > 0),
joined AS (SELECT a, unnest(mine) AS b FROM ended),
tiers AS (SELECT a, {TIER} AS tier FROM (SELECT a, min(composite) AS composite FROM joined JOIN ways USING (a, b) GROUP BY a)),
grouped AS (SELECT h.item_id AS group_id, m.item_id, m.path, tier FROM (SELECT a, b FROM joined UNION ALL SELECT a, a FROM ended) j
            JOIN tiers USING (a) JOIN placed h ON h.pos = a JOIN placed m ON m.pos = j.b)
"""


@query("complete_link_groups", LINKED + "SELECT group_id, item_id, path, tier FROM grouped")
def complete_link_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy groups, with the turns of independent anchors taken together."""
    placed, found, counts = _grid_looks(spark, sf_dir)
    groups, members = grouping.look_groups(placed, found, counts, "Broad")
    return members.join(groups.select("group_id", "tier"), "group_id")


@query("similarity_stats", LINKED + """
SELECT (SELECT count(*) FROM placed) AS eligible, (SELECT count(*) FROM scored) AS candidate_pairs, (SELECT count(*) FROM scored) AS comparisons,
       (SELECT count(*) FROM related) AS relationships, (SELECT count(*) FROM ended) AS groups""")
def similarity_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, found, counts = _grid_looks(spark, sf_dir)
    return similar.similarity_totals(found, counts, grouping.look_groups(placed, found, counts, "Broad").groups)


@query("image_eligibility", ITEMS + """
SELECT item_id, CASE WHEN lower(extension) = '.jpg' THEN 'Eligible' ELSE 'UnsupportedFormat' END AS reason FROM items""")
def image_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible = similar.eligible_images(bindings.docs(spark, sf_dir))
    return eligible.images.select("item_id", F.lit("Eligible").alias("reason")).unionByName(eligible.skipped.select("item_id", "reason"))


@query("image_skips", ITEMS + """
SELECT item_id, CASE WHEN lower(extension) <> '.jpg' THEN 'UnsupportedFormat' WHEN length % 5 = 0 THEN 'CorruptImage' WHEN length % 5 = 1 THEN 'Inaccessible'
       ELSE 'ChangedDuringAnalysis' END AS reason
FROM items WHERE lower(extension) <> '.jpg' OR length % 5 < 2 OR doc_id % 10 = 3""")
def image_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that did not decode, were not there, or changed while they were looked at."""
    inv = bindings.docs(spark, sf_dir)
    eligible = similar.eligible_images(inv)
    decoded = inv.filter("length % 5 > 1").select("path")
    undecoded = inv.filter("length % 5 = 0").select("path", F.lit("CorruptImage").alias("reason"))
    later = inv.withColumn("length", F.col("length") + F.when(F.col("identity.id_low") % 10 == 3, 1).otherwise(0))
    return similar.image_skips(eligible, decoded, undecoded, later).select("item_id", "reason")


GROUP_TOTALS = GROUPS + """,
totals AS (SELECT g.group_id, g.first_path, count(*) AS photos, max(m.modified_at) AS newest, CAST(sum(m.length) AS BIGINT) AS total_size,
                  CASE WHEN g.members >= 3 THEN 'VerySimilar' ELSE 'Similar' END AS tier FROM grps g JOIN mem m USING (group_id) GROUP BY ALL)
"""


@query("similar_group_filter", GROUP_TOTALS + """
SELECT group_id, tier FROM totals WHERE tier = 'Similar' AND group_id IN (SELECT group_id FROM mem WHERE contains(upper(path), 'SRC1/'))""")
def similar_group_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, members = _tiered(spark, sf_dir)
    return similar.filter_similar_groups(groups, members, "Similar", "src1/").select("group_id", "tier")


def _places_sql(order: str) -> str:
    return GROUP_TOTALS + f"""
SELECT row_number() OVER (ORDER BY {order}, first_path) AS place, group_id, photos, total_size,
       CASE tier WHEN 'Similar' THEN 'Similar' ELSE 'Very similar' END AS tier_label FROM totals"""


def _places(spark: SparkSession, sf_dir: str, by: str, descending: bool) -> DataFrame:
    groups, members = _tiered(spark, sf_dir)
    totals = similar.similar_group_totals(groups.select("group_id", "first_path", "tier"), members)
    placed = ranking.global_rank(totals, similar.similar_order(by, descending), "place")
    return placed.select((F.col("place") + 1).alias("place"), "group_id", "photos", "total_size", "tier_label")


@query("similar_sorted_by_tier", _places_sql("CASE tier WHEN 'VerySimilar' THEN 1 ELSE 2 END, regexp_extract(first_path, '[^/]*$')"))
def similar_sorted_by_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir, "tier", True)


@query("similar_sorted_by_count", _places_sql("photos DESC"))
def similar_sorted_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir, "photo_count", True)


@query("similar_sorted_by_activity", _places_sql("newest"))
def similar_sorted_by_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir, "activity", False)


@query("similar_sorted_by_size", _places_sql("total_size DESC"))
def similar_sorted_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir, "total_size", True)


@query("similar_marks", GROUPS + f"""
, state AS (SELECT group_id, item_id, length, CASE WHEN {START_SQL} THEN 'ConsiderRemoving' ELSE 'None' END AS mark FROM mem),
turns AS (SELECT *, row_number() OVER (PARTITION BY group_id, mark = 'None' ORDER BY item_id) AS turn, count(*) FILTER (mark = 'None') OVER (PARTITION BY group_id) AS free FROM state)
SELECT group_id, count(*) FILTER (mark <> 'None' OR turn < free) AS marked,
       CAST(coalesce(sum(length) FILTER (mark <> 'None' OR turn < free), 0) AS BIGINT) AS marked_bytes FROM turns GROUP BY group_id""")
def similar_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image marked for removal: each group refuses the last one."""
    _, members = _tiered(spark, sf_dir)
    before = _start(members).withColumn("mark", F.when(F.col("selected"), F.lit("ConsiderRemoving")).otherwise(F.lit("None")))
    requests = before.select("item_id", F.col("item_id").alias("request_no"))
    return similar.marked_totals(similar.mark(before, requests, "ConsiderRemoving"), per_group=True)

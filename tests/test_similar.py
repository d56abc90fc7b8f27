import math
import random

import pyarrow as pa
import pytest
from duploscope.functions import images
from duploscope.operators import grouping, similar
from duploscope.session import materialize
from pyspark.sql import functions as F

from tests import models

PRINTS = (
    "item_id long, path string, difference_h long, difference_v long, average long, luminance array<int>, center_difference_h long, "
    "center_difference_v long, center_average long, center_luminance array<int>, histogram array<int>, aspect double"
)


def scene(kind, width=64, height=48, shift=0, gain=1.0, crop=0, turn=0.0):
    """A landscape in BGRA: bands, a bright disc and a slope; the variants move, turn and recolor it."""
    data = bytearray()
    for py in range(height):
        for px in range(width):
            u = (px + 0.5) / width * (64 - 2 * crop) + crop - 32
            v = (py + 0.5) / height * (48 - 2 * crop) + crop - 24
            x, y = u * math.cos(turn) - v * math.sin(turn) + 32, u * math.sin(turn) + v * math.cos(turn) + 24
            if kind == "bands":
                b, g, r = 40 + 2 * y, 60 + 1.5 * x, 90 + 30 * math.sin(x / 9) + y
                if (x - 44) ** 2 + (y - 14) ** 2 < 90:
                    b, g, r = 200, 215, 230
            elif kind == "checks":
                b = g = r = 30 + 190 * ((int(x) // 8 + int(y) // 8) % 2)
            elif kind.startswith("stripes"):
                b = g = r = 230 if int(x) % (2 * int(kind[7:])) < int(kind[7:]) else 20
            else:
                b, g, r = 240 - 3 * y, 30 + 2 * y, 10 + (x * 7) % 60
            data += bytes([*(max(0, min(255, int(c * gain + shift))) for c in (b, g, r)), 255])
    return width, height, bytes(data)


def fingerprints(spark, pictures):
    rows = [(n, f"/p/{name}", w, h, 4, bytearray(data)) for n, (name, (w, h, data)) in enumerate(pictures)]
    return images.fingerprint(spark.createDataFrame(rows, "item_id long, path string, width int, height int, channels int, pixels binary"))


def analyze(spark, pictures, sensitivity):
    placed = similar.with_positions(fingerprints(spark, pictures))
    related = materialize(similar.relationships(similar.candidates(placed), placed, sensitivity))
    return placed, related, grouping.complete_link_groups(placed, related, sensitivity)


def member_sets(found):
    sets = {}
    for row in found.members.collect():
        sets.setdefault(row["group_id"], set()).add(row["path"])
    return sorted(map(sorted, sets.values()))


RELATED = {
    "a": scene("bands"), "b-half": scene("bands", 32, 24), "c-brighter": scene("bands", shift=12), "d-contrast": scene("bands", gain=1.08),
    "e-cropped": scene("bands", crop=2), "f-turned": scene("bands", turn=math.radians(2)), "g-renamed": scene("bands"),
}
OTHERS = {"x-checks": scene("checks"), "y-slope": scene("slope")}


def test_fingerprints_against_a_plain_model(spark):
    pictures = [("a", scene("bands")), ("tiny", scene("slope", 3, 2)), ("wide", scene("checks", 90, 7)), ("flat", (5, 5, bytes([9, 9, 9, 255]) * 25))]
    signed = lambda value: value - 2**64 if value >= 2**63 else value
    for row, (_, (w, h, data)) in zip(fingerprints(spark, pictures).orderBy("item_id").collect(), pictures):
        lum, center, histogram = models.sampled(data, w, h, 4)
        lum, center = models.normalized(lum), models.normalized(center)
        assert row["luminance"] == lum and row["center_luminance"] == center and row["histogram"] == histogram
        assert [row[n] for n in images.HASHES] == [signed(v) for v in models.hashes(lum, 16)]
        assert [row["center_" + n] for n in images.HASHES] == [signed(v) for v in models.hashes(center, 16)]
        assert row["aspect"] == w / h


def test_a_batch_is_described_in_parts(spark, monkeypatch):
    """However many images Spark puts into a batch, numbers are made for a few of them at a time."""
    kept = {}
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda df, work, schema: kept.update(work=work, batches=df.toArrow().to_batches()) or df)
    fingerprints(spark, [(f"n{n}", scene("bands", 3, 2, shift=n % 50)) for n in range(600)])
    whole = pa.Table.from_batches(kept["batches"]).combine_chunks().to_batches()
    parts = [part.num_rows for part in kept["work"](iter(whole))]
    assert len(whole) == 1 and sum(parts) == 600 and max(parts) <= images.DESCRIBED < 600


def test_variants_of_one_scene_are_grouped(spark):
    placed, related, found = analyze(spark, list({**RELATED, **OTHERS}.items()), "Balanced")
    grouped = {path for paths in member_sets(found) for path in paths}
    assert grouped == {f"/p/{name}" for name in RELATED}
    explained = similar.pair_explain(related).first()
    assert set(explained.asDict()) == {"first_id", "second_id", *similar.SCORES, "composite"}
    same = related.filter("first_id = 0 and second_id = 6").first()
    assert same["composite"] == pytest.approx(1.0) and same["tier"] == "VerySimilar"
    stats = similar.similarity_stats(placed, similar.candidates(placed), related, found.groups).first()
    assert stats["eligible"] == 9 and stats["candidate_pairs"] == similar.candidates(placed).count() <= 36


def test_stripes_do_not_chain(spark):
    pictures = [(f"s{n}", scene(f"stripes{n}")) for n in (10, 12, 18)]
    placed, related, found = analyze(spark, pictures, "Broad")
    pairs = {(r["first_pos"], r["second_pos"]) for r in related.collect()}
    for paths in member_sets(found):
        spots = sorted(int(p[4:]) for p in paths)
        assert all((a, b) in pairs for n, a in enumerate([[10, 12, 18].index(s) for s in spots]) for b in [[10, 12, 18].index(s) for s in spots][n + 1:])


def test_input_order_does_not_matter(spark):
    pictures = list({**RELATED, **OTHERS}.items()) + [(f"z{n}", scene(f"stripes{n}")) for n in (4, 5, 6)]
    shuffled = pictures[:]
    random.Random(1).shuffle(shuffled)
    assert member_sets(analyze(spark, pictures, "Broad")[2]) == member_sets(analyze(spark, shuffled, "Broad")[2])


@pytest.mark.parametrize("strength, tier", [(0.95, "VerySimilar"), (0.93, "VerySimilar"), (0.88, "Similar"), (0.84, "Similar"), (0.80, "LooselySimilar")])
def test_tiers(values, strength, tier):
    assert values([strength], images.tier, "double") == [tier]


def random_prints(rng, count, bases=6, noise=3, flat=0):
    """Images around a few bases; `flat` of them share every hash, as blank images do."""
    tops = [[rng.getrandbits(64) for _ in range(3)] for _ in range(bases)]
    lums = [[rng.randrange(60, 196) for _ in range(64)] for _ in range(bases)]
    signed = lambda value: value - 2**64 if value >= 2**63 else value
    rows = []
    for n in range(count):
        base = rng.randrange(bases)
        if n % 3 == 0 and flat:
            hs, lum, hist = [-1, -1, -1], [128] * 64, [0] * 12
            hist[rng.randrange(flat)] = 256
        else:
            hs = list(tops[base])
            for _ in range(rng.randrange(noise)):
                hs[rng.randrange(3)] ^= 1 << rng.randrange(64)
            lum = [v + rng.randrange(-25, 26) for v in lums[base]]
            hist = [0] * 12
        hs = [signed(h) for h in hs]
        rows.append((n, f"/i/{rng.random():.12f}", *hs, lum, *hs, lum, hist, rng.choice([1.0, 1.05, 1.2, 1.34])))
    return rows


def test_candidates_against_a_plain_model(spark):
    """600 images, a third of which share one value in every bucket."""
    rows = random_prints(random.Random(7), 600, flat=3)
    placed = similar.with_positions(spark.createDataFrame(rows, PRINTS))
    ordered = [r.asDict() for r in placed.orderBy("pos").collect()]
    got = {(r["first_pos"], r["second_pos"]) for r in similar.segment_candidates(placed).collect()}
    assert got == models.segment_candidates(ordered)
    both = {(r[0], r[1]) for r in similar.candidates(placed).collect()}
    assert both == got | models.identical_candidates(ordered)
    every = {(r["first_pos"], r["second_pos"]) for r in similar.segment_candidates(placed, newest=None, best=None).collect()}
    assert every == models.segment_candidates(ordered, bucket_size=10**6, best=10**6) and every > got
    per_image = max(sum(second == n for _, second in both) for n in range(600))
    assert per_image <= 65


def test_pairs_that_share_many_segments_come_once_without_being_told_apart(spark):
    """No aggregation of pairs, which would hold as many in a task as there are."""
    rows = random_prints(random.Random(9), 200, bases=2, flat=2)
    placed = similar.with_positions(spark.createDataFrame(rows, PRINTS))
    every = similar.segment_candidates(placed, newest=None, best=None)
    assert "keys=[first_pos" not in every._jdf.queryExecution().toString()
    got = [(r["first_pos"], r["second_pos"], r["shared"]) for r in every.collect()]
    ordered = [r.asDict() for r in placed.orderBy("pos").collect()]
    parts = [models.segments(row) for row in ordered]
    pairs = models.segment_candidates(ordered, bucket_size=10**6, best=10**6)
    assert sorted(got) == sorted((a, b, sum(x == y for x, y in zip(parts[a], parts[b]))) for a, b in pairs) and len(got) > 500


def test_all_pairs_of_small_collections(spark):
    rows = random_prints(random.Random(8), 40)
    placed = similar.with_positions(spark.createDataFrame(rows, PRINTS))
    ordered = [r.asDict() for r in placed.orderBy("pos").collect()]
    few = models.segment_candidates(ordered) | models.identical_candidates(ordered)  # the rule of any size
    assert {tuple(r) for r in similar.candidates(placed).collect()} == few
    assert {tuple(r) for r in similar.candidates_all_pairs(placed, 40).collect()} == {(a, b) for b in range(40) for a in range(b)}
    assert similar.candidates(placed.filter("pos < 1")).isEmpty()
    many = placed.crossJoin(spark.range(7).withColumnRenamed("id", "_n"))
    with pytest.raises(ValueError):
        similar.candidates_all_pairs(many, 256)


@pytest.mark.parametrize("limit", [10_000, 5])
def test_groups_against_a_plain_model(spark, limit):
    """In one task per component and, with the small limit, in rounds."""
    rows = random_prints(random.Random(11), 150, bases=4, flat=4)
    placed = similar.with_positions(spark.createDataFrame(rows, PRINTS))
    pairs = materialize(similar.pair_scores(similar.candidates(placed), placed))
    fits = {(r["first_pos"], r["second_pos"]) for r in pairs.filter(images.meets("Strict")).collect()}
    # a sparser graph than all fitting pairs, so that admission is put to the test
    related = materialize(pairs.filter(images.meets("Strict")).filter("(first_pos * 7 + second_pos * 3) % 4 <> 0").withColumn("tier", images.tier("composite")))
    edges = [(r["first_pos"], r["second_pos"]) for r in related.collect()]
    expected = models.greedy_groups(150, edges, lambda a, b: (min(a, b), max(a, b)) in fits)
    found = grouping.complete_link_groups(placed, related, "Strict", component_limit=limit)
    pos = {r["item_id"]: r["pos"] for r in placed.select("item_id", "pos").collect()}
    got = {}
    for row in found.members.collect():
        got.setdefault(pos[row["group_id"]], []).append(pos[row["item_id"]])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()} and len(got) > 3
    strength = {(r["first_pos"], r["second_pos"]): r["composite"] for r in related.collect()}
    for row in found.groups.collect():
        anchor = pos[row["representative_id"]]
        weakest = min(strength[min(anchor, m), max(anchor, m)] for m in expected[anchor] if m != anchor)
        assert row["photos"] == len(expected[anchor])
        assert row["tier"] == ("VerySimilar" if weakest >= 0.93 else "Similar" if weakest >= 0.84 else "LooselySimilar")


def complete(spark, rows, sensitivity, tile):
    placed = similar.with_positions(spark.createDataFrame(rows, PRINTS))
    found = similar.distinct_looks(placed)
    close = materialize(similar.close_looks(found.looks, sensitivity, tile))
    return placed, found, close


@pytest.mark.parametrize("sensitivity, tile", [("Strict", 1024), ("Balanced", 7), ("Broad", 32)])
def test_links_are_those_of_all_pairs(spark, sensitivity, tile):
    """All pairs by the columns' scores, bit by bit; a third of the images share every hash, and some are copies."""
    rows = random_prints(random.Random(21), 220, bases=5, noise=9, flat=6)
    rows += [(1000 + n, f"/j/{n}", *row[2:]) for n, row in enumerate(rows[:30])]
    placed, found, close = complete(spark, rows, sensitivity, tile)
    every = similar.candidates_all_pairs(placed, 250)
    scored = similar.pair_scores(every, placed).filter(images.meets(sensitivity))
    look = {r["pos"]: r["look"] for r in found.images.collect()}
    names = ("composite", *similar.SCORES)
    expected, copies = {}, set()
    for r in scored.collect():
        one, other = look[r["first_pos"]], look[r["second_pos"]]
        if one == other:
            copies.add((r["first_pos"], r["second_pos"]))
        elif (r["first_pos"], r["second_pos"]) == (min(one, other), max(one, other)):
            expected[one, other] = (r["first_id"], r["second_id"], *[r[n] for n in names])
    got = {(r["first_pos"], r["second_pos"]): (r["first_id"], r["second_id"], *[r[n] for n in names]) for r in close.collect()}
    assert {tuple(sorted(k)): v for k, v in expected.items()} == got and len(got) > 100
    linked = similar.links(found, close)
    equal = {(r["first_pos"], r["second_pos"]) for r in linked.collect()} - set(got)
    assert equal == {(look[p], p) for p in look if look[p] != p} and equal <= copies
    assert all(similar.links(found, close).filter(F.col("first_pos") == a).filter(F.col("second_pos") == b).first()["tier"] == "VerySimilar" for a, b in list(equal)[:1])
    totals = similar.similarity_totals(found, close, spark.range(3)).first()
    assert totals.asDict() == {"eligible": 250, "candidate_pairs": 250 * 249 // 2, "comparisons": 250 * 249 // 2, "relationships": scored.count(), "groups": 3}


@pytest.mark.parametrize("chunk", [similar.COPIES, 3])
def test_links_of_images_have_every_pair_of_copies(spark, chunk):
    rows = random_prints(random.Random(81), 60, bases=4, noise=9, flat=3)
    rows += [(1000 + n, f"/{'ak'[n % 2]}/{n}", *rows[n % 12][2:]) for n in range(50)]
    placed, found, close = complete(spark, rows, "Broad", 16)
    scored = similar.pair_scores(similar.candidates_all_pairs(placed, 110), placed).filter(images.meets("Broad")).withColumn("tier", images.tier("composite"))
    names = ("first_pos", "second_pos", "first_id", "second_id", "tier")
    plain = lambda df: sorted(map(tuple, df.select(*names).collect()))
    got = plain(similar.links_of_images(found, close, chunk))
    assert got == plain(scored) and len(got) > similar.links(found, close).count()


@pytest.mark.parametrize("limit", [10_000, 5])
def test_groups_of_looks_are_those_of_images(spark, limit):
    rows = random_prints(random.Random(31), 120, bases=4, flat=3)
    rows += [(1000 + n, f"/i/{random.Random(n).random():.12f}", *row[2:]) for n, row in enumerate(rows[:40])]
    placed, found, close = complete(spark, rows, "Strict", 16)
    pairs = similar.pair_scores(similar.candidates_all_pairs(placed, 160), placed).filter(images.meets("Strict"))
    edges = {(r["first_pos"], r["second_pos"]) for r in pairs.collect()}
    expected = models.greedy_groups(160, sorted(edges), lambda a, b: (min(a, b), max(a, b)) in edges)
    prints = found.looks.select("pos", "copies").join(placed.select("pos", "item_id", "path", *images.FINGERPRINT), "pos")
    assert grouping.complete_link_groups(prints, close, "Strict", limit).groups.count() == len(expected)
    groups, members = grouping.look_groups(placed, found, close, "Strict", edge_limit=limit)
    pos = {r["item_id"]: r["pos"] for r in placed.select("item_id", "pos").collect()}
    got = {}
    for row in members.collect():
        got.setdefault(pos[row["group_id"]], []).append(pos[row["item_id"]])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}
    assert {pos[r["group_id"]]: r["photos"] for r in groups.collect()} == {k: len(v) for k, v in expected.items()}


@pytest.mark.parametrize("sensitivity, limit", [("Strict", grouping.PRINT_LIMIT), ("Broad", grouping.PRINT_LIMIT), ("Strict", 2_000)])
def test_groups_from_counts_are_those_from_pairs(spark, sensitivity, limit):
    """No pair is written, in one task for each component and, with the small limit, in rounds; a third of the images share every hash."""
    rows = random_prints(random.Random(51), 160, bases=4, noise=9, flat=3)
    rows += [(1000 + n, f"/i/{random.Random(n).random():.12f}", *row[2:]) for n, row in enumerate(rows[:40])]
    placed, found, close = complete(spark, rows, sensitivity, 32)
    counts = materialize(similar.close_counts(found.looks, sensitivity, 32))
    plain = lambda df: sorted(map(tuple, df.collect()))
    pairs, counted = (grouping.look_groups(placed, found, table, sensitivity, print_limit=limit) for table in (close, counts))
    assert plain(pairs.members) == plain(counted.members) and plain(pairs.groups) == plain(counted.groups) and pairs.groups.count() > 3


def counted(spark):
    rows = random_prints(random.Random(71), 120, bases=4, noise=9, flat=3)
    rows += [(1000 + n, f"/j/{n}", *row[2:]) for n, row in enumerate(rows[:50])]
    placed, found, close = complete(spark, rows, "Balanced", 32)
    return found, close, materialize(similar.close_counts(found.looks, "Balanced", 32))


def test_totals_from_counts(spark):
    found, close, counts = counted(spark)
    totals = [similar.similarity_totals(found, table, spark.range(3)).first() for table in (close, counts)]
    assert totals[0] == totals[1] and totals[0]["relationships"] > close.count() > 100


def test_tiers_from_counts(spark):
    found, close, counts = counted(spark)
    expected = similar.links(found, close).groupBy("tier").agg(F.count(F.lit(1)).alias("pairs"))
    got = sorted(map(tuple, similar.links_by_tier(found, counts).collect()))
    assert got == sorted(map(tuple, expected.collect())) and len(got) > 1


def test_blocks_grow_with_the_looks():
    """What is shuffled, each block once for each of its tiles, grows with the looks and not with their square."""
    sizes = {n: similar.block_size(n) for n in (10, 49_152, 98_304, 491_520, 10**7)}
    assert sizes == {10: 1024, 49_152: 1024, 98_304: 2048, 491_520: 10_240, 10**7: 16_384}


def test_a_print_takes_a_byte_for_a_level(spark):
    placed = similar.with_positions(fingerprints(spark, [("a", scene("bands", 9, 7)), ("b", scene("slope", 9, 7))]))
    assert [len(r["print"]) for r in similar.distinct_looks(placed).looks.collect()] == [6 * 8 + 8 + 2 * 256 + 12 * 2] * 2


def test_a_dense_component_is_settled_without_its_pairs(spark):
    """1,500 images of which most pairs are linked: one row for each look, tier and tile, and the greedy groups."""
    rows = [(*row[:-1], 1.0) for row in random_prints(random.Random(61), 1_500, bases=1, noise=30)]
    placed, found, close = complete(spark, rows, "Broad", 512)
    edges = [(r[0], r[1]) for r in close.select("first_pos", "second_pos").collect()]
    counts = materialize(similar.close_counts(found.looks, "Broad", 512))
    assert len(edges) > 500_000 and counts.count() <= 1_500 * 3 * 3
    linked = set(edges)
    expected = models.greedy_groups(1_500, edges, lambda a, b: (min(a, b), max(a, b)) in linked)
    pos = {r["item_id"]: r["pos"] for r in placed.select("item_id", "pos").collect()}
    got = {}
    for row in grouping.look_groups(placed, found, counts, "Broad").members.collect():
        got.setdefault(pos[row["group_id"]], []).append(pos[row["item_id"]])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


def test_a_long_chain_and_a_dense_component(spark):
    """Known links of 5,000 images in a row, and of 1,200 of which all but every seventh pair are linked."""
    chain = spark.range(4_999).selectExpr("id AS first_pos", "id + 1 AS second_pos")
    dense = spark.range(1_200).selectExpr("10000 + id AS first_pos", "explode(sequence(id + 1, 1200)) AS other").selectExpr("first_pos", "10000 + other AS second_pos")
    dense = dense.filter("(first_pos * 31 + second_pos * 17) % 7 <> 0 AND second_pos < 11200")
    edges = materialize(chain.unionByName(dense).withColumn("composite", F.lit(0.95)))
    prints = spark.range(11_200).filter("id < 5000 OR id >= 10000").selectExpr("id AS pos", "id AS item_id", "concat('/', id) AS path")
    found = grouping.complete_link_groups(prints, edges, "Strict", edge_limit=grouping.EDGE_LIMIT)
    pairs = [(r[0], r[1]) for r in edges.select("first_pos", "second_pos").collect()]
    linked = set(pairs)
    expected = models.greedy_groups(11_200, pairs, lambda a, b: (min(a, b), max(a, b)) in linked)
    got = {}
    for r in found.members.collect():
        got.setdefault(r["group_id"], []).append(r["item_id"])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


@pytest.mark.parametrize("count, reach, run", [(1, 1, 8), (7, 7, 2), (48, 48, 8), (188, 13, 8), (100, 100, 8)])
def test_each_tile_is_in_one_task(spark, count, reach, run):
    """However many blocks there are, a block goes to the groups that it meets, of which there are up to 48, and not to all its tiles."""
    tiles = [(one, other) for one in range(count) for other in range(one, min(count, one + reach))]
    shares = similar._shares(spark.createDataFrame(tiles, "one long, other long"), count, run).collect()
    met, held = [], {}
    for r in sorted(shares, key=lambda r: (r["task"], r["role"], r["block"])):
        if r["role"] == 0:
            held.setdefault(r["task"], set()).add(r["block"])
        assert set(r["partners"]) <= held[r["task"]]
        met += [tuple(sorted((partner, r["block"]))) for partner in r["partners"]]
    assert sorted(met) == tiles
    tasks = {r["task"] for r in shares}
    assert tasks == set(range(len(tasks))) and max(sum(r["task"] == task and r["role"] for r in shares) for task in tasks) <= run
    assert len(shares) <= count * (1 + 48 / run + min(reach, 48, 1 + reach / math.ceil(count / 48)))


def grids(rng, count):
    """Prints of which the centre is the whole, all of one aspect and histogram."""
    rows = random_prints(rng, count, bases=3, noise=30)
    rows = [(*row[:10], [0] * 12, 1.0) for row in rows]
    return rows + [(1000 + n, f"/i/{rng.random():.12f}", *row[2:]) for n, row in enumerate(rows[:30])]


@pytest.mark.parametrize("sensitivity, tile", [("Strict", 3), ("Broad", 64)])
def test_grids_are_compared_by_bounds(spark, sensitivity, tile):
    """Links, counts and groups of prints that share aspect and histogram are those by the columns' scores; small tiles make groups of blocks."""
    placed, found, close = complete(spark, grids(random.Random(81), 160), sensitivity, tile)
    looks = found.looks.select("pos", "copies")
    scored = similar.pair_scores(similar.candidates_all_pairs(placed, 190), placed).filter(images.meets(sensitivity))
    scored = scored.join(looks.select(F.col("pos").alias("first_pos")), "first_pos").join(looks.select(F.col("pos").alias("second_pos")), "second_pos")
    names = ("first_pos", "second_pos", "first_id", "second_id", *similar.SCORES, "composite")
    assert sorted(map(tuple, scored.select(*names).collect())) == sorted(map(tuple, close.select(*names).collect())) and close.count() > 100
    counts = materialize(similar.close_counts(found.looks, sensitivity, tile))
    plain = lambda df: sorted(map(tuple, df.collect()))
    expected = similar.links(found, close).groupBy("tier").agg(F.count(F.lit(1)).alias("pairs"))
    assert plain(similar.links_by_tier(found, counts)) == plain(expected)
    pairs, counted = (grouping.look_groups(placed, found, table, sensitivity) for table in (close, counts))
    assert plain(pairs.members) == plain(counted.members) and plain(pairs.groups) == plain(counted.groups) and pairs.groups.count() >= 3
    slim = similar.close_looks(found.looks, sensitivity, tile, scores=())
    assert slim.columns == ["first_pos", "second_pos", "first_id", "second_id", "composite"]
    assert plain(similar.links(found, slim)) == plain(similar.links(found, close).select(*slim.columns, "tier"))


def test_bounds_are_where_scores_change():
    for sensitivity, limits in images.THRESHOLDS.items():
        bounds = images._bounds(sensitivity, 64)
        for bits, average in ((0, 0), (20, 3), (44, 20), (56, 9), (64, 32), (128, 64)):
            for least, bound in zip((0.0, *sorted(images.TIERS.values())), bounds[:, bits * 65 + average]):
                for apart in {max(0, bound), bound + 1}:
                    scores = {"structure": 1 - apart / 64 / 255.0, "difference": 1 - bits / 128.0, "average": 1 - average / 64.0, "color": 1.0, "aspect": 1.0}
                    scores["composite"] = sum(weight * scores[name] for name, weight in images.WEIGHTS.items())
                    met = all(scores[name] >= limit for name, limit in limits.items()) and scores["composite"] >= least
                    assert met == (apart <= bound)


def test_no_images_and_one_image(spark):
    for count in (0, 1):
        placed, found, close = complete(spark, random_prints(random.Random(2), count), "Broad", 4)
        assert close.isEmpty() and grouping.look_groups(placed, found, close, "Broad").members.isEmpty()
        assert similar.similarity_totals(found, close, spark.range(0)).first()["eligible"] == count


def test_a_hot_look_in_a_third_of_the_images(spark):
    """5,000 images, a third of them blank: their copies are linked once, and every pair of different looks is found."""
    rng = random.Random(41)
    rows = random_prints(rng, 5_000, bases=900, noise=4, flat=1)
    placed, found, close = complete(spark, rows, "Strict", 512)
    blank = [n for n, row in enumerate(sorted(rows, key=lambda r: r[1])) if row[2] == -1]
    assert found.images.filter("pos <> look").count() >= len(blank) - 4  # blank ones differ by aspect
    sample = placed.filter("pos % 50 = 0").select("pos").collect()
    looks = {r["pos"] for r in found.looks.select("pos").collect()}
    got = {(r["first_pos"], r["second_pos"]) for r in close.select("first_pos", "second_pos").collect()}
    queries = [r["pos"] for r in sample if r["pos"] in looks]
    pairs = spark.createDataFrame([(min(q, p), max(q, p)) for q in queries for p in looks if p != q], "first_pos long, second_pos long").distinct()
    hits = {(r[0], r[1]) for r in similar.pair_scores(pairs, placed).filter(images.meets("Strict")).select("first_pos", "second_pos").collect()}
    assert hits == {pair for pair in got if pair[0] in set(queries) or pair[1] in set(queries)} and hits


def test_components(spark):
    chain = [(n, n + 1) for n in range(40)] + [(100, 101), (102, 101), (200, 201)]
    got = grouping.connected_components(spark.createDataFrame(chain, "first_pos long, second_pos long"))
    assert {r["pos"]: r["component"] for r in got.collect()} == {**{n: 0 for n in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 201: 200}


def test_no_relationships(spark):
    placed = similar.with_positions(spark.createDataFrame(random_prints(random.Random(2), 5), PRINTS))
    none = similar.relationships(similar.candidates(placed).limit(0), placed)
    found = grouping.complete_link_groups(placed, none)
    assert found.groups.isEmpty() and found.members.isEmpty()


def test_eligible_images_and_skips(inventory, spark):
    rows = [{"path": "/i/a.JPG"}, {"path": "/i/b.txt"}, {"path": "/i/c.png", "identity": (1, 1, 0)}, {"path": "/i/d.heic"}, {"path": "/i/e.bmp"}]
    inv = inventory(rows)
    eligible = similar.eligible_images(inv)
    assert sorted(r["path"] for r in eligible.images.collect()) == ["/i/a.JPG", "/i/d.heic", "/i/e.bmp"]
    decoded = spark.createDataFrame([("/i/a.JPG",)], "path string")
    broken = spark.createDataFrame([("/i/d.heic", "CorruptImage")], "path string, reason string")
    later = inv.withColumn("length", F.col("length") + F.when(F.col("path") == "/i/a.JPG", 1).otherwise(0))
    reasons = {r["path"]: r["reason"] for r in similar.image_skips(eligible, decoded, broken, later).collect()}
    assert reasons == {"/i/b.txt": "UnsupportedFormat", "/i/d.heic": "CorruptImage", "/i/e.bmp": "Inaccessible", "/i/a.JPG": "ChangedDuringAnalysis"}


def test_review_of_groups(spark):
    groups = spark.createDataFrame([(1, "/a/one.png", "Similar"), (2, "/b/two.png", "VerySimilar"), (3, "/a/alpha.png", "Similar")], "group_id long, first_path string, tier string")
    members = spark.createDataFrame(
        [(1, "one.png", "/a/one.png", 5, 1), (1, "x.png", "/q/x.png", 5, 9), (2, "two.png", "/b/two.png", 50, 2), (2, "t.png", "/b/t.png", 50, 3), (3, "alpha.png", "/a/alpha.png", 1, 1), (3, "o.png", "/a/o.png", 1, 1), (3, "p.png", "/a/p.png", 1, 1)],
        "group_id long, file_name string, path string, length long, at long",
    ).withColumn("modified_at", F.timestamp_seconds("at"))
    totals = similar.similar_group_totals(groups, members)
    order = lambda by, down: [r["group_id"] for r in similar.sort_similar_groups(totals, by, down).collect()]
    assert order("tier", True) == [2, 3, 1] and order("tier", False) == [3, 1, 2]
    assert order("photo_count", True)[0] == 3 and order("activity", True) == [1, 2, 3] and order("total_size", False) == [3, 1, 2]
    kept = lambda **o: sorted(r["group_id"] for r in similar.filter_similar_groups(groups, members, **o).collect())
    assert kept(search="/Q/") == [1] and kept(tier="Similar") == [1, 3] and kept(tier="Similar", search="two") == [] and kept() == [1, 2, 3]


def test_marks(spark):
    members = spark.createDataFrame([(1, n, 10, "None") for n in range(3)] + [(2, n, 5, "None") for n in (7, 8)], "group_id long, item_id long, length long, mark string")
    requests = members.select("item_id", F.col("item_id").alias("request_no"))
    marked = similar.mark(members, requests, "ConsiderRemoving")
    assert {(r["item_id"], r["mark"]) for r in marked.collect()} == {(0, "ConsiderRemoving"), (1, "ConsiderRemoving"), (2, "None"), (7, "ConsiderRemoving"), (8, "None")}
    assert tuple(similar.marked_totals(marked).first()) == (3, 25)
    kept = similar.mark(marked, requests.filter("item_id in (0, 2)"), "Keep")
    assert {r["item_id"] for r in kept.filter("mark = 'Keep'").collect()} == {0, 2} and similar.marked_totals(kept).first()[0] == 2
    with pytest.raises(ValueError):
        similar.mark(members, requests, "Perhaps")

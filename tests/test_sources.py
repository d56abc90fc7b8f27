import hashlib
import os
import random
import struct

import numpy as np
import pytest
from duploscope import session
from duploscope.functions import images, ranking, reduction
from duploscope.operators import eligibility, exact, similar
from duploscope.session import materialize
from duploscope.sources import files, inventory
from pyspark.sql import functions as F


def bitmap(width, height, color):
    """An uncompressed 24-bit BMP file."""
    line = bytes(color) * width
    line += b"\0" * (-len(line) % 4)
    pixels = line * height
    return b"BM" + struct.pack("<IHHI", 54 + len(pixels), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, len(pixels), 0, 0, 0, 0) + pixels


def test_files_and_content(spark, tmp_path):
    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / ".hidden").mkdir()
    for name, text in (
        ("a/one.txt", "same"), ("a/deep/two.txt", "same"), ("a/three.txt", "diff"), ("four.bin", "other size"), (".hidden/_five", "same"), ("a/.six", "x"),
    ):
        (tmp_path / name).write_text(text)
    inv = files.read_files(spark, [str(tmp_path)])
    rows = {r["file_name"]: r for r in inv.collect()}
    assert set(rows) == {"one.txt", "two.txt", "three.txt", "four.bin", "_five", ".six"}
    assert rows["two.txt"]["path"] == f"{tmp_path}/a/deep/two.txt" and rows["two.txt"]["root"] == str(tmp_path) and rows["two.txt"]["length"] == 4
    assert rows["four.bin"]["digest"] == hashlib.sha256(b"other size").hexdigest()
    listing = files.read_files(spark, [str(tmp_path)], with_digest=False)
    assert listing.filter("digest is not null").isEmpty()
    found = exact.find_exact_duplicates(listing, files.read_file_content, files.hash_files)
    assert sorted(r["file_name"] for r in found.members.collect()) == ["_five", "one.txt", "two.txt"] and found.skipped.isEmpty()
    flat = files.read_files(spark, [str(tmp_path / "a")], recursive=False)
    assert sorted(r["file_name"] for r in flat.collect()) == [".six", "one.txt", "three.txt"]


def test_only_files_of_repeated_lengths_are_opened(spark, tmp_path):
    for n in range(5):
        (tmp_path / f"unique-{n}").write_text("u" * (10 + n))
    (tmp_path / "pair-1").write_text("pair"), (tmp_path / "pair-2").write_text("pair"), (tmp_path / "lost").write_text("gone")
    listing = materialize(files.read_files(spark, [str(tmp_path)], with_digest=False))
    asked = []

    def read(wanted):
        asked.extend(r["path"] for r in wanted.collect())
        return files.hash_files(wanted)

    for n in range(5):
        (tmp_path / f"unique-{n}").unlink()  # nobody misses them
    (tmp_path / "lost").unlink()
    (tmp_path / "pair-2").write_text("longer now")
    found = exact.find_exact_duplicates(listing, files.read_file_content, read)
    assert sorted(p.rsplit("/", 1)[1] for p in asked) == ["lost", "pair-1", "pair-2"]
    assert found.groups.isEmpty()
    assert {(r["path"].rsplit("/", 1)[1], r["reason"]) for r in found.skipped.collect()} == {("lost", "Unavailable"), ("pair-2", "ChangedDuringAnalysis")}


def test_content_in_pieces_and_unlistable_folders(spark, tmp_path, monkeypatch):
    size = 2 * files.PIECE + 7
    for name, last in (("a", b"1"), ("b", b"1"), ("c", b"2")):
        (tmp_path / name).write_bytes(b"x" * (size - 1) + last)
    listing = files.read_files(spark, [str(tmp_path)], with_digest=False)
    found = exact.find_exact_duplicates(listing, files.read_file_content, files.hash_files)
    assert sorted(r["file_name"] for r in found.members.collect()) == ["a", "b"]
    same = exact.find_exact_duplicates(listing, files.read_file_content, lambda w: w.select("item_id", "path", F.lit("one").alias("digest")))
    assert sorted(r["file_name"] for r in same.members.collect()) == ["a", "b"]  # equal digests are no proof
    failed = files.list_files(spark, [str(tmp_path / "none")]).collect()
    assert [(r["path"], r["failure"]) for r in failed] == [(str(tmp_path / "none"), "Inaccessible")]
    monkeypatch.setattr(files, "ENTRIES", 1)  # seen where tasks run in forks of this process only; the result is the same
    assert files.list_files(spark, [str(tmp_path)]).count() == 3


def test_links_are_not_followed(spark, tmp_path):
    """A folder loop, a link to a file, a hard link, a link to nothing, a pipe and a folder that cannot be listed."""
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "file").write_text("only copy")
    os.symlink(tmp_path, tmp_path / "d" / "loop")
    os.symlink(tmp_path / "d" / "file", tmp_path / "link")
    os.symlink(tmp_path / "nowhere", tmp_path / "dangling")
    os.link(tmp_path / "d" / "file", tmp_path / "hard")
    os.mkfifo(tmp_path / "pipe")
    rows = {r["path"].removeprefix(f"{tmp_path}/"): r for r in files.read_files(spark, [str(tmp_path)]).collect()}
    assert set(rows) == {"d/file", "d/loop", "link", "dangling", "hard", "pipe"}
    assert [rows[n]["attributes"] for n in ("d/loop", "link", "dangling", "pipe")] == [["ReparsePoint"]] * 3 + [["IdentityUnavailable"]]
    assert rows["d/loop"]["is_dir"] and not rows["link"]["is_dir"] and rows["pipe"]["identity"] is None
    assert rows["d/file"]["identity"] == rows["hard"]["identity"] and rows["hard"]["link_count"] == 2
    listing = files.read_files(spark, [str(tmp_path)], with_digest=False)
    for content, digests in ((files.PROOF, files.hash_files), (files.read_file_content, files.hash_files)):
        found = exact.find_exact_duplicates(listing, content, digests)
        assert found.groups.isEmpty() and found.skipped.isEmpty() and found.items.count() == 1
    split = eligibility.split_eligible(listing, eligibility.Policy())
    assert sorted(r["path"] for r in split.accepted.collect()) == [f"{tmp_path}/d/file", f"{tmp_path}/hard"]
    reasons = sorted((r["path"].rsplit("/", 1)[1], r["reason"]) for r in split.skipped.collect())
    assert reasons == [("dangling", "ReparsePoint"), ("link", "ReparsePoint"), ("loop", "ReparsePoint"), ("pipe", "IdentityUnavailable")]
    nested = files.read_files(spark, [str(tmp_path), str(tmp_path / "d")], with_digest=False)
    assert nested.count() == len(rows)  # a path that two roots reach is one row
    through = files.read_files(spark, [str(tmp_path / "d" / "loop")]).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["attributes"]) for r in through] == [("loop", ["ReparsePoint"])]


def test_folders_that_cannot_be_listed_are_rows(spark, tmp_path):
    rows = files.read_files(spark, [str(tmp_path / "none")]).collect()
    assert [(r["is_dir"], r["attributes"]) for r in rows] == [(True, ["Inaccessible"])]
    split = eligibility.split_eligible(files.read_files(spark, [str(tmp_path / "none")]), eligibility.Policy())
    assert split.accepted.isEmpty() and [tuple(r) for r in split.skipped.collect()] == [(str(tmp_path / "none"), "Inaccessible")]


def test_hidden_names(spark, tmp_path):
    (tmp_path / ".x").write_text("1"), (tmp_path / "y").write_text("2")
    listing = files.read_files(spark, [str(tmp_path)])
    assert {r["file_name"]: r["attributes"] for r in listing.collect()} == {".x": ["Hidden"], "y": ["Normal"]}
    assert eligibility.split_eligible(listing, eligibility.Policy(include_hidden=True)).accepted.count() == 2


def proved(listing, during=lambda: None, digests=files.hash_files):
    """Duplicates of a listing, with something that happens between the digests and the proof."""

    def read(wanted):
        result = materialize(digests(wanted))
        during()
        return result

    found = exact.find_exact_duplicates(listing, files.PROOF, read)
    name = lambda path: path.rsplit("/", 1)[1]
    sets = {}
    for r in found.members.collect():
        sets.setdefault(r["group_id"], []).append(name(r["path"]))
    assert len(sets) == found.groups.count()
    return sorted(map(sorted, sets.values())), sorted((name(r["path"]), r["reason"]) for r in found.skipped.collect())


@pytest.mark.parametrize("change, reason", [
    (lambda p: p.unlink(), "Unavailable"), (lambda p: p.write_bytes(b"longer than it was"), "ChangedDuringAnalysis"),
    (lambda p: p.write_bytes(b"SAME"), "ChangedDuringAnalysis"), (lambda p: os.replace(p.parent / "other", p), "ChangedDuringAnalysis"),
])
def test_a_file_that_goes_or_changes_before_the_proof_isolates_its_set(spark, tmp_path, change, reason):
    for name in "abcde":
        (tmp_path / name).write_text("same")
    for name in ("x1", "x2"):
        (tmp_path / name).write_text("else")
    (tmp_path / "other").write_text("spare file")
    listing = materialize(files.read_files(spark, [str(tmp_path)], with_digest=False))
    sets, skipped = proved(listing, lambda: change(tmp_path / "c"))
    assert sets == [["d", "e"], ["x1", "x2"]] and skipped == [(n, reason) for n in "abc"]


def test_a_first_that_cannot_be_read_takes_the_next_with_it(spark, tmp_path):
    for name in "abcd":
        (tmp_path / name).write_text("same")
    listing = materialize(files.read_files(spark, [str(tmp_path)], with_digest=False))
    assert proved(listing, (tmp_path / "a").unlink) == ([["c", "d"]], [("a", "Unavailable"), ("b", "Unavailable")])
    listing = materialize(files.read_files(spark, [str(tmp_path)], with_digest=False))
    assert proved(listing, lambda: [(tmp_path / n).unlink() for n in "bcd"]) == ([], [(n, "Unavailable") for n in "bcd"])


def test_equal_digests_of_different_files(spark, tmp_path):
    for name, text in zip("abcdefg", ("11", "22", "11", "33", "22", "11", "44")):
        (tmp_path / name).write_text(text)
    one = lambda wanted: files.hash_files(wanted).withColumn("digest", F.lit("one"))
    listing = materialize(files.read_files(spark, [str(tmp_path)], with_digest=False))
    assert proved(listing, digests=one) == ([["a", "c", "f"], ["b", "e"]], [])


def test_a_file_that_changes_after_the_proof(spark, tmp_path):
    for name in "abxy":
        (tmp_path / name).write_text("ab" if name in "ab" else "xy")
    listing = materialize(files.read_files(spark, [str(tmp_path)], with_digest=False))

    def compare(pairs):
        result = materialize(files.compare_files(pairs))
        (tmp_path / "b").write_text("abc")
        return result

    found = exact.find_exact_duplicates(listing, exact.Proof(compare, files.validate_files), files.hash_files)
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found.members.collect()) == ["x", "y"] and found.groups.count() == 1
    assert sorted((r["path"].rsplit("/", 1)[1], r["reason"]) for r in found.skipped.collect()) == [(n, "ChangedDuringAnalysis") for n in "ab"]


def test_no_content_is_shuffled(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_text("same")
    listing = files.read_files(spark, [str(tmp_path)])
    pairs = listing.withColumn("first", F.struct(*listing.columns))
    plan = files.compare_files(pairs)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "binary" not in plan


def sequence(reads):
    """Sets and skipped rows of one bucket, row after row, where rows that cannot be read fail in every comparison."""
    sets, skipped, current = [], set(), []
    for position, failing in enumerate(reads):
        if current and (failing or reads[current[0]]):
            skipped |= {*current, position}
            current = []
        else:
            current.append(position)
            if len(current) == 1:
                sets.append(current)
    skipped |= {s[0] for s in sets if len(s) == 1 and reads[s[0]]}
    return [s for s in sets if len(s) > 1 and not skipped & set(s)], skipped


def test_unreadable_rows_against_a_plain_model(spark):
    rng = random.Random(9)
    cases = [[rng.random() < 0.4 for _ in range(rng.randint(2, 12))] for _ in range(150)]
    rows = [
        (case * 100 + p, f"/{case:03}/{p:02}", case, "Unavailable" if bad else None, False, False)
        for case, reads in enumerate(cases) for p, bad in enumerate(reads)
    ]
    members = spark.createDataFrame(rows, "item_id long, path string, group_id long, read_failure string, compare_failed boolean, validate_failed boolean")
    isolated = exact.isolate_failures(members)
    got = {}
    for r in isolated.members.collect():
        got.setdefault((r["group_id"], r["set_no"]), []).append(r["item_id"] % 100)
    expected = sorted((case, s) for case, reads in enumerate(cases) for s in sequence(reads)[0])
    assert sorted((case, sorted(s)) for (case, _), s in got.items()) == expected
    assert {r["item_id"] for r in isolated.skipped.collect()} == {case * 100 + p for case, reads in enumerate(cases) for p in sequence(reads)[1]}
    assert {r["reason"] for r in isolated.skipped.collect()} <= {"Unavailable", "ComparisonFailed"}


def test_tables_go_with_their_run(spark):
    with session.run_scope(spark):
        table = session.materialize(spark.range(5))
        path = table.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
        assert os.path.isdir(path) and table.count() == 5
    assert not os.path.exists(path)


def test_images(spark, tmp_path):
    (tmp_path / "red.bmp").write_bytes(bitmap(20, 10, (0, 0, 200)))
    (tmp_path / "broken.png").write_bytes(b"no image")
    (tmp_path / "new.heic").write_bytes(b"no codec")
    read = files.read_images(spark, [str(tmp_path)])
    skipped = sorted((r["path"], r["reason"]) for r in read.skipped.collect())
    assert skipped == [(f"{tmp_path}/broken.png", "CorruptImage"), (f"{tmp_path}/new.heic", "CodecUnavailable")]
    row = images.fingerprint(read.images).first()
    assert (row["width"], row["height"], row["aspect"]) == (20, 10, 2.0)
    assert row["histogram"] == [0, 0, 0, 256, 256, 0, 0, 0, 256, 0, 0, 0] and set(row["luminance"]) == {128}


def test_images_are_reduced_by_area_averages(spark, tmp_path):
    rng = random.Random(3)
    width, height = 130, 100
    pixels = [[bytes(rng.randrange(256) for _ in range(3)) for _ in range(width)] for _ in range(height)]
    df = spark.createDataFrame(
        [(1, width, height, 3, b"".join(b"".join(row) for row in pixels)), (2, 64, 2, 1, bytes(range(128))), (3, 1, 500, 1, bytes(500))],
        "item_id long, width int, height int, channels int, pixels binary",
    )
    rows = {r["item_id"]: r for r in reduction.reduce_images(df).collect()}
    assert (rows[1]["width"], rows[1]["height"]) == (64, 49) and len(rows[1]["pixels"]) == 64 * 49 * 3
    assert bytes(rows[2]["pixels"]) == bytes(range(128)) and (rows[3]["width"], rows[3]["height"]) == (1, 64)
    for y, x, channel in ((0, 0, 0), (48, 63, 2), (20, 31, 1), (7, 50, 0)):
        total = area = 0.0
        for r in range(height):
            for k in range(width):
                down = min((y + 1) * height / 49, r + 1) - max(y * height / 49, r)
                along = min((x + 1) * width / 64, k + 1) - max(x * width / 64, k)
                if down > 0 and along > 0:
                    total += down * along * pixels[r][k][channel]
                    area += down * along
        assert abs(rows[1]["pixels"][(y * 64 + x) * 3 + channel] - total / area) <= 0.5 + 1e-6
    (tmp_path / "large.bmp").write_bytes(bitmap(200, 100, (9, 8, 7)))
    read = files.read_images(spark, [str(tmp_path)]).images.first()
    assert (read["width"], read["height"], bytes(read["pixels"][:3])) == (64, 32, bytes((9, 8, 7)))
    assert files.read_images(spark, [str(tmp_path)], side=None).images.first()["width"] == 200


def test_orientation_tags():
    pixels = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    seen = {1: pixels, 2: np.fliplr(pixels), 3: np.rot90(pixels, 2), 4: np.flipud(pixels), 5: np.fliplr(np.rot90(pixels, -1)),
            6: np.rot90(pixels, -1), 7: np.fliplr(np.rot90(pixels, 1)), 8: np.rot90(pixels, 1)}
    for tag, wanted in seen.items():
        assert np.array_equal(reduction.turned(pixels, tag), wanted)
        for order in ("little", "big"):
            assert reduction.orientation(b"\xff\xd8" + b"\xff\xe0\0\x04ab" + exif(tag, order) + b"\xff\xda\0\x02") == tag
    good = b"\xff\xd8" + exif(6, "big")
    for broken in (b"", b"\x89PNG", good[:20], b"\xff\xd8\xff\xda" + good[2:], good.replace(b"MM", b"XX"), b"\xff\xd8" + exif(9, "big"), b"\xff\xd8\xff\xe1\0\0" + good):
        assert reduction.orientation(broken) == 1


def exif(tag, order):
    number = lambda value, size: value.to_bytes(size, order)
    entries = number(2, 2) + number(256, 2) + number(4, 2) + number(1, 4) + number(9, 4) + number(274, 2) + number(3, 2) + number(1, 4) + number(tag, 2) + b"\0\0"
    block = b"Exif\0\0" + {"little": b"II", "big": b"MM"}[order] + number(42, 2) + number(8, 4) + entries + number(0, 4)
    return b"\xff\xe1" + (len(block) + 2).to_bytes(2, "big") + block


def test_a_turned_photo_meets_its_original(spark, tmp_path):
    """A JPEG file stored on its side, with the tag that says so, beside the upright one."""
    width, height = 32, 24
    jvm = spark._jvm

    def write(name, w, h, color):
        image = jvm.java.awt.image.BufferedImage(w, h, 1)
        for y in range(h):
            for x in range(w):
                image.setRGB(x, y, color(x, y))
        jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(tmp_path / name)))

    scene = lambda x, y: (7 * x << 16) + (9 * y << 8) + (200 if x > 20 and y < 9 else 20)
    write("up.jpg", width, height, scene)
    write("side.jpg", height, width, lambda x, y: scene(y, height - 1 - x))  # turned clockwise by a quarter: tag 8 turns it back
    side = (tmp_path / "side.jpg").read_bytes()
    (tmp_path / "side.jpg").write_bytes(side[:2] + exif(8, "little") + side[2:])
    placed = similar.with_positions(images.fingerprint(files.read_images(spark, [str(tmp_path)]).images))
    assert [(r["width"], r["height"]) for r in placed.orderBy("pos").collect()] == [(width, height)] * 2
    found = similar.distinct_looks(placed)
    assert similar.close_looks(found.looks, "Strict").count() + found.images.filter("pos <> look").count() == 1


def test_tables_as_inventories(spark):
    df = spark.createDataFrame([(7, "/d/x.TXT", "abc")], "id long, name string, body string")
    row = inventory.read_inventory(df, {"item_id": "id", "path": "name", "content": "body", "lang": F.lit("en")}).first()
    assert (row["item_id"], row["file_name"], row["extension"], row["length"], row["root"], row["lang"]) == (7, "x.TXT", ".TXT", 3, "/", "en")
    assert row["digest"] == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert row["identity"].asDict() == {"volume": 1, "id_low": 7, "id_high": 0} and row["attributes"] == ["Normal"]


def test_ranks_and_running_counts(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k", "id % 3 as g").repartition(7)
    ranked = ranking.global_rank(df, [F.col("k")], "rank")
    assert ranked.filter("rank <> k").isEmpty() and ranked.count() == 1000
    counted = ranking.running_count(ranking.with_blocks(df, [F.col("k")]), ["g"], [F.col("k")], F.col("k") % 2 == 0, "n")
    seen, expected = {}, {}
    for row in sorted(df.collect(), key=lambda r: r["k"]):
        seen[row["g"]] = seen.get(row["g"], 0) + (row["k"] % 2 == 0)
        expected[row["k"]] = seen[row["g"]]
    assert {r["k"]: r["n"] for r in counted.collect()} == expected


def test_a_rank_shuffles_its_rows_once(spark):
    """What is read back is the written table, with a small table of offsets beside it: no window and no further shuffle of the rows."""
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k", "if(id % 3 = 0, null, id % 50) as g").repartition(7)
    ranked = ranking.global_rank(df, [F.col("g").desc(), F.col("k")], "rank")
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "_offset" in plan
    expected = sorted(df.collect(), key=lambda r: (r["g"] is None, -(r["g"] or 0), r["k"]))
    assert [(r["g"], r["k"]) for r in ranked.orderBy("rank").collect()] == [(r["g"], r["k"]) for r in expected]
    assert ranked.columns == ["k", "g", "rank"]


class StubSession:
    """A session of a given master and settings, as far as `shared_dir` looks."""

    def __init__(self, master, configured=None, checkpoint_dir=None):
        self.conf = type("Conf", (), {"get": lambda _, key, default=None: configured if key == "spark.checkpoint.dir" else default})()
        self.sparkContext = type("Context", (), {"master": master, "getCheckpointDir": lambda _: checkpoint_dir})()


def test_shared_folder():
    assert session.shared_dir(StubSession("yarn", "hdfs:///shared")) == "hdfs:///shared"
    assert session.shared_dir(StubSession("yarn", None, "hdfs:///set-by-code")) == "hdfs:///set-by-code"
    for master in ("spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(StubSession(master))
    assert session.shared_dir(StubSession("local[2]")) == session.shared_dir(StubSession("local[4]"))

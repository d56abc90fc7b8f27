"""Files and images under folders of any store that Arrow's file systems open.

Folders are listed by tasks, also names that begin with a dot or an underscore; what is too much for one goes to more. Links are never
followed: they are rows of their own, as are folders that cannot be listed. Local files have the identity that the file system gives them,
so that hard links are one file. Content is read by path, in pieces of bounded size, so that a file of any size can be hashed and one that
cannot be read is one row with its reason.
"""

from __future__ import annotations

import hashlib
import os
import stat
from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duploscope.functions import paths, reduction
from duploscope.operators import exact
from duploscope.operators.eligibility import plain_file
from duploscope.session import materialize
from duploscope.sources.inventory import INVENTORY, identity_of, read_inventory

PIECE = 4 << 20  # bytes that are read at once
TASK_BYTES = 64 << 20  # of content for one task

ENTRIES = 10_000  # that one task lists below a folder before it leaves the rest to others

# a row is a file, a link, an entry that is neither file nor folder, or a folder that could not be looked into
_ENTRY = pa.schema(
    [
        ("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("changed", pa.timestamp("us", "UTC")),
        ("volume", pa.int64()), ("file_no", pa.int64()), ("links", pa.int32()), ("is_dir", pa.bool_()), ("failure", pa.string()),
        ("open", pa.bool_()),
    ]
)
_LISTED = (
    "path string, length long, modified timestamp, changed timestamp, volume long, file_no long, links int, is_dir boolean, failure string, "
    "open boolean"
)
LINK, UNLISTED, VANISHED, NO_FILE = "ReparsePoint", "Inaccessible", "UnstableOrDisappeared", "IdentityUnavailable"


def _opened(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, the path in it, and what stands before that path."""
    system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system, inside, path[: len(path) - len(inside)] if path.endswith(inside) else ""


def _signed(number: int) -> int:
    return (number & ((1 << 64) - 1)) - ((number & (1 << 63)) << 1)


def _local(folder: str) -> Iterator[dict]:
    """Entries of a local folder as they are, links not followed."""
    with os.scandir(folder) as entries:
        for entry in entries:
            try:
                found = entry.stat(follow_symlinks=False)
            except FileNotFoundError:
                yield {"path": entry.path, "is_dir": False, "failure": VANISHED}
                continue
            except OSError:
                yield {"path": entry.path, "is_dir": False, "failure": UNLISTED}
                continue
            row = {
                "path": entry.path, "length": found.st_size, "modified": found.st_mtime_ns // 1000, "changed": found.st_ctime_ns // 1000,
                "volume": _signed(found.st_dev), "file_no": _signed(found.st_ino), "links": found.st_nlink, "is_dir": False,
            }
            if stat.S_ISLNK(found.st_mode):
                yield {**row, "is_dir": os.path.isdir(entry.path), "failure": LINK}
            elif stat.S_ISDIR(found.st_mode):
                yield {**row, "is_dir": True}
            else:
                yield row if stat.S_ISREG(found.st_mode) else {**row, "failure": NO_FILE}


def _remote(folder: str) -> Iterator[dict]:
    """Entries of a folder of a store, which has no links and no identities but paths."""
    system, inside, before = _opened(folder)
    for info in system.get_file_info(fs.FileSelector(inside)):
        modified = None if info.mtime_ns is None else info.mtime_ns // 1000
        is_dir = info.type == fs.FileType.Directory
        yield {"path": before + info.path, "length": info.size, "modified": modified, "changed": modified, "links": 1, "is_dir": is_dir}


def _listed(batches: Iterator[pa.RecordBatch], recursive: bool) -> Iterator[pa.RecordBatch]:
    """What is in the folders and, up to ENTRIES of them, in the folders below; a folder that was not looked into stays open."""
    for batch in batches:
        for root in batch.column("path").to_pylist():
            rows: list[dict] = []
            waiting = [root]
            while waiting and len(rows) < ENTRIES:
                folder = waiting.pop()
                try:
                    if "://" not in folder and os.path.islink(folder):
                        rows.append({"path": folder, "is_dir": True, "failure": LINK})
                        continue
                    for row in (_remote if "://" in folder else _local)(folder):
                        if not row["is_dir"] or "failure" in row:
                            rows.append(row)
                        elif recursive:
                            waiting.append(row["path"])
                except FileNotFoundError:
                    rows.append({"path": folder, "is_dir": True, "failure": UNLISTED if folder == root else VANISHED})
                except OSError:
                    rows.append({"path": folder, "is_dir": True, "failure": UNLISTED})
            rows = [{**row, "open": False} for row in rows] + [{"path": folder, "open": True} for folder in waiting]
            yield pa.RecordBatch.from_pylist(rows, schema=_ENTRY)


def list_files(spark: SparkSession, roots: Sequence[str], recursive: bool = True) -> DataFrame:
    """(path, length, modified, changed, volume, file_no, links, is_dir, failure) of every file below the roots, and of what is none.

    `failure` is null for files, `ReparsePoint` for links, to folders too, which are not followed, `Inaccessible` for folders that cannot be
    listed, `IdentityUnavailable` for pipes, sockets and devices, and `UnstableOrDisappeared` for what went away meanwhile. A path that
    several roots reach is one row. Volume and number of a file are those of the file system, null where it has none.
    """
    waiting = spark.createDataFrame([(root.removeprefix("file:").rstrip("/") or "/",) for root in roots], "path string")
    tasks, parts = len(roots), []
    while tasks:
        found = waiting.repartition(min(1_000, tasks)).mapInArrow(lambda batches: _listed(batches, recursive), _LISTED)
        found = materialize(found)
        parts.append(found.filter("NOT open").drop("open"))
        waiting = found.filter("open").select("path")
        tasks = waiting.count()
    listed = reduce(DataFrame.unionByName, parts)
    return listed if len(roots) == 1 else listed.dropDuplicates(["path"])


def read_files(spark: SparkSession, roots: Sequence[str], recursive: bool = True, with_digest: bool = True) -> DataFrame:
    """The inventory of the files below the roots, and of the entries that are none.

    Without `with_digest` only names, lengths and times are listed and no file is opened: what `find_exact_duplicates` needs
    beside `hash_files`. The identity is that of the file system, so that hard links are one item; where it gives none, it is taken from
    the path. Names that begin with a dot are `Hidden`. What `list_files` gives a failure has it as its attribute: `split_eligible` rejects
    it for that reason, and `find_exact_duplicates` never opens it.
    """
    listed = list_files(spark, roots, recursive)
    named = F.xxhash64("path")
    known = F.col("file_no").isNotNull()
    hidden = F.when(paths.file_name("path").startswith("."), F.lit("Hidden")).otherwise(F.lit("Normal"))
    identity = identity_of(F.when(known, F.col("file_no")).otherwise(named), F.when(known, 0).otherwise(F.xxhash64(F.lit("identity"), "path")),
                           F.coalesce("volume", F.lit(1)))
    mapping = {
        "item_id": named,
        "path": F.col("path"),
        "root": paths.resolve_location("path", roots),
        "length": F.col("length"),
        "modified_at": F.col("modified"),
        "changed_at": F.col("changed"),
        "identity": F.when(F.col("failure").isNull() | (F.col("failure") == LINK), identity),
        "link_count": F.coalesce("links", F.lit(1)),
        "is_dir": F.col("is_dir"),
        "attributes": F.array(F.coalesce("failure", hidden)),
    }
    inventory = read_inventory(listed, mapping)
    if not with_digest:
        return inventory
    read = hash_files(inventory.filter(plain_file())).select("item_id", "path", "digest")
    return inventory.drop("digest").join(read, ["item_id", "path"], "left").select(*inventory.columns)


def _spread(rows: DataFrame) -> DataFrame:
    """The rows over as many tasks as their bytes ask for; written, as they are summed up first."""
    rows = materialize(rows)
    total, count = rows.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    tasks = max(total // TASK_BYTES + 1, min(count, rows.sparkSession.sparkContext.defaultParallelism))
    return rows.repartition(max(1, int(tasks)))


def _pieces(path: str, length: int | None) -> Iterator[bytes]:
    """The file's bytes; OSError if it cannot be read, ValueError if it is not as long as it was."""
    system, inside, _ = _opened(path)
    seen = 0
    with system.open_input_stream(inside) as stream:
        while piece := stream.read(PIECE):
            seen += len(piece)
            yield piece
    if length is not None and seen != length:
        raise ValueError(f"{seen} bytes instead of {length}")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests: list[str | None] = []
        failures: list[str | None] = []
        for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
            digest, failure = hashlib.sha256(), None
            try:
                for piece in _pieces(path, length):
                    digest.update(piece)
            except FileNotFoundError:
                failure = "Unavailable"
            except OSError:
                failure = "ReadFailed"
            except ValueError:
                failure = "ChangedDuringAnalysis"
            digests.append(None if failure else digest.hexdigest())
            failures.append(failure)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("item_id", "path")), pa.array(digests, pa.string()), pa.array(failures, pa.string())],
            names=["item_id", "path", "digest", "failure"],
        )


def hash_files(rows: DataFrame) -> DataFrame:
    """(item_id, path, digest, failure) of files (item_id, path, length)."""
    return _spread(rows.select("item_id", "path", "length")).mapInArrow(
        _hashed, "item_id long, path string, digest string, failure string"
    )


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            try:
                for number, piece in enumerate(_pieces(row["path"], None)):
                    yield pa.RecordBatch.from_pylist([{**row, "chunk": number, "content": piece}], schema=_CONTENT)
            except OSError:  # gone since it was hashed: what is not there proves nothing against the rest
                continue


_CONTENT = pa.schema(
    [("item_id", pa.int64()), ("path", pa.string()), ("length", pa.int64()), ("digest", pa.string()), ("chunk", pa.int32()), ("content", pa.binary())]
)


def read_file_content(rows: DataFrame) -> DataFrame:
    """(item_id, length, digest, chunk, content) of files, to prove equality with; see `exact.verify_content`."""
    return _spread(rows.select("item_id", "path", "length", "digest")).mapInArrow(
        _contents, "item_id long, path string, length long, digest string, chunk int, content binary"
    ).drop("path")


class _Changed(Exception):
    """A file is not the one that was listed."""


class _Watched:
    """A file that is open for reading and is to stay as it was listed."""

    def __init__(self, seen: dict) -> None:
        self.seen = seen
        self.system, self.inside, _ = _opened(seen["path"])
        self.local = isinstance(self.system, fs.LocalFileSystem)
        self.stream = open(self.inside, "rb", buffering=0) if self.local else self.system.open_input_stream(self.inside)  # noqa: SIM115

    def check(self) -> None:
        seen = self.seen
        if self.local:
            now = os.fstat(self.stream.fileno())
            state = [now.st_size, now.st_mtime_ns // 1000, now.st_ctime_ns // 1000, _signed(now.st_dev), _signed(now.st_ino)]
        else:
            info = self.system.get_file_info(self.inside)
            state = [info.size, None if info.mtime_ns is None else info.mtime_ns // 1000, seen["changed"], seen["volume"], seen["file_no"]]
        if state != [seen[name] for name in ("length", "modified", "changed", "volume", "file_no")]:
            raise _Changed

    def close(self) -> None:
        self.stream.close()


def _watched(seen: dict) -> tuple[_Watched | None, str | None]:
    """The file, checked against what was listed, or why there is none."""
    file = None
    try:
        file = _Watched(seen)
        file.check()
        return file, None
    except _Changed:
        failure = "ChangedDuringAnalysis"
    except (FileNotFoundError, PermissionError):
        failure = "Unavailable"
    except OSError:
        failure = "ComparisonFailed"
    if file is not None:
        file.close()
    return None, failure


def _failing(file: _Watched, step) -> str | None:
    try:
        step()
    except _Changed:
        return "ChangedDuringAnalysis"
    except OSError:
        return "ComparisonFailed"
    return None


def _compare(first: _Watched, own: _Watched) -> tuple[str, str | None, str | None]:
    """(state, failure of the own file, failure of the first): piece by piece, both files looked at again afterwards."""
    taken: dict[str, bytes] = {}

    def take(name: str, file: _Watched) -> None:
        taken[name] = file.stream.read(PIECE)

    equal = True
    while equal:
        failures = [_failing(file, lambda name=name, file=file: take(name, file)) for name, file in (("own", own), ("first", first))]
        if any(failures):
            return "failed" if failures[0] else "unproved", failures[0], failures[1]
        equal = taken["own"] == taken["first"]
        if not taken["own"]:
            break
    failures = [_failing(file, file.check) for file in (own, first)]
    if any(failures):
        return "failed" if failures[0] else "unproved", failures[0], failures[1]
    return "equal" if equal else "different", None, None


_SEEN = ("path", "length", "modified", "changed", "volume", "file_no")


def _snapshot(row: str = "") -> Column:
    """What `_Watched` compares: the state of a file when it was listed."""
    of = lambda name: F.col(row + name)
    named = of("identity.id_high") != 0  # made from the path
    return F.struct(
        of("path").alias("path"), of("length").alias("length"), F.unix_micros(of("modified_at")).alias("modified"),
        F.unix_micros(of("changed_at")).alias("changed"), F.when(~named, of("identity.volume")).alias("volume"),
        F.when(~named, of("identity.id_low")).alias("file_no"),
    )


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for pair in batch.select(["own", "first"]).to_pylist():
            first, first_failure = _watched(pair["first"])
            own, failure = _watched(pair["own"])
            state = "failed" if failure else "unproved"
            if first and own:
                state, failure, first_failure = _compare(first, own)
            rows.append((state, failure, first_failure))
            for file in (first, own):
                if file:
                    file.close()
        columns = list(zip(*rows)) if rows else [()] * 3
        kept = [batch.column(name) for name in batch.schema.names if name not in ("own", "first")]
        names = [name for name in batch.schema.names if name not in ("own", "first")]
        yield pa.RecordBatch.from_arrays(
            [*kept, *[pa.array(column, pa.string()) for column in columns]], names=[*names, "state", "failure", "first_failure"]
        )


def compare_files(pairs: DataFrame) -> DataFrame:
    """The pairs with (state, failure, first_failure): each file's bytes against those of the `first` of its bucket, piece by piece.

    `pairs` has the columns of an inventory, `first` as a struct of the same, and others, which are kept. Both files are opened, checked
    against their listed identity, length and times, read, and checked again. State is `equal`, `different`, `failed` where the file itself
    could not be read or is not as listed, and `unproved` where only the first could not. No content leaves the task.
    """
    kept = [name for name in pairs.columns if name not in ("first", *INVENTORY.fieldNames())] + ["item_id", "path"]
    given = _spread(pairs.select("length", *[name for name in kept if name != "length"], _snapshot().alias("own"), _snapshot("first.").alias("first")))
    given = given.drop("length") if "length" not in kept else given
    schema = ", ".join(f"`{name}` {given.schema[name].dataType.simpleString()}" for name in given.columns if name not in ("own", "first"))
    return given.mapInArrow(_compared, f"{schema}, state string, failure string, first_failure string")


def _validated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        failures: list[str | None] = []
        for seen in batch.column("own").to_pylist():
            file, failure = _watched(seen)
            failures.append("Unavailable" if failure == "ComparisonFailed" else failure)
            if file:
                file.close()
        kept = [batch.column(name) for name in ("item_id", "path")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(failures, pa.string())], names=["item_id", "path", "failure"])


def validate_files(rows: DataFrame) -> DataFrame:
    """(item_id, path, failure) of the files of an inventory that are not there any more or are not as they were listed."""
    checked = rows.select("item_id", "path", _snapshot().alias("own")).mapInArrow(_validated, "item_id long, path string, failure string")
    return checked.filter("failure IS NOT NULL")


PROOF = exact.Proof(compare_files, validate_files)


class Images(NamedTuple):
    images: DataFrame
    skipped: DataFrame


# Formats that Spark's image source decodes.
DECODED = (".jpg", ".jpeg", ".png", ".bmp", ".gif")


HEAD = 256 << 10  # bytes of a file in which its orientation tag is looked for


def _turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            if row["path"].lower().endswith((".jpg", ".jpeg")):
                try:
                    system, inside, _ = _opened(row["path"])
                    with system.open_input_stream(inside) as stream:
                        tag = reduction.orientation(stream.read(HEAD))
                except OSError:  # gone since it was decoded
                    tag = 1
                if tag != 1:
                    stored = np.frombuffer(row["pixels"], np.uint8).reshape(row["height"], row["width"], row["channels"])
                    turned = reduction.turned(stored, tag)
                    row |= {"pixels": turned.tobytes(), "height": turned.shape[0], "width": turned.shape[1]}
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)


def read_images(spark: SparkSession, roots: Sequence[str], side: int | None = reduction.SIDE) -> Images:
    """Decoded pixels (item_id, path, width, height, channels, pixels) and the files that do not decode: `CodecUnavailable` where the
    source has no codec for the extension, `CorruptImage` otherwise.

    Images are reduced to `side` pixels on their longer side where they are decoded, so that whole ones travel no further; None keeps
    them. Then those of JPEG files are turned as their orientation tag says, which is read from the head of the file; a tag that is
    missing or broken leaves them as they are stored.
    """
    decoded = (
        spark.read.format("image")
        .option("dropInvalid", "false")
        .load(list(roots))
        .select(F.regexp_replace("image.origin", "^file:/*", "/").alias("path"), F.col("image").alias("_image"))
        .select(
            F.xxhash64("path").alias("item_id"),
            "path",
            F.col("_image.width").alias("width"),
            F.col("_image.height").alias("height"),
            F.col("_image.nChannels").alias("channels"),
            F.col("_image.data").alias("pixels"),
        )
    )
    known = F.lower(paths.extension(F.col("path"))).isin(*DECODED)
    whole = decoded.filter("width > 0")
    kept = whole if side is None else reduction.reduce_images(whole, side)
    return Images(
        kept.mapInArrow(_turned, kept.schema),
        decoded.filter("width <= 0").select(
            "item_id", "path", F.when(known, F.lit("CorruptImage")).otherwise(F.lit("CodecUnavailable")).alias("reason")
        ),
    )

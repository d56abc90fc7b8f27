"""The given tables as inventories, trees and images.

Text stays in its table: an inventory takes only length and digest from the scan, and the
`*_content` functions give the bytes back for proofs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duploscope.operators import exact
from duploscope.sources.inventory import identity_of, read_inventory

EXTENSIONS = ("txt", "JPG", "mp3", "mkv", "zip", "blend")
ALIAS_EVERY = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _doc_extension() -> Column:
    return F.element_at(F.array(*[F.lit(ext) for ext in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int"))


def _doc_name() -> Column:
    return F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("."), _doc_extension())


def _doc_modified(shift_hours: int | Column = 0) -> Column:
    hours = (F.col("doc_id") * 37) % 1000 + shift_hours
    return F.timestamp_seconds(F.lit(1704067200) + hours * 3600)


def docs(
    spark: SparkSession, sf_dir: str, with_labels: bool = False, aliases: bool = True, lengths: DataFrame | None = None
) -> DataFrame:
    """`documents` as an inventory; every 25th document has a second name for the same identity.

    With a table of lengths, only documents of these are there, and only they are hashed.
    """
    documents = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.octet_length("text").cast("long").alias("n_bytes"), "text"
    )
    if lengths is not None:
        documents = documents.join(lengths.select(F.col("length").alias("n_bytes")), "n_bytes", "left_semi")
    documents = documents.withColumn("digest", F.sha2("text", 256)).drop("text")
    attributes = F.array(F.lit("Normal"))
    if with_labels:
        labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
        documents = documents.join(labels, "doc_id", "left")
        attributes = F.when(F.col("toxic") == 1, F.array(F.lit("Hidden"))).otherwise(attributes)
    has_alias = (F.col("doc_id") % ALIAS_EVERY == 0) & F.lit(aliases)
    named = documents.withColumn(
        "alias", F.explode(F.when(has_alias, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    )
    folder = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"))
    below = F.when(F.col("alias") == 1, F.lit("/links/")).otherwise(F.lit("/"))
    return read_inventory(
        named,
        {
            "item_id": F.col("doc_id") * 2 + F.col("alias"),
            "root": F.concat(F.lit("/"), F.col("source")),
            "path": F.concat(folder, below, _doc_name()),
            "length": F.col("n_bytes"),
            "modified_at": _doc_modified(),
            "changed_at": _doc_modified(1),
            "identity": identity_of("doc_id"),
            "link_count": F.when(has_alias, F.lit(2)).otherwise(F.lit(1)),
            "attributes": attributes,
            "digest": F.col("digest"),
        },
    )


def docs_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`docs` before anything is hashed."""
    return docs(spark, sf_dir).withColumn("digest", F.lit(None).cast("string"))


def docs_digests(spark: SparkSession, sf_dir: str) -> exact.Reader:
    """Digests of the documents whose lengths occur among the asked ones."""

    def read(wanted: DataFrame) -> DataFrame:
        return docs(spark, sf_dir, lengths=wanted.select("length").distinct()).select("item_id", "path", "digest")

    return read


def docs_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes behind `docs`; an alias has those of its document."""
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") * 2).alias("item_id"),
        F.octet_length("text").cast("long").alias("length"),
        F.sha2("text", 256).alias("digest"),
        F.col("text").alias("content"),
    )


def docs_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of `docs` and their folders, some of which are hidden or links."""
    files = docs(spark, sf_dir, with_labels=True)
    folders = (
        files.select("root", F.explode(F.array(F.regexp_extract("path", "^(/[^/]+/[^/]+)/", 1))).alias("path"))
        .distinct()
    )
    attributes = (
        F.when(F.col("path").isin("/src3/de", "/src4/fr"), F.array(F.lit("Hidden")))
        .when(F.col("path") == "/src5/es", F.array(F.lit("ReparsePoint")))
        .otherwise(F.array(F.lit("Normal")))
    )
    listed = read_inventory(
        folders,
        {
            "item_id": -F.abs(F.xxhash64("path")) - 1,
            "root": F.col("root"),
            "path": F.col("path"),
            "extension": F.lit(""),
            "length": F.lit(0),
            "is_dir": F.lit(True),
            "attributes": attributes,
        },
    )
    return files.unionByName(listed)


def mirror(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """`documents` under /a, and under /b with some items lost, changed, moved or copied."""
    documents = table(spark, sf_dir, "documents")
    path = F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), _doc_name())
    left = read_inventory(
        documents.select("doc_id", path.alias("rel"), F.octet_length("text").alias("n_bytes"), F.sha2("text", 256).alias("digest")),
        {
            "item_id": F.col("doc_id"),
            "root": F.lit("/a"),
            "path": F.concat(F.lit("/a"), F.col("rel")),
            "length": F.col("n_bytes"),
            "modified_at": _doc_modified(),
            "changed_at": _doc_modified(1),
            "identity": identity_of("doc_id"),
            "digest": F.col("digest"),
        },
    )
    right = read_inventory(
        _mirror_right(documents.withColumn("rel", path)).select(
            "doc_id", "rel", "place", "changed", F.octet_length("body").alias("n_bytes"), F.sha2("body", 256).alias("digest")
        ),
        {
            "item_id": _right_id(),
            "root": F.lit("/b"),
            "path": F.concat(F.element_at(F.array(F.lit("/b"), F.lit("/b/moved"), F.lit("/b/copy")), F.col("place") + 1), F.col("rel")),
            "length": F.col("n_bytes"),
            "modified_at": _doc_modified(F.when(F.col("changed"), 5).otherwise(0)),
            "changed_at": _doc_modified(1),
            "identity": identity_of(F.col("doc_id") * 4 + F.col("place"), volume=2),
            "digest": F.col("digest"),
        },
    )
    return left, right


def _right_id() -> Column:
    """Negative, so that no number of documents makes both sides meet."""
    return -(F.col("doc_id") * 4 + F.col("place")) - 1


def _mirror_right(documents: DataFrame) -> DataFrame:
    """Rows of /b: place 0 = same path, 1 = moved, 2 = an extra copy."""
    doc = F.col("doc_id")
    changed = doc % 11 == 0
    place = F.when(changed, 0).when(doc % 13 == 0, 1).otherwise(0)
    places = F.when(doc % 17 == 0, F.array(place, F.lit(2))).otherwise(F.array(place))
    spread = documents.filter(doc % 7 != 0).withColumn("changed", changed).withColumn("place", F.explode(places))
    touched = F.col("changed") & (F.col("place") == 0)
    return spread.withColumn("changed", touched).withColumn(
        "body", F.when(touched, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    )


def mirror_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes behind both sides of `mirror`."""
    documents = table(spark, sf_dir, "documents").withColumn("rel", F.lit(""))
    shape = lambda df, item_id, body: df.select(
        item_id.alias("item_id"),
        F.octet_length(body).cast("long").alias("length"),
        F.sha2(body, 256).alias("digest"),
        F.col(body).alias("content"),
    )
    left = shape(documents, F.col("doc_id"), "text")
    right = shape(_mirror_right(documents), _right_id(), "body")
    return left.unionByName(right)


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_returnflag")
    return lines.agg(F.min("l_linestatus").alias("status"))


def order_content(files: DataFrame) -> DataFrame:
    """The bytes behind `order_trees`."""
    return files.select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_returnflag").alias("item_id"),
        F.octet_length("status").cast("long").alias("length"),
        F.sha2("status", 256).alias("digest"),
        F.col("status").alias("content"),
    )


def order_trees(lines: DataFrame) -> DataFrame:
    """`order_files` as one folder per order with a small file per line and return flag."""
    name = F.concat(F.col("l_linenumber").cast("string"), F.col("l_returnflag"))
    return read_inventory(
        lines,
        {
            "item_id": F.xxhash64("l_orderkey", "l_linenumber", "l_returnflag"),
            "root": F.lit("/orders"),
            "path": F.concat(F.lit("/orders/"), F.col("l_orderkey").cast("string"), F.lit("/"), name),
            "content": F.col("status"),
            "identity": identity_of("l_orderkey", F.col("l_linenumber") * 256 + F.ascii("l_returnflag")),
        },
    )


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`pages` by URL; the page text gives length and digest."""
    return read_inventory(
        table(spark, sf_dir, "pages"),
        {"item_id": F.col("page_id"), "path": F.col("url"), "content": F.col("html")},
    )


def grid_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings` as 8 by 8 images of grey levels 0..255: (item_id, path, width, height, grid)."""
    level = lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v.cast("double") * 256 + 128)))
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.concat(F.lit("/img/"), (F.col("vec_id") % 7).cast("string"), F.lit("/v"), F.col("vec_id").cast("string"), F.lit(".png")).alias("path"),
        F.lit(8).alias("width"),
        F.lit(8).alias("height"),
        F.transform("embedding", lambda v: level(v).cast("int")).alias("grid"),
    )


def twin_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`documents` under /a and again under /c, where every 50th is missing; all are items of their own."""
    documents = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("/"), F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), _doc_name()).alias("rel"),
        F.octet_length("text").alias("n_bytes"),
        F.sha2("text", 256).alias("digest"),
        F.explode(F.when(F.col("doc_id") % 50 == 0, F.array(F.lit("/a"))).otherwise(F.array(F.lit("/a"), F.lit("/c")))).alias("top"),
    )
    second = (F.col("top") == "/c").cast("long")
    return read_inventory(
        documents,
        {
            "item_id": F.col("doc_id") * 2 + second,
            "root": F.col("top"),
            "path": F.concat("top", "rel"),
            "length": F.col("n_bytes"),
            "modified_at": _doc_modified(),
            "changed_at": _doc_modified(1),
            "identity": identity_of("doc_id", volume=second + 1),
            "digest": F.col("digest"),
        },
    )


def text_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of each text as the pixels of an image 24 wide, as high as the text is long; the last row is filled up with zeros.
    An empty text has no pixels and makes no image."""
    stride = 24 * 3
    height = F.ceil(F.octet_length("text") / stride).cast("int")
    pixels = F.col("text").cast("binary")
    return (
        table(spark, sf_dir, "documents")
        .filter(F.octet_length("text") > 0)
        .select(
            F.col("doc_id").alias("item_id"),
            F.concat(F.lit("/text/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".png")).alias("path"),
            F.lit(24).alias("width"),
            height.alias("height"),
            F.lit(3).alias("channels"),
            F.rpad(pixels, height * stride, F.lit(b"\x00")).alias("pixels"),
        )
    )

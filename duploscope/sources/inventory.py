"""The inventory: one row per item.

An inventory never carries content. The digest is computed while the content is scanned, so only
(id, path, length, digest, ...) is ever shuffled; proofs go back to the content table, see
`duploscope.operators.exact`.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duploscope.functions import formats, paths

IDENTITY = T.StructType(
    [
        T.StructField("volume", T.LongType()),
        T.StructField("id_low", T.LongType()),
        T.StructField("id_high", T.LongType()),
    ]
)
INVENTORY = T.StructType(
    [
        T.StructField("item_id", T.LongType()),
        T.StructField("root", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("extension", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("modified_at", T.TimestampType()),
        T.StructField("changed_at", T.TimestampType()),
        T.StructField("identity", IDENTITY),
        T.StructField("link_count", T.IntegerType()),
        T.StructField("is_dir", T.BooleanType()),
        T.StructField("attributes", T.ArrayType(T.StringType())),
        T.StructField("digest", T.StringType()),
    ]
)


def identity_of(low: Column | str, high: Column | int = 0, volume: Column | int = 1) -> Column:
    as_long = lambda value: (value if isinstance(value, Column) else F.lit(value)).cast("long")
    return F.struct(
        as_long(volume).alias("volume"),
        as_long(F.col(low) if isinstance(low, str) else low).alias("id_low"),
        as_long(high).alias("id_high"),
    )


def read_inventory(df: DataFrame, mapping: Mapping[str, Column | str]) -> DataFrame:
    """Any table as an inventory.

    `mapping` names the expression of each inventory column; `item_id` and `path` are required,
    `content` gives length and digest unless those are mapped, and the rest has defaults. Further
    names in the mapping are kept as extra columns.
    """
    given = {name: F.expr(value) if isinstance(value, str) else value for name, value in mapping.items()}
    content = given.pop("content", None)
    path = given["path"]
    modified = given.get("modified_at", F.lit("1970-01-01 00:00:00"))
    defaults = {
        "root": paths.path_root(path),
        "file_name": paths.file_name(path),
        "extension": paths.extension(path),
        "length": F.octet_length(content) if content is not None else F.lit(None),
        "modified_at": modified,
        "changed_at": modified,
        "identity": identity_of(given["item_id"]),
        "link_count": F.lit(1),
        "is_dir": F.lit(False),
        "attributes": F.array(F.lit("Normal")),
        "digest": formats.content_digest(content) if content is not None else F.lit(None),
    }
    columns = [
        given.get(field.name, defaults.get(field.name)).cast(field.dataType).alias(field.name) for field in INVENTORY
    ]
    extra = [value.alias(name) for name, value in given.items() if name not in INVENTORY.fieldNames()]
    return df.select(*columns, *extra)

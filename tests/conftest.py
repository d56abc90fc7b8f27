import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from duploscope.session import get_session, run_scope  # noqa: E402
from duploscope.sources.inventory import INVENTORY  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests", "local[8]", spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")), spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="6g",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(autouse=True)
def tables_of_the_test(spark):
    """Intermediate tables go when the test that wrote them ends; those of wider fixtures stay."""
    with run_scope(spark):
        yield


EPOCH = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def inventory(spark):
    """Rows from dicts: path and length are required; content gives the digest, other columns have defaults."""

    def build(rows, root="/r"):
        table = []
        for number, row in enumerate(rows, start=1):
            path = row["path"]
            name = path.rsplit("/", 1)[-1]
            content = row.get("content")
            table.append(
                (
                    row.get("item_id", number),
                    row.get("root", root),
                    path,
                    row.get("file_name", name),
                    row.get("extension", "." + name.rsplit(".", 1)[1] if "." in name else ""),
                    row.get("length", len(content) if content is not None else 0),
                    EPOCH + timedelta(hours=row.get("modified", 0)),
                    EPOCH + timedelta(hours=row.get("changed", 0)),
                    row.get("identity", (1, number, 0)),
                    row.get("link_count", 1),
                    row.get("is_dir", False),
                    row.get("attributes", ["Normal"]),
                    row.get("digest", f"digest of {content!r}" if content is not None else None),
                )
            )
        return spark.createDataFrame(table, INVENTORY)

    return build


@pytest.fixture(scope="session")
def content_of(spark):
    def build(rows):
        table = [
            (row.get("item_id", number), row.get("length", len(row["content"])),
             row.get("digest", f"digest of {row['content']!r}"), row["content"])
            for number, row in enumerate(rows, start=1)
            if row.get("content") is not None
        ]
        return spark.createDataFrame(table, "item_id long, length long, digest string, content string")

    return build


@pytest.fixture(scope="session")
def values(spark):
    """Evaluate column expressions over one column `v` of the given values."""

    def run(inputs, expression, kind="string"):
        df = spark.createDataFrame([(n, v) for n, v in enumerate(inputs)], f"n int, v {kind}")
        return [row[1] for row in df.select("n", expression(F.col("v"))).orderBy("n").collect()]

    return run

"""Session settings and the written tables that cut a lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_scopes: list[list[str]] = []


def get_session(app_name: str = "duploscope", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on.

    ANSI mode makes sums and products fail on overflow instead of wrapping, UTC keeps
    timestamp text stable, adaptive execution splits skewed join partitions even where
    that costs one more shuffle, and a task takes up to 256 small files instead of 32.
    """
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.files.openCostInBytes": str(512 * 1024),
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: `spark.checkpoint.dir`, which every executor can reach.

    Only a session that is a single process may do without the setting; it gets a folder that goes when it ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    global _own_dir
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="duploscope-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return _own_dir


def materialize(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder and read it back.

    The result survives lost executors, is computed once for all its readers, and has a
    known size, so that Spark's own broadcast threshold works on real bytes.
    """
    path = f"{shared_dir(df.sparkSession)}/duploscope-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def run_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the intermediate tables that are written inside when it ends; results must have been written or collected by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for name in _scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

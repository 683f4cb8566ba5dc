"""Tables in the folder that all executors share, to cut lineage without a single local copy.

Every table is deleted with the driver's JVM at the latest; operators discard
theirs as soon as a successor exists, and ``scratch`` deletes what a block of
work has stored once its result is written elsewhere.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOCAL_SCRATCH: dict[str, str] = {}
_SCOPES: list[list[DataFrame]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a ``local`` session without that setting (tests) gets a temporary
    folder; a cluster without it is an error, as executors share no local disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in LOCAL_SCRATCH:
        LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="kinfold-")
    return "file://" + LOCAL_SCRATCH[app]


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; ``keep`` it when a ``scratch`` block ends.

    A lost executor costs no recomputation of what is stored.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/kinfold-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    files, where = _file_system(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinfold_path = path
    if _SCOPES and not keep:
        _SCOPES[-1].append(out)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete ``stored`` tables that nothing reads any more; others are left alone."""
    for df in tables:
        if path := getattr(df, "_kinfold_path", None):
            files, where = _file_system(df.sparkSession, path)
            files.delete(where, True)
            df._kinfold_path = None


@contextmanager
def scratch() -> Iterator[None]:
    """Delete all that is ``stored`` inside the block at its end: results must be written elsewhere by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        discard(*_SCOPES.pop())


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are no more referenced.

    They go when the driver's JVM collects the plans; without a hint that can
    take longer than a disk lasts. For a few places after large shuffles.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()

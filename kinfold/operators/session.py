"""Saved results: members as Parquet beside a line of JSON, in versioned folders with a pointer to the last."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _point(spark: SparkSession, folder: str, said: dict) -> None:
    """Replace the pointer by a rename: readers see the old version or the new one."""
    files, last = _files(spark, f"{folder}/current")
    _, new = _files(spark, f"{folder}/current.{uuid.uuid4().hex}")
    out = files.create(new, True)
    out.write(bytearray(json.dumps(said).encode()))
    out.close()
    files.delete(last, False)
    files.rename(new, last)


def pointer(spark: SparkSession, folder: str) -> dict | None:
    """What the pointer says; None if there is none or it can't be read."""
    if not (files := _files(spark, f"{folder}/current"))[0].exists(files[1]):
        return None
    try:
        return json.loads("".join(r.value for r in spark.read.text(f"{folder}/current").collect()))  # one line
    except ValueError:
        return None


def save(spark: SparkSession, folder: str, rows: DataFrame, **facts) -> int:
    """Write a new version of ``rows`` and point to it; the version before goes. Returns the number of rows."""
    old, name = pointer(spark, folder), uuid.uuid4().hex
    rows.write.parquet(f"{folder}/{name}")
    n = spark.read.parquet(f"{folder}/{name}").count()
    _point(spark, folder, {"version": VERSION, "rows": n, "data": name, **facts})
    if old:
        files, where = _files(spark, f"{folder}/{old['data']}")
        files.delete(where, True)
    return n


def peek(spark: SparkSession, folder: str) -> dict | None:
    """The facts of a saved session without its rows; None if there is none of this version."""
    said = pointer(spark, folder)
    return said if said and said.get("version") == VERSION else None


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, dict]:
    said = pointer(spark, folder)
    if not said:
        raise FileNotFoundError(folder)
    if said.get("version") != VERSION:
        raise ValueError(f"version {said.get('version')} isn't {VERSION}")
    return spark.read.parquet(f"{folder}/{said['data']}"), said


def clear(spark: SparkSession, folder: str) -> bool:
    files, where = _files(spark, folder)
    return bool(files.delete(where, True))


def size(spark: SparkSession, folder: str) -> int:
    """Bytes of all that the folder holds; 0 if it isn't there."""
    files, where = _files(spark, folder)
    return int(files.getContentSummary(where).getLength()) if files.exists(where) else 0


def decode_counts(rows: DataFrame) -> DataFrame:
    """Files, and how many of them were decoded or failed."""
    return rows.agg(F.count("*").alias("files"), F.count_if("decoded").alias("decoded"), F.count_if(~F.col("decoded")).alias("failed"))

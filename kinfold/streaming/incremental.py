"""Incremental duplicate detection over a stream of files (an extension: batch scans need none of it)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.store import replay


def streaming_groups(files: DataFrame) -> DataFrame:
    """Running size of each content group of a streaming table with md5 and size; for update or complete mode."""
    return files.groupBy("md5").agg(F.count("*").alias("members"), F.sum("size").alias("total_size"), F.max("size").alias("largest")).filter("members > 1")


def batch_writer(journal_path: str):
    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("seq", F.lit(epoch).cast("long")).write.mode("overwrite").json(f"{journal_path}/batch={epoch}")

    return write


def upsert_fingerprints(stream: DataFrame, journal_path: str, checkpoint: str):
    """Write each micro-batch to the journal in a folder of its own, so that a retried batch replaces itself; ``snapshot`` is the store."""
    return stream.writeStream.foreachBatch(batch_writer(journal_path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def snapshot(spark, journal_path: str, schema: str) -> DataFrame:
    return replay(spark.read.schema(schema).option("mode", "DROPMALFORMED").json(f"{journal_path}/batch=*"))

"""Exports of groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export_rows(members: DataFrame) -> DataFrame:
    """One row per member in the columns of the CSV export; place 0 has the role keep."""
    mb = lambda c: F.format_string("%.2f", F.col(c) / 1048576)
    have = set(members.columns)
    similarity = F.format_string("%.1f", F.col("similarity") * 100) if "similarity" in have else F.lit("100.0")
    return members.select(
        F.col("gid").alias("Group"),
        (F.col("algorithm") if "algorithm" in have else F.lit("md5")).alias("Type"),
        similarity.alias("Similarity %"),
        F.when(F.col("pos") == 0, "keep").otherwise("duplicate").alias("Role"),
        F.col("path").alias("Path"),
        F.col("name").alias("Name"),
        F.col("size").alias("Bytes"),
        mb("size").alias("MB"),
        F.col("width").alias("Width"),
        F.col("height").alias("Height"),
        F.format_string("%.2f", F.round(F.col("width").cast("long") * F.col("height") / 100000.0) / 10).alias("MP"),
        F.regexp_extract("name", r"\.([^.]*)$", 1).alias("Format"),
        F.date_format(F.timestamp_micros(F.floor(F.col("mod_unix") / 1000)), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("Modified"),
        F.col("md5").alias("MD5"),
    )


def write_csv(members: DataFrame, path: str) -> None:
    export_rows(members).write.option("header", True).csv(path)


def nested(members: DataFrame, groups: DataFrame) -> DataFrame:
    """Groups with their members as an array, for JSON; a group is as large as its members."""
    lists = members.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("pos", "path", "size", "mod_unix"))).alias("files"))
    return groups.join(lists, "gid")

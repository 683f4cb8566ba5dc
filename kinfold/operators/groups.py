"""Duplicate groups: content gates, exact groups, similarity groups, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components

MB = 1048576


def size_gate(files: DataFrame) -> DataFrame:
    """Files of a size that another file has; empty files match nothing. Only these need their content hashed."""
    sizes = files.filter("size > 0").groupBy("size").agg(F.count("*").alias("same_size")).filter("same_size > 1")
    return files.join(sizes, "size")


def hashed(files: DataFrame, content_md5: Column) -> DataFrame:
    return size_gate(files).withColumn("md5", content_md5)


def exact_members(rows: DataFrame, key: str = "md5") -> DataFrame:
    """Rows of groups of at least two, with gid (least path) and place by time and path."""
    groups = rows.filter(F.col(key).isNotNull() & (F.col(key) != "")).groupBy(key).agg(F.min("path").alias("gid"), F.count("*").alias("members")).filter("members > 1")
    return ranked(rows.join(groups, key))


def ranked(members: DataFrame) -> DataFrame:
    """pos: 0 for the oldest member, ties by path."""
    return members.withColumn("pos", F.row_number().over(Window.partitionBy("gid").orderBy("mod_unix", "path")) - 1)


def totals(members: DataFrame) -> DataFrame:
    """One row per group: gid, members, total_size, wasted_size (all but the largest)."""
    size = F.sum("size")
    return members.groupBy("gid").agg(F.count("*").alias("members"), size.alias("total_size"), (size - F.max("size")).alias("wasted_size")).filter("members > 1")


def by_waste(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("wasted_size"), "gid")


def scan_totals(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count("*").alias("groups"), F.round(F.coalesce(F.sum("wasted_size"), F.lit(0)) / MB, 6).alias("wasted_mb"))


def similar_members(rows: DataFrame, edges: DataFrame, key: str = "id") -> DataFrame:
    """Rows joined to the component of the edges that holds them; rows of no edge are left out."""
    return rows.join(connected_components(edges).select(F.col("node").alias(key), F.col("component").alias("gid")), key)


def bit_similarity(members: DataFrame, hashes: list[str], bits: int = 64) -> DataFrame:
    """(gid, similarity): 1 - mean Hamming distance of all pairs / 64, without making the pairs.

    A bit that is set in k of n members differs in k * (n - k) pairs.
    """
    ones = [F.sum(F.shiftrightunsigned(h, b).bitwiseAND(F.lit(1))).alias(f"{h}_{b}") for h in hashes for b in range(bits)]
    sums = members.groupBy("gid").agg(F.count("*").alias("n"), *ones)
    differ = F.lit(0)
    for c in sums.columns[2:]:
        differ = differ + F.col(c) * (F.col("n") - F.col(c))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return sums.filter("n > 1").select("gid", (1 - differ / (pairs * len(hashes)) / 64).alias("similarity"))


def folders(members: DataFrame) -> DataFrame:
    """Reclaimable bytes by folder: all members but the kept first."""
    return members.filter("pos > 0").groupBy("dir").agg(F.count("*").alias("files"), F.sum("size").alias("reclaimable"))


def not_in(rows: DataFrame, taken: DataFrame, key: str = "path") -> DataFrame:
    """Rows whose key isn't among those taken already."""
    return rows.join(taken.select(key).distinct(), key, "left_anti")


def pair_similarity(members: DataFrame, similarity, column: str, key: str = "id") -> DataFrame:
    """(gid, similarity): the mean of similarity(x, y) over the pairs of each group.

    Means that are rounded or aligned pair by pair have no linear form, so the
    pairs are made; large groups cost their square, in tasks by (gid, key).
    """
    other = members.select("gid", F.col(key).alias("key2"), F.col(column).alias("other"))
    pairs = members.select("gid", F.col(key).alias("key1"), column).join(other, "gid").filter("key1 < key2")
    return pairs.groupBy("gid").agg(F.avg(similarity(F.col(column), F.col("other"))).alias("similarity"))


def inherit(members: DataFrame, value: str, key: str = "id") -> DataFrame:
    """Members without a ``value`` take that of their group's representative: the first member that has one."""
    has = F.when(F.col(value).isNotNull() & (F.size(value) > 0), F.struct(F.col(key).alias("k"), F.col(value).alias("v")))
    rep = members.groupBy("gid").agg(F.min_by(F.col(value), F.when(has.isNotNull(), F.col(key))).alias("rep_value"), F.min(F.when(has.isNotNull(), F.col(key))).alias("rep"))
    own = F.when(has.isNotNull(), F.col(value))
    return members.join(rep, "gid", "left").withColumn(value, F.coalesce(own, "rep_value")).drop("rep_value")


def page(groups: DataFrame, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of the groups by waste, with their place ``rank`` (from 1)."""
    first = groups.orderBy(F.desc("wasted_size"), "gid").limit(number * size)
    rank = F.row_number().over(Window.orderBy(F.desc("wasted_size"), "gid"))  # over at most number * size rows
    return first.withColumn("rank", rank).filter(F.col("rank") > (number - 1) * size)

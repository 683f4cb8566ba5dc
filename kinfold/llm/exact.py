"""Exact deduplication with a heavy-hitter split, in DataFrame and SQL functions only.

1. A digest per row (SHA-256 of the UTF-8 text) is stored once; the rest reads
   digests, not texts.
2. ``approx_top_k`` - a Misra-Gries summary, kept per partition and merged -
   names at most ``heavy`` frequent digests; every digest with over
   1/``tracked`` of the rows is among those it tracks.
3. An exact count and the largest key of those digests (partial sums, at most
   ``heavy`` rows) verify the winners, which are broadcast: losers of heavy
   groups are decided map-side, without a shuffle.
4. All other rows, and the winners' own, go through one shuffle on the digest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, unused


def decide(docs: DataFrame, key: str = "doc_id", text: str = "text", heavy: int = 256, tracked: int = 4096) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if identical; null counts as empty. The row with the
    largest key stays (null keys are smaller than any); of rows equal in key
    and text exactly one is kept, whichever. Other columns aren't read. An empty
    table gives no rows.
    """
    digest = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)
    rows = stored(docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), digest.alias("text_sha256")), "digests")
    top = rows.agg(F.expr(f"approx_top_k(text_sha256, {heavy}, {tracked})").alias("top"))
    frequent = top.select(F.explode("top").alias("t")).filter("t.count > 1").select(F.col("t.item").alias("text_sha256"))
    winners = rows.join(F.broadcast(frequent), "text_sha256").groupBy("text_sha256").agg(F.max("doc_id").alias("w_id"), F.count("*").alias("w_size"))
    winners = stored(winners, "winners")  # at most ``heavy`` rows
    split = rows.join(F.broadcast(winners), "text_sha256", "left")
    loses = F.col("w_size").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("w_id"))
    lost = split.filter(loses).select("doc_id", F.col("w_id").alias("keep_id"), F.col("w_size").alias("group_size"), F.lit(False).alias("kept"), "text_sha256")
    group = Window.partitionBy("text_sha256")
    first = F.row_number().over(group.orderBy(F.col("doc_id").desc_nulls_last())) == 1
    rest = split.filter(~loses).select(
        "doc_id",
        F.max("doc_id").over(group).alias("keep_id"),
        F.coalesce("w_size", F.count("*").over(group)).alias("group_size"),
        first.alias("kept"),
        "text_sha256",
    )
    return lost.unionByName(rest)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", heavy: int = 256, tracked: int = 4096) -> DataFrame:
    """The rows that stay, with all their columns, whatever their names; of rows equal in key and text one stays.

    Null texts count as empty, null keys as smaller than any. An empty table gives no rows.
    """
    sha, kept_id, kept_sha, times = unused(docs, "sha", "kept_id", "kept_sha", "kept_times")
    kept = decide(docs, key, text, heavy, tracked).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("times"))
    kept = kept.filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha), F.col("times").alias(times))
    digest = F.sha2(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary"), 256)
    marked = docs.withColumn(sha, digest)
    found = marked.join(kept, F.col(f"`{key}`").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha)))
    once = found.filter(F.col(times) == 1)
    repeated = found.filter(F.col(times) > 1).dropDuplicates([kept_id, kept_sha])
    return once.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])

"""Sharding as a two-pass external shuffle, in DataFrame functions only.

Pass 1 scatters rows by seeded hashes into buckets of bounded size, pass 2
puts each bucket in order by a Fisher-Yates shuffle and writes it.

A shard is chosen by rendezvous hashing of (seed, doc_id, shard): the largest
hash wins, so one more shard takes rows only into itself. Within a shard a
second hash picks a bucket of about ``bucket_bytes`` or ``bucket_rows`` rows, whichever is less. Pass 1 writes the
buckets to the shared folder; pass 2 reads them one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, stored


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard of a key: that with the largest seeded hash."""
    ranked = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("h"), F.lit(s).alias("s")) for s in range(shards)]
    return F.array_max(F.array(*ranked))["s"]


def fisher_yates(n: Column, seed: int, bucket: Column) -> Column:
    """A permutation of 0..n-1: for i from n-1 down to 1, swap places i and j, j being a seeded draw from 0..i.

    One step rebuilds the array, so n must be small; ``bucket_rows`` bounds it.
    """

    def swap(p: Column, i: Column) -> Column:
        j = F.pmod(F.xxhash64(F.lit(seed), bucket, i), i + 1).cast("int")
        a, b = F.get(p, i), F.get(p, j)
        whole = F.concat(F.slice(p, F.lit(1), j), F.array(a), F.slice(p, j + 2, i - j - 1), F.array(b), F.slice(p, i + 2, F.size(p) - i - 1))
        return F.when(i == j, p).otherwise(whole)

    start = F.sequence(F.lit(0), n - 1)
    steps = F.when(n > 1, F.sequence(n - 1, F.lit(1), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, swap)


def shard(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", seed: int = 7, bucket_rows: int = 512, bucket_bytes: int = 16 << 20) -> DataFrame:
    """All input columns, and shard, slot (gapless from 0 within a shard) and grown_shard (with one more shard).

    Law: ``key``; the shard depends on the key and the number of shards alone.
    Null keys count as one key. Copies of a text under different keys spread
    over all buckets; rows equal in key and text share one, in any order.
    Text may be null or empty. Input columns called shard, slot or grown_shard
    are replaced. An empty table gives no rows.
    """
    docs = free_names(docs, "shard", "slot", "grown_shard")
    names = docs.columns
    k = F.col(f"`{key}`")
    scattered = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
        rendezvous(k, shards, seed).alias("shard"),
        rendezvous(k, shards + 1, seed).alias("grown_shard"),
        k.alias("k"),
        F.xxhash64(k, F.col(f"`{text}`")).alias("entry"),
    )
    held = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(F.col(f"`{text}`").cast("binary")).cast("long")), F.lit(0)).alias("bytes")).first()
    per_shard = max(1, -(-held["rows"] // (shards * bucket_rows)), -(-held["bytes"] // (shards * bucket_bytes)))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), "k", "entry"), F.lit(per_shard)).cast("long")
    entries = scattered.withColumn("bucket", bucket)
    lists = stored(entries.groupBy("shard", "bucket").agg(F.array_sort(F.collect_list(F.struct("entry", "grown_shard", "row"))).alias("rows")).withColumn("n", F.size("rows")), "buckets")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = lists.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = fisher_yates(F.col("n"), seed, F.struct("shard", "bucket"))
    shuffled = lists.select("shard", "bucket", F.transform(order, lambda i: F.get("rows", i)).alias("rows"))
    out = shuffled.join(offsets, ["shard", "bucket"]).select("shard", "base", F.posexplode("rows").alias("pos", "e"))
    return out.select(*[F.col(f"e.row.`{c}`").alias(c) for c in names], F.col("shard").cast("int").alias("shard"), (F.col("base") + F.col("pos")).alias("slot"), F.col("e.grown_shard").cast("int").alias("grown_shard"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write each shard to its own folder, in the order of its slots; long shards become several files."""
    sharded.repartitionByRange(F.col("shard"), F.col("slot")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

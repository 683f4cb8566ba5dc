"""Similarity joins: blocks or buckets that meet, and an exact filter."""

from __future__ import annotations

from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.near import Forest, near
from ..functions.scalar import duration_bucket, duration_close
from ..plans.scratch import stored


def band_widths(most: int, rows: int) -> list[int]:
    """Widths of the bands of 64 bits for which a join by probing rows costs least: probes a hash, which are shuffled, and what random hashes they meet."""

    def cost(n: int) -> float:
        width = 64 // n
        masks = sum(comb(width + 1, r) for r in range(most // n + 1))
        return n * masks * (4 + rows / 2**width) if masks <= 4096 else float("inf")

    n = min(range(2, 17), key=cost)
    return [64 // n + (i < 64 % n) for i in range(n)]


def _near(most: int, forest: bool):
    """applyInArrow function: (x, y, block, h, rep) of two blocks to pairs (a, b, dist) across them, or within one if x = y."""

    def run(table):
        import pyarrow as pa

        table = table.combine_chunks()
        block, h, rep = (table[c].to_numpy() for c in ("block", "h", "rep"))
        first = block == table["x"][0].as_py()
        second = first if table["x"][0] == table["y"][0] else ~first
        own, left, right = second is first, np.flatnonzero(first), np.flatnonzero(second)
        h, held, joined = h.view(np.uint64), [np.zeros(0, np.int64)], Forest(len(h))
        for i, j in near(h[left], h[right], most):
            i, j = left[i], right[j]
            if own:
                i, j = i[i < j], j[i < j]
            code = i * len(h) + j
            held.append(code[[joined.joins(*x) for x in zip(i.tolist(), j.tolist(), strict=True)]] if forest and len(code) else code)
        i, j = np.divmod(np.unique(np.concatenate(held)), max(1, len(h)))
        dist = np.bitwise_count(h[i] ^ h[j]).astype(np.int64)
        return pa.table({"a": np.minimum(rep[i], rep[j]), "b": np.maximum(rep[i], rep[j]), "dist": dist})

    return run


def hamming_pairs(hashes: DataFrame, most: int, key: str = "id", hash_col: str = "fp", forest: bool = False, block: int = 1 << 15) -> DataFrame:
    """Pairs (a, b, dist) of different keys, a < b, whose 64-bit hashes differ in at most ``most`` bits; exact.

    Equal hashes are collapsed first, to their least key. The distinct ones are
    dealt into blocks, and every two blocks meet in one task, which probes bands
    of the bits or, if many bits may differ, compares all. Its memory is that of
    two blocks and their pairs. forest: of the links of two blocks only so many
    as join the same keys, for components.
    """
    distinct = hashes.filter(F.col(hash_col).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(hash_col).cast("long").alias("h")).agg(F.min(key).cast("long").alias("rep"))
    distinct = stored(distinct, "hashes")
    n = distinct.count()
    blocks = max(-(-n // block), min(12, 1 + n // 1024))  # several tasks for small tables too
    dealt = distinct.withColumn("block", F.pmod(F.xxhash64("h"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    meet = dealt.select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "h", "rep")
    tasks = min(blocks * (blocks + 1) // 2, 2000)
    return meet.repartition(tasks, "x", "y").groupBy("x", "y").applyInArrow(_near(most, forest), "a long, b long, dist long")


def _agree(kinds: list[str], most: int, least: int):
    """applyInArrow function: (x, y, block, kinds..., rep) of two blocks to links (a, b) across them, or within one if x = y."""

    def run(table):
        import pyarrow as pa

        table = table.combine_chunks()
        block, rep = (table[c].to_numpy() for c in ("block", "rep"))
        has = [table[k].is_valid().to_numpy() for k in kinds]
        hashes = [table[k].fill_null(0).to_numpy().view(np.uint64) for k in kinds]
        first = block == table["x"][0].as_py()
        left, right = np.flatnonzero(first), np.flatnonzero(first if table["x"][0] == table["y"][0] else ~first)
        part, found = np.arange(len(rep)), []
        for k in range(len(kinds) - least + 1):  # with one vote less than ``least`` among the others, no pair has enough
            one, other = left[has[k][left]], right[has[k][right]]
            for i, j in near(hashes[k][one], hashes[k][other], most):
                i, j = one[i], other[j]
                i, j = (x[part[i] != part[j]] for x in (i, j))
                votes = np.zeros(len(i), np.int64)
                for h, known in zip(hashes, has, strict=True):
                    votes += (np.bitwise_count(h[i] ^ h[j]) <= most) & known[i] & known[j]
                for x, y in zip(i[votes >= least].tolist(), j[votes >= least].tolist(), strict=True):
                    if part[x] != part[y]:
                        part[part == part[y]] = part[x]
                        found.append((x, y))
        i, j = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": np.minimum(rep[i], rep[j]), "b": np.maximum(rep[i], rep[j])})

    return run


def agreeing_links(rows: DataFrame, kinds: list[str], most: int, least: int, key: str = "id", block: int = 1 << 15) -> DataFrame:
    """Links (a, b) that join all keys whose hashes of at least ``least`` kinds differ in at most ``most`` bits; exact, for components.

    Rows of equal hashes are linked by stars. The distinct ones meet in blocks,
    as in ``hamming_pairs``; of the links of two blocks only so many are kept as
    join the same keys, so no pairs are made.
    """
    known = sum((F.col(k).isNotNull().cast("int") for k in kinds), F.lit(0))
    rows = rows.filter((known >= least) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), *[F.col(k).cast("long").alias(k) for k in kinds])
    groups = stored(rows.groupBy(*kinds).agg(F.min("id").alias("rep"), F.count("*").alias("n")), "hashes")
    n = groups.count()
    blocks = max(-(-n // block), min(12, 1 + n // 1024))
    dealt = groups.withColumn("block", F.pmod(F.xxhash64(*kinds), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    meet = dealt.select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", *kinds, "rep")
    across = meet.repartition(min(blocks * (blocks + 1) // 2, 2000), "x", "y").groupBy("x", "y").applyInArrow(_agree(kinds, most, least), "a long, b long")
    several, left = groups.filter("n > 1").alias("g"), rows.alias("r")
    same = left.join(several, [F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}")) for k in kinds]).filter("id != rep")
    return across.unionByName(same.select(F.col("rep").alias("a"), F.col("id").alias("b")))


def close_pairs(hashes: DataFrame, most: int, key: str = "id", hash_col: str = "fp") -> DataFrame:
    """All pairs (a, b, dist) of keys within ``most`` bits, those of equal hashes too; for reports and votes, not for groups."""
    across = hamming_pairs(hashes, most, key, hash_col)
    rep = hashes.filter(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(key).alias("rep"))
    held = hashes.join(rep, hash_col).select(F.col(key).alias("id"), "rep")
    across = across.join(held.select(F.col("rep").alias("a"), F.col("id").alias("x")), "a").join(held.select(F.col("rep").alias("b"), F.col("id").alias("y")), "b")
    same = held.join(held.select("rep", F.col("id").alias("y")), "rep").filter("id < y").select(F.col("id").alias("a"), F.col("y").alias("b"), F.lit(0).cast("long").alias("dist"))
    return across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "dist").unionByName(same)


def same_hash_links(hashes: DataFrame, key: str = "id", hash_col: str = "fp") -> DataFrame:
    """Star links (a, b) from each key to the least key of its hash."""
    least = hashes.filter(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(key).alias("a"))
    return hashes.join(least, hash_col).filter(F.col(key) != F.col("a")).select("a", F.col(key).alias("b"))


def duration_pairs(rows: DataFrame, key: str = "id", duration: str = "duration", where: Column | None = None) -> DataFrame:
    """Self-join of rows with close durations; right-hand columns end in ``2``, and the left key is the smaller.

    Buckets make it an equi-join: a row meets its own and the two neighbouring buckets.
    """
    bucketed = rows.withColumn("bucket", duration_bucket(F.col(duration)))
    right = rows.select(*[F.col(c).alias(f"{c}2") for c in rows.columns])
    right = right.withColumn("bucket", F.explode(F.array(*[duration_bucket(F.col(f"{duration}2")) + d for d in (-1, 0, 1)])))
    close = (F.col(key) < F.col(f"{key}2")) & duration_close(F.col(duration), F.col(f"{duration}2"))
    return bucketed.join(right, "bucket").filter(close if where is None else close & where).drop("bucket")


def duration_candidates(rows: DataFrame, key: str = "id", duration: str = "duration") -> DataFrame:
    """(key, duration, candidate): whether another row's duration is close.

    A close row exists if one of the neighbours in order is close. Neighbours
    are looked up per bucket; across buckets only the extremes matter.
    """
    b = rows.select(key, duration, duration_bucket(F.col(duration)).alias("bucket"))
    order = Window.partitionBy("bucket").orderBy(duration, key)
    edges = b.groupBy("bucket").agg(F.min(duration).alias("lo"), F.max(duration).alias("hi"))
    below = edges.select((F.col("bucket") + 1).alias("bucket"), F.col("hi").alias("below"))
    above = edges.select((F.col("bucket") - 1).alias("bucket"), F.col("lo").alias("above"))
    near = b.withColumn("prev", F.lag(duration).over(order)).withColumn("next", F.lead(duration).over(order))
    near = near.join(below, "bucket", "left").join(above, "bucket", "left")
    hits = [F.coalesce(duration_close(F.col(duration), F.col(c)), F.lit(False)) for c in ("prev", "next", "below", "above")]
    return near.select(key, duration, (hits[0] | hits[1] | hits[2] | hits[3]).alias("candidate"))


def votes(edges_by_hash: dict[str, DataFrame], least: int = 2) -> DataFrame:
    """Pairs (a, b, votes) on which at least ``least`` kinds of hashes agree."""
    every = None
    for name, edges in edges_by_hash.items():
        one = edges.select("a", "b", F.lit(name).alias("algo"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("a", "b").agg(F.countDistinct("algo").alias("votes")).filter(F.col("votes") >= least)

"""Shared helpers: scratch tables that every executor can read, safe column names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import discard, release, scratch, scratch_dir, stored

__all__ = ["discard", "free_names", "hold", "pieces", "release", "remainder", "scratch", "scratch_dir", "split_join", "stored", "trim", "unused"]


def free_names(df: DataFrame, *added: str) -> DataFrame:
    """Drop input columns whose names (in any case) an operator's results need."""
    taken = {name.lower() for name in added}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def remainder(col: str, modulus: int):
    """crc32 of the column as text, modulo ``modulus`` (null counts as empty text)."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % modulus


def pieces(batches, rows: int = 256):
    """Cut Arrow batches into small ones, so that Python holds few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def hold() -> None:
    """Let a Python worker keep what it frees, up to 128 MB, until ``trim``: where arrays of the same sizes are made
    again and again, fresh pages can cost as much as the work on them."""
    import ctypes

    if hasattr(libc := ctypes.CDLL(None), "mallopt"):
        libc.mallopt(-3, 1 << 25)  # the size from which each array gets pages of its own (at most 32 MB)
        libc.mallopt(-1, 1 << 27)  # what is kept


def trim() -> None:
    """Give what a Python worker has freed back to the system: workers stay for later tasks, beside the JVM."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def unused(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like the wanted ones that no column of ``df`` has, in any case of letters."""
    taken, out = {name.lower() for name in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def split_join(rows: DataFrame, facts: DataFrame, on: str, total: int, size: str = "size", parts: int = 1024) -> DataFrame:
    """``rows`` left-joined with ``facts`` (unique in ``on``, with the number of rows of each key in ``size``), ``size`` dropped.

    Keys of over 1/parts of all ``total`` rows, and so fewer than ``parts``, are
    broadcast; only the others' rows are shuffled, so no task gets a hot key.
    """
    bound = max(1, total // parts)
    hot = F.broadcast(facts.filter(F.col(size) > bound).drop(size).withColumn("_hot", F.lit(True)))  # under ``parts`` rows
    cold = facts.filter(F.col(size) <= bound).drop(size)
    split = rows.join(hot, on, "left")
    far = split.filter("_hot is null").select(*rows.columns).join(cold, on, "left")
    return split.filter("_hot").drop("_hot").unionByName(far)

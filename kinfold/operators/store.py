"""Fingerprint store: lookups by path, by content after a rename, journal replay, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import session


def lookup(files: DataFrame, entries: DataFrame, fingerprint: str = "md5") -> DataFrame:
    """Files with the fingerprint stored under the same path, size and time, else null."""
    e = entries.select("path", "size", "mod_unix", F.col(fingerprint).alias("cached"))
    return files.join(e, ["path", "size", "mod_unix"], "left")


def rename_lookup(files: DataFrame, entries: DataFrame, fingerprint: str = "md5") -> DataFrame:
    """For files no path of the store knows: the fingerprint of the last entry of the same size, time and content.

    Entries carry ``quick`` (content hash, may be null or empty) and ``seq``.
    """
    signed = entries.filter("quick is not null and quick != ''").groupBy("size", "mod_unix").agg(F.max_by(F.struct(F.col("quick"), F.col(fingerprint).alias("cached")), "seq").alias("last"))
    known = entries.select("path", "size", "mod_unix")
    missing = files.join(known, ["path", "size", "mod_unix"], "left_anti").join(signed, ["size", "mod_unix"], "left")
    return missing.withColumn("cached", F.when(F.col("last.quick") == F.col("quick"), F.col("last.cached"))).drop("last")


def replay(journal: DataFrame) -> DataFrame:
    """The last entry of each path."""
    return journal.groupBy("path").agg(F.max_by(F.struct(*[c for c in journal.columns if c != "path"]), "seq").alias("e")).select("path", "e.*")


def merged(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """Entries of both; columns that the new entry leaves null keep the old value."""
    n = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns])
    both = old.join(n, old[key] == n[f"n_{key}"], "full_outer")
    columns = [F.coalesce(*[x for x in (F.col(f"n_{c}") if c in new.columns else None, old[c] if c in old.columns else None) if x is not None]).alias(c) for c in dict.fromkeys([*old.columns, *new.columns])]
    return both.select(*columns)


def stats(looked_up: DataFrame) -> DataFrame:
    """Entries asked for, hits, misses and hit rate in percent; one per file."""
    hits = F.count("cached")
    return looked_up.agg(F.count("*").alias("files"), hits.alias("hits"), (F.count("*") - hits).alias("misses"), F.round(100.0 * hits / F.count("*"), 6).alias("rate"))


def load_journal(spark, path: str, schema: str) -> DataFrame:
    """Journal lines; torn or malformed lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def append(entries: DataFrame, folder: str, seq: int) -> None:
    """Add entries to the store's journal, in a folder named by ``seq``: a retried batch replaces itself."""
    entries.withColumn("seq", F.lit(seq).cast("long")).write.mode("overwrite").json(f"{folder}/journal/batch={seq}")


def load(spark, folder: str, schema: str) -> DataFrame:
    """Snapshot and journal as one table of the last entry of each path; columns a later entry leaves null keep their value.

    schema: of the entries, with path. A store that isn't there is empty.
    """
    empty = spark.createDataFrame([], schema)
    base = session.load(spark, folder)[0].select(*empty.columns) if session.pointer(spark, folder) else empty
    files, where = session._files(spark, f"{folder}/journal")
    if not files.exists(where):
        return base
    lines = load_journal(spark, f"{folder}/journal/batch=*", f"{schema}, seq long").filter("path is not null")
    last = lines.groupBy("path").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in empty.columns if c != "path"])
    return merged(base, last)


def compact(spark, folder: str, schema: str) -> int:
    """Write a new snapshot of the store, point to it, and only then drop the journal. Returns the entries."""
    n = session.save(spark, folder, load(spark, folder, schema))
    session.clear(spark, f"{folder}/journal")
    return n


def clear(spark, folder: str) -> bool:
    """Forget all entries."""
    return session.clear(spark, folder)


def size(spark, folder: str) -> int:
    """Bytes of the snapshot and the journal."""
    return session.size(spark, folder)

"""File listings: a directory walk as a Python data source, and tables read as virtual files."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..constants import extensions
from ..functions.scalar import extension, in_dir

SCHEMA = "path string, name string, dir string, size bigint, mod_unix bigint"


@dataclass
class Subtree(InputPartition):
    path: str
    deep: bool


class WalkReader(DataSourceReader):
    """One partition per subfolder of the roots, and one for each root's own files."""

    def __init__(self, options):
        self.roots = [os.path.abspath(r) for r in options["roots"].split(os.pathsep)]
        self.skip_hidden = options.get("skiphidden", "true") == "true"
        self.exts = set(filter(None, options.get("extensions", "").split(",")))
        self.excluded = [os.path.abspath(x) for x in options.get("exclude", "").split(os.pathsep) if x.strip()]
        self.min_bytes = int(options.get("minsizekb", "0")) * 1024

    def partitions(self):
        parts = []
        for root in dict.fromkeys(self.roots):
            parts.append(Subtree(root, False))
            parts += [Subtree(e.path, True) for e in self._entries(root) if e.is_dir(follow_symlinks=False) and self._open(e.path, e.name)]
        return parts

    def _entries(self, path):
        try:
            return sorted(os.scandir(path), key=lambda e: e.name)
        except OSError:
            return []

    def _open(self, path, name):
        return not (self.skip_hidden and name.startswith(".")) and not any(path == x or path.startswith(x + os.sep) for x in self.excluded)

    def read(self, part):
        todo = [part.path]
        while todo:
            at = todo.pop()
            for e in self._entries(at):
                if not self._open(e.path, e.name):
                    continue
                if e.is_dir(follow_symlinks=False):
                    todo += [e.path] if part.deep else []
                elif not self.exts or os.path.splitext(e.name)[1].lower().lstrip(".") in self.exts:
                    try:
                        s = e.stat()
                    except OSError:
                        continue
                    if s.st_size >= self.min_bytes:
                        yield e.path, e.name, at, s.st_size, s.st_mtime_ns


class WalkSource(DataSource):
    @classmethod
    def name(cls):
        return "walk"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WalkReader(self.options)


def walk(spark: SparkSession, roots: list[str], category: str = "all", skip_hidden: bool = True, min_size_kb: int = 0, exclude: list[str] | None = None, exts: list[str] | None = None) -> DataFrame:
    """Files below the roots, each path once."""
    spark.dataSource.register(WalkSource)
    options = {
        "roots": os.pathsep.join(roots),
        "skiphidden": str(skip_hidden).lower(),
        "extensions": ",".join(x.lower().lstrip(".") for x in exts) if exts else ",".join(extensions(category)),
        "exclude": os.pathsep.join(exclude or []),
        "minsizekb": str(min_size_kb),
    }
    return spark.read.format("walk").options(**options).load().dropDuplicates(["path"])


def file_filter(files: DataFrame, category: str = "all", exts: list[str] | None = None, skip_hidden: bool = True, min_size_kb: int = 0, exclude: list[str] | None = None, root: str = "") -> DataFrame:
    """The walk's filters over a table of files."""
    wanted = [x.lower().lstrip(".") for x in exts] if exts else extensions(category)
    keep = extension(F.col("name")).isin(*wanted) & (F.col("size") >= min_size_kb * 1024)
    if skip_hidden:
        keep = keep & ~F.substring("path", len(root) + 1, 1 << 30).rlike(r"/\.")
    for x in exclude or []:
        keep = keep & ~in_dir(F.col("dir"), x)
    return files.filter(keep).dropDuplicates(["path"])


def virtual_files(docs: DataFrame, content: str = "text", key: str = "doc_id", directory: Column | None = None) -> DataFrame:
    """A table's rows as files: path, name, dir, size, mod_unix (ns), width, height, content."""
    d = directory if directory is not None else F.concat(F.lit("/"), "source", F.lit("/"), "lang")
    name = F.concat(F.lit("doc_"), F.col(key), F.lit(".txt"))
    raw = F.col(content).cast("binary")
    return docs.select(
        F.col(key).alias("id"),
        F.concat(d, F.lit("/"), name).alias("path"),
        name.alias("name"),
        d.alias("dir"),
        F.octet_length(raw).cast("long").alias("size"),
        ((F.lit(1600000000).cast("long") + F.col(key) * 7919 % 1000000) * 1000000000).alias("mod_unix"),
        (F.octet_length(raw) % 400 + 100).cast("int").alias("width"),
        (F.col(key) % 300 + 100).cast("int").alias("height"),
        raw.alias("content"),
    )


def partial_hash_files(files: DataFrame, threshold: int = 1 << 20, chunk: int = 64 << 10) -> DataFrame:
    """md5 of real files by seek reads, so that no large file is held in memory; null if unreadable."""

    def run(frames):
        import hashlib

        for frame in frames:
            out = []
            for path, size in zip(frame["path"], frame["size"], strict=True):
                try:
                    with open(path, "rb") as f:
                        if size <= threshold:
                            out.append(hashlib.md5(f.read()).hexdigest())
                            continue
                        h = hashlib.md5(f.read(chunk))
                        for at in (size // 2 - chunk // 2, size - chunk):
                            f.seek(at)
                            h.update(f.read(chunk))
                        out.append(h.hexdigest() if not h.update(int(size).to_bytes(8, "little")) else None)
                except OSError:
                    out.append(None)
            yield frame.assign(md5=out)

    return files.mapInPandas(run, files.schema.simpleString()[7:-1].replace(":", " ") + ", md5 string")

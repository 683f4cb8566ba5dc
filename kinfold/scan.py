"""A scan from its settings to groups: gates, stored fingerprints, hashes by mode, exact and perceptual groups in one result."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .constants import clamped, mode_hashes
from .functions.scalar import content_hash
from .operators import groups as G
from .operators import joins as J
from .operators import store
from .operators.components import connected_components
from .plans.scratch import stored
from .sources import files as files_of
from .sources import media

#: What a mode's perceptual groups are called; others are "perceptual".
ALGORITHMS = {"quick": "dhash", "standard": "phash", "robust": "ahash+dhash", "smart": "smart"}


@dataclass(frozen=True)
class ScanSpec:
    roots: tuple[str, ...] = ()
    category: str = "images"
    mode: str = "quick"
    threshold: float = 5
    extensions: tuple[str, ...] = ()
    skip_hidden: bool = True
    min_size_kb: int = 0
    exclude: tuple[str, ...] = ()
    min_votes: int = 2
    verify_full: bool = False
    settings: dict = field(default_factory=dict, compare=False)


@dataclass(frozen=True)
class ScanResult:
    """members: a row a file, with gid, pos, exact, algorithm, similarity; groups: totals, by waste."""

    spec: ScanSpec
    members: DataFrame

    @property
    def groups(self) -> DataFrame:
        facts = self.members.groupBy("gid").agg(F.first("exact").alias("exact"), F.first("algorithm").alias("algorithm"), F.first("similarity").alias("similarity"))
        return G.by_waste(G.totals(self.members).join(facts, "gid"))

    @property
    def totals(self) -> DataFrame:
        return G.scan_totals(G.totals(self.members))


def scan(spark: SparkSession, spec: ScanSpec, files: DataFrame | None = None, content: Column | None = None, entries: DataFrame | None = None) -> ScanResult:
    """Groups of equal and similar files.

    files: a table in place of the walk of ``spec.roots``, with path, name, dir,
    size, mod_unix and, for perceptual modes, id, decoded and the mode's hashes;
    content: their bytes, else they are read by path. entries: a store, whose
    hashes save reading what has not changed. Tools that are missing turn
    visual and acoustic scans into exact ones.
    """
    mode = media.effective_mode(spec.mode, media.tools())
    if mode != spec.mode:
        spec = ScanSpec(**{**spec.__dict__, "mode": mode})
    options = {"category": spec.category, "exts": list(spec.extensions) or None, "skip_hidden": spec.skip_hidden, "min_size_kb": spec.min_size_kb, "exclude": list(spec.exclude)}
    rows = files_of.walk(spark, list(spec.roots), **options) if files is None else files_of.file_filter(files, **options)
    if files is None and any(h != "md5" for h in mode_hashes(mode, spec.category)):
        rows = media.decoded_images(spark, rows)
    found = with_md5(rows, content, entries, spec.verify_full)
    slim = found.drop(*[f.name for f in found.schema.fields if f.dataType.typeName() == "binary"])
    return ScanResult(spec, members(stored(slim, "fingerprints"), spec))  # what the joins read again and again


def with_md5(rows: DataFrame, content: Column | None, entries: DataFrame | None, verify_full: bool) -> DataFrame:
    """``rows`` with md5, made only for files of a size that another has and that the store doesn't know; null for others."""
    sizes = G.size_gate(rows).select("path", "same_size")
    asked = rows.join(sizes, "path", "left")
    known = store.lookup(asked, entries) if entries is not None else asked.withColumn("cached", F.lit(None).cast("string"))
    need = F.col("same_size").isNotNull() & F.col("cached").isNull()
    threshold = {"threshold": 1 << 62} if verify_full else {}
    if content is not None:
        fresh = known.withColumn("md5", F.when(need, content_hash(content, **threshold)))
    else:
        read = files_of.partial_hash_files(known.filter(need).select("path", "size"), **threshold).select("path", "md5")
        fresh = known.join(read, "path", "left")
    return fresh.withColumn("md5", F.when(F.col("same_size").isNotNull(), F.coalesce("cached", "md5"))).drop("cached", "same_size")


def members(media_rows: DataFrame, spec: ScanSpec) -> DataFrame:
    """Exact groups, and perceptual groups of the decoded files that are in none: gid is the least path of a group."""
    hashes = mode_hashes(spec.mode, spec.category)
    exact = G.exact_members(media_rows).withColumns({"exact": F.lit(True), "algorithm": F.lit("md5"), "similarity": F.lit(1.0)})
    kinds, most = [h for h in hashes if h != "md5"], int(clamped(spec.mode, spec.threshold))
    if not kinds or not most:
        return exact.drop("members")
    left = stored(G.not_in(media_rows.filter("decoded"), exact), "left")  # else each use of it repeats its plan, which the driver holds
    of = connected_components(links(left, kinds, most, spec)).select(F.col("node").alias("id"), F.col("component").alias("part"))
    found = stored(left.join(of, "id"), "alike")
    names = found.groupBy("part").agg(F.min("path").alias("gid"))
    found = found.join(names, "part").drop("part")
    similarity = G.bit_similarity(found, kinds)
    alike = G.ranked(found.join(similarity, "gid")).withColumns({"exact": F.lit(False), "algorithm": F.lit(ALGORITHMS.get(spec.mode, "perceptual"))})
    return exact.drop("members").unionByName(alike)


def links(rows: DataFrame, kinds: list[str], most: int, spec: ScanSpec) -> DataFrame:
    """Links (a, b) of ids: any hash within ``most`` bits; in smart scans as many hashes as ``spec.min_votes``.

    Rows of equal hashes are linked by stars; only distinct hashes are compared.
    """
    if spec.mode != "smart" or spec.min_votes < 2:
        out = None
        for h in kinds:
            one = J.hamming_pairs(rows, most, hash_col=h, forest=True).select("a", "b").unionByName(J.same_hash_links(rows, hash_col=h))
            out = one if out is None else out.unionByName(one)
        return out
    return J.agreeing_links(rows, kinds, most, spec.min_votes)

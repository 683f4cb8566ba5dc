"""Secret scans with corpus-wide ownership frequency.

One pass finds candidates: the base kinds (``assign``, ``access``, ``hex``) and
generic tokens that look random. Values are hashed; a hash's distinct
repositories and owners over the whole corpus tell widely copied examples from
live-looking credentials of one owner: ``example`` if more than ``max_owners``
owners or ``max_repos`` repositories hold it, else ``live``. Base spans stay
whatever the verdict; generic tokens become spans of kind ``live`` if they are
live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, pieces, split_join, stored, unused

# The base patterns, their least lengths, and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex", "live")

#: Generic tokens: this long, with three classes of characters and this many bits of entropy a character.
GENERIC = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
ENTROPY = 3.5
#: What a text must hold, in lower case, for ASSIGN to match.
HINTS = ("passw", "secret", "token", "api")

SPAN = "struct<start:int,ord:int,end:int,hash:string>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, order of kind, end) of the base kinds, leftmost and non-overlapping within a kind."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        # the value's length is tested after matching: a short match still takes its place
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def looks_random(value: str) -> bool:
    classes = (any("a" <= c <= "z" for c in value)) + (any("A" <= c <= "Z" for c in value)) + (any("0" <= c <= "9" for c in value))
    if classes < 3:
        return False
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in Counter(value).values()) >= ENTROPY


def candidates(text: str | None) -> list[tuple[int, int, int, str]]:
    """Base spans and generic random-looking tokens outside them, each with the hash of its value."""
    if not text:
        return []
    spans = base_spans(text)
    taken, at, reach = sorted((s, e) for s, _, e in spans), 0, 0
    for m in GENERIC.finditer(text):
        # both lists are in order: what starts before the token's end is passed once, and its furthest end kept
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= m.start() and looks_random(m[0]):
            spans.append((m.start(), 3, m.end()))
    return [(s, k, e, hashlib.sha256(_value(text[s:e], k).encode()).hexdigest()) for s, k, e in sorted(spans)]


def _value(found: str, kind: int) -> str:
    """What identifies a credential: of an assignment its value alone."""
    return ASSIGN.match(found)[2] if kind == 0 else found


def scan(docs: DataFrame, owner, repo, text: str = "text", max_owners: int = 2, max_repos: int = 4) -> DataFrame:
    """``docs`` with ``spans`` appended: array of (start, end, kind, verdict), by start and then kind.

    owner, repo: Columns over ``docs``. A null text is empty; a null owner or
    repository counts as none. Offsets are code points, ends exclusive. Input
    columns called spans are replaced, all others kept. Repeated rows are
    scanned each. An empty table gives no rows.
    """
    docs = free_names(docs, "spans")
    names = docs.columns
    own, rep, rid, hits, every = unused(docs, "owner_", "repo_", "row_", "found_", "every_")
    with_keys = docs.withColumns({own: owner.cast("string"), rep: repo.cast("string")})
    at = names.index(text)

    def run(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("ord", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]))
        for batch in pieces(batches):
            found = [[dict(zip(("start", "ord", "end", "hash"), c, strict=True)) for c in candidates(t)] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, hits])

    schema = T.StructType([*with_keys.schema.fields, T.StructField(hits, T.ArrayType(T._parse_datatype_string(SPAN)))])
    rows = stored(with_keys.mapInArrow(run, schema).withColumn(rid, F.monotonically_increasing_id()), "candidates")
    one = rows.select(F.col(rid).alias("row"), F.col(own).alias("owner"), F.col(rep).alias("repo"), F.explode(hits).alias("c")).select("row", "owner", "repo", "c.start", "c.ord", "c.end", "c.hash")
    # each step sums what a task has before it shuffles: a value in a third of all rows is a few rows here
    places = one.groupBy("hash", "owner", "repo").agg(F.count("*").alias("k"))
    spread = places.groupBy("hash").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repo").alias("repos"), F.sum("k").alias("size"))
    verdict = F.when((F.col("owners") > max_owners) | (F.col("repos") > max_repos), "example").otherwise("live")
    # widely copied values are judged where they lie; only the others' rows are shuffled
    verdicts = stored(spread.select("hash", "size", verdict.alias("verdict")), "verdicts")
    total = verdicts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    judged = split_join(one.drop("owner", "repo"), verdicts, "hash", total).filter("ord < 3 or verdict = 'live'")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("ord") + 1)
    span = F.struct("start", "ord", "end", kind.alias("kind"), "verdict")
    by_row = judged.groupBy(F.col("row").alias(rid)).agg(F.array_sort(F.collect_list(span)).alias("all_spans_"))
    # in a struct, as a column of the table may have any name
    by_row = by_row.select(rid, F.struct("all_spans_").alias(every))
    all_spans = F.col(every)["all_spans_"]
    slim = F.transform(all_spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["verdict"].alias("verdict")))
    empty = F.array().cast("array<struct<start:int,end:int,kind:string,verdict:string>>")
    columns = [F.col(f"`{c}`") for c in names]
    # rows without candidates, nearly all, aren't shuffled
    without = rows.filter(F.size(hits) == 0).select(*columns, empty.alias("spans"))
    having = rows.filter(F.size(hits) > 0).join(by_row, rid, "left").select(*columns, F.coalesce(slim, empty).alias("spans"))
    return without.unionByName(having)


def redact(scanned: DataFrame, text: str = "text") -> DataFrame:
    """Replace the spans that aren't widely copied examples by [kind]; the columns of the scanned table."""
    names = [c for c in scanned.columns if c != "spans"]
    at, span_at = scanned.columns.index(text), scanned.columns.index("spans")

    def run(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            out = []
            for t, spans in zip(batch.column(at).to_pylist(), batch.column(span_at).to_pylist(), strict=True):
                done, parts = 0, []
                for s in spans:
                    if s["verdict"] == "live" and s["end"] > done:
                        parts += [t[done : max(done, s["start"])], f"[{s['kind']}]"] if s["start"] >= done else []
                        done = s["end"]
                out.append(t if not done else "".join(parts) + t[done:])
            columns = [pa.array(out, pa.string()) if i == at else c for i, c in enumerate(batch.columns) if i != span_at]
            yield pa.RecordBatch.from_arrays(columns, names)

    live = F.exists("spans", lambda s: s["verdict"] == "live")
    changed = scanned.filter(live).mapInArrow(run, T.StructType([f for f in scanned.schema.fields if f.name != "spans"]))
    return scanned.filter(~live).drop("spans").unionByName(changed)

"""Packing documents into training sequences by shortest-pack-first over a length histogram.

1. Every document is tokenized once; its ids and length are stored.
2. Only the histogram of tail lengths (at most ``cap`` numbers, whatever the
   corpus) goes to the driver, which places lengths longest first, each into
   the shortest pack that has room, updating counts of packing patterns.
3. Pieces get a rank within their length (per stored part, plus offsets), and
   a rank says which pattern's which copy and which place a piece takes.

Documents are cut at multiples of ``cap``; a tail is cut further, at the
coarsest of ``cuts`` that leaves at most ``slack`` of all tokens as padding.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import json_encoder
from .common import pieces as small_batches
from .common import stored

TOKENS = "part long, ord long, doc_id long, n long, ids binary"


def tokenized(docs: DataFrame, path: str, end_id: int, key: str, text: str) -> DataFrame:
    """Rows (part, ord, key, n, ids): little-endian unsigned 32-bit ids with the end id; null text is empty."""

    def run(batches):
        import pyarrow as pa

        encoder, end = json_encoder(path), np.asarray([end_id], "<u4").tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for batch in small_batches(batches):
            ids = [encoder(t or "").astype("<u4", copy=False).tobytes() + end for t in batch.column(1).to_pylist()]
            n = len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * n, pa.int64()), pa.array(range(at, at + n), pa.int64()), batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                ["part", "ord", "doc_id", "n", "ids"],
            )
            at += n

    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, TOKENS)


def shortest_pack_first(histogram: dict[int, int], cap: int) -> list[tuple[tuple[int, ...], int]]:
    """Packing patterns (lengths of one sequence) and their counts.

    Lengths go longest first into the packs with most room; where none has
    room, new packs take as many of that length as fit, as placing one by one
    would.
    """
    by_room: dict[int, list[list]] = defaultdict(list)
    rooms: set[int] = set()

    def put(pattern, count):
        if count:
            room = cap - sum(pattern)
            by_room[room].append([pattern, count])
            rooms.add(room)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max(rooms, default=-1)
            if room < length:
                each = cap // length
                put((length,) * each, left // each)
                put((length,) * (left % each), int(left % each > 0))
                break
            pattern, count = by_room[room].pop()
            if not by_room[room]:
                rooms.discard(room)
            # one by one, a pack stays the shortest until its room is no more the largest
            taken = min(count, left)
            put(pattern, count - taken)
            put((*pattern, length), taken)
            left -= taken
    return sorted(((p, n) for groups in by_room.values() for p, n in groups), reverse=True)


def padding(patterns, cap: int) -> int:
    """Tokens of padding: to ``cap``, except that a power of two needs none."""
    return sum(n * (cap - size) for p, n in patterns if (size := sum(p)) & (size - 1))


def cut_histogram(tails: dict[int, int], full: int, cap: int, cut: int) -> dict[int, int]:
    """Counts of piece lengths: whole sequences, and each tail in pieces of ``cut`` and a rest."""
    out = defaultdict(int, {cap: full} if full else {})
    for tail, n in tails.items():
        if tail // cut:
            out[cut] += n * (tail // cut)
        if tail % cut:
            out[tail % cut] += n
    return dict(out)


def choose(tails: dict[int, int], full: int, cap: int, cuts, slack: float) -> tuple[int, list]:
    """The coarsest cut whose patterns waste at most ``slack`` of the tokens, else the best."""
    total = full * cap + sum(t * n for t, n in tails.items())
    best = None
    for cut in cuts:
        patterns = shortest_pack_first(cut_histogram(tails, full, cap, cut), cap)
        waste = padding(patterns, cap)
        if best is None or waste < best[0]:
            best = waste, cut, patterns
        if waste <= slack * total:
            break
    return best[1], best[2]


def slots(patterns) -> dict[str, np.ndarray]:
    """Per run of ranks of one length: its first rank, first sequence and offset, sorted by (length, rank)."""
    ranks: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for pattern, count in patterns:
        at = 0
        for length in pattern:
            rows.append((length, ranks[length], sequence, at))
            ranks[length] += count
            at += length
        sequence += count
    rows.sort()
    cols = np.asarray(rows, np.int64).reshape(-1, 4).T
    return {"key": (cols[0] << 44) + cols[1], "sequence": cols[2], "offset": cols[3]}


def pack(docs: DataFrame, path: str, end_id: int = 1, cap: int = 2048, key: str = "doc_id", text: str = "text",
         cuts=(2048, 1024, 512, 256, 128), slack: float = 0.003, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (binary).

    Null or empty texts give one piece, the end id. Repeated rows are packed
    each; columns besides key and text are not read. An empty table gives no rows.
    """
    tokens = stored(tokenized(docs, path, end_id, key, text), "tokens")
    tail = F.col("n") % cap
    rows = tokens.groupBy(tail.alias("tail")).agg(F.count("*").alias("k"), F.sum(F.floor(F.col("n") / cap)).alias("full")).collect()  # at most cap rows
    tails, full = {r.tail: r.k for r in rows if r.tail}, sum(int(r.full) for r in rows)
    cut, patterns = choose(tails, full, cap, cuts, slack)
    places = slots(patterns)

    def cut_up(batches):
        import pyarrow as pa

        for batch in small_batches(batches):
            out = []
            for part, at, doc, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tail_at = n - n % cap
                starts = [*range(0, tail_at, cap), *range(tail_at, n, cut)]
                for lo, hi in zip(starts, [*starts[1:], n], strict=True):
                    raw = ids[4 * lo : 4 * hi]
                    out.append((part, at, doc, lo, hi - lo, zlib.crc32(raw), n, raw if with_ids else None))
            kinds = [pa.int64()] * 7 + [pa.binary()]
            names = ["part", "ord", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [()] * 8, kinds, strict=True)], names)

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            key_ = (length.astype(np.int64) << 44) + rank
            i = np.searchsorted(places["key"], key_, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(places["sequence"][i] + key_ - places["key"][i]), pa.array(places["offset"][i])],
                [*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    # ranks: within (length, part), whose size is bounded by a part of the input, plus what earlier parts hold
    lengths = F.concat(F.array_repeat(F.lit(cap), F.floor(F.col("n") / cap).cast("int")), F.array_repeat(F.lit(cut), F.floor(tail / cut).cast("int")), F.when(tail % cut > 0, F.array((tail % cut).cast("int"))).otherwise(F.array().cast("array<int>")))
    counts = tokens.select("part", F.explode(lengths).alias("length")).groupBy("length", "part").agg(F.count("*").alias("k"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("length").cast("long").alias("length"), "part", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("base"))
    cut_pieces = tokens.mapInArrow(cut_up, "part long, ord long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary")
    if not with_ids:
        cut_pieces = cut_pieces.drop("ids")
    within = F.row_number().over(Window.partitionBy("length", "part").orderBy("ord", "start")) - 1
    ranked = cut_pieces.withColumn("within", within).join(offsets, ["length", "part"]).withColumn("rank", F.col("within") + F.col("base"))
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + (["ids"] if with_ids else [])
    kinds = ", ".join(f"{c} {'binary' if c == 'ids' else 'long'}" for c in [*keep, "sequence_id", "offset"])
    return ranked.select(*keep, "rank").mapInArrow(place, kinds)

"""Nearest neighbours with learned partitions.

1. Fit, on at most ``sample`` vectors chosen by hash: their exact neighbour
   graph is cut into balanced parts by recursive spectral bisection, and a
   small classifier learns which parts hold a vector's neighbours.
2. Every vector goes to its most probable part; a query goes to the several
   most probable parts. How many is measured on the sample: the fewest that
   find ``recall`` of its true neighbours.
3. Parts are searched in blocks of bounded size, with exact distances in double
   precision, and the blocks' best are merged.

What is collected or broadcast is bounded by ``sample`` and ``parts``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, stored


def neighbours(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest other rows of each row."""
    out, square = [], (x * x).sum(1)
    for lo in range(0, len(x), 512):
        d = square[lo : lo + 512, None] - 2 * x[lo : lo + 512] @ x.T + square
        d[np.arange(len(d)), lo + np.arange(len(d))] = np.inf
        out.append(np.argpartition(d, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def balanced_parts(graph: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """Parts 0..parts-1 of equal sizes (parts: a power of two), cutting few edges of the neighbour graph."""
    rng = np.random.default_rng(seed)
    part = np.zeros(len(graph), np.int64)
    k = graph.shape[1]
    for _ in range(parts.bit_length() - 1):
        split = np.zeros(len(graph), np.int64)
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            place = np.full(len(graph), -1)
            place[own] = np.arange(len(own))
            a, b = np.repeat(np.arange(len(own)), k), place[graph[own].ravel()]
            a, b = a[b >= 0], b[b >= 0]
            degree = np.bincount(a, minlength=len(own)) + np.bincount(b, minlength=len(own)) + 1e-9
            v = rng.standard_normal(len(own))
            for _ in range(60):  # power iteration towards the second vector of the random walk
                v = v - (v * degree).sum() / degree.sum()
                v = 0.5 * v + 0.5 * (np.bincount(a, v[b], len(own)) + np.bincount(b, v[a], len(own))) / degree
                v /= np.abs(v).max() + 1e-300
            side = np.zeros(len(own), np.int64)
            side[np.argsort(v, kind="stable")[len(own) // 2 :]] = 1
            for _ in range(4):  # swap equally many of the worst placed of both sides
                gain = (np.bincount(a, side[b], len(own)) + np.bincount(b, side[a], len(own))) * 2 - degree
                gain = np.where(side == 1, -gain, gain)
                one, two = (own_side[np.argsort(-gain[own_side], kind="stable")] for own_side in (np.flatnonzero(side == 0), np.flatnonzero(side == 1)))
                m = min(len(one), len(two))
                better = int((gain[one[:m]] + gain[two[:m]] > 0).sum()) // 2
                side[one[:better]], side[two[:better]] = 1, 0
            split[own] = side
        part = 2 * part + split
    return part


@dataclass
class Router:
    """A classifier of one hidden layer."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    scale: float
    probes: int = 1

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x * self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def train_router(x: np.ndarray, target: np.ndarray, hidden: int = 64, steps: int = 300, seed: int = 5) -> Router:
    """Softmax regression behind one hidden layer on soft targets, by Adam in batches."""
    rng = np.random.default_rng(seed)
    scale = 1 / (np.sqrt((x * x).mean()) + 1e-12)
    p = [rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden), rng.standard_normal((hidden, target.shape[1])) / np.sqrt(hidden), np.zeros(target.shape[1])]
    m, v = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
    for t in range(1, steps + 1):
        i = rng.integers(0, len(x), 256)
        a, y = x[i] * scale, target[i]
        h = np.maximum(a @ p[0] + p[1], 0)
        z = h @ p[2] + p[3]
        e = np.exp(z - z.max(1, keepdims=True))
        d = (e / e.sum(1, keepdims=True) - y) / len(i)
        back = (d @ p[2].T) * (h > 0)
        for j, g in enumerate((a.T @ back, back.sum(0), h.T @ d, d.sum(0))):
            m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
            p[j] -= 0.005 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
    return Router(*p, scale)


def fit(x: np.ndarray, k: int, parts: int, recall: float, seed: int = 5) -> Router:
    k = min(k, len(x) - 1)
    if k < 1 or parts < 2:
        return Router(np.zeros((x.shape[1], 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1.0)
    graph = neighbours(x, k)
    part = balanced_parts(graph, parts, seed)
    near = np.zeros((len(x), parts))
    np.add.at(near, (np.repeat(np.arange(len(x)), k), part[graph].ravel()), 1 / (k + 1))
    near[np.arange(len(x)), part] += 1 / (k + 1)
    router = train_router(x, near, seed=seed)
    z = router.logits(x)
    order = np.argsort(-z, axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None].repeat(len(x), 0), 1)
    # the rank, for a query, of the part to which each of its true neighbours goes
    needed = np.sort(np.take_along_axis(rank, order[:, 0][graph], 1).ravel())
    router.probes = min(parts, 1 + int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]))
    return router


def search(vectors: DataFrame, is_query, key: str = "vec_id", vector: str = "embedding", k: int = 10, sample: int = 4096,
           parts: int = 16, recall: float = 0.97, block: int = 8192, query_block: int = 1024) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k nearest other rows found, by Euclidean distance, ties to smaller ids.

    Vectors that are null, zero, of another length than most, or hold null or
    non-finite components take no part, nor do rows with a null id. Equal
    vectors are all found. Rows of one id are one neighbour, and one query, by
    the least distance of their vectors. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    good = F.col(vector).isNotNull() & F.exists(vector, lambda v: v != 0) & F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias(vector)).filter(F.col("vec_id").isNotNull() & good)
    size = rows.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), "size").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.filter(F.size(vector) == size["size"])
    total = size["count"]
    chance = min(1.0, 1.3 * sample / total)
    hashed = F.xxhash64(F.lit(3), "vec_id")
    few = rows.filter(hashed.cast("double") <= -(2.0**63) + chance * 2.0**64).orderBy(hashed, "vec_id").limit(sample).select(vector).collect()
    x = np.array([r[0] for r in few], np.float64)
    while parts > 1 and len(x) < 8 * parts:
        parts //= 2
    router = spark.sparkContext.broadcast(fit(x, k, parts, recall))

    def route(batches):
        import pyarrow as pa

        r = router.value
        for batch in pieces(batches, 2048):
            z = r.logits(np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1))
            best = np.argsort(-z, axis=1, kind="stable")[:, : r.probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(best), pa.list_(pa.int32()))], ["vec_id", "x", "parts"])

    routed = stored(rows.select("vec_id", F.col(vector).alias("x")).mapInArrow(route, "vec_id long, x array<double>, parts array<int>"), "routed")
    held = routed.select("vec_id", "x", F.col("parts")[0].alias("part"))
    asked = routed.filter(is_query(F.col("vec_id"))).select(F.col("vec_id").alias("query_id"), "x", F.explode("parts").alias("part"))
    blocks = held.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("cs"))
    query_blocks = asked.groupBy("part").agg(F.ceil(F.count("*") / query_block).cast("int").alias("qs"))
    plan = F.broadcast(blocks.join(query_blocks, "part"))  # at most ``parts`` rows
    salt = lambda c, n: F.pmod(F.xxhash64(F.lit(9), c), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    c = held.join(plan, "part").withColumn("cb", salt("vec_id", "cs")).withColumn("qb", spread("qs")).select("part", "cb", "qb", "vec_id", "x")
    q = asked.join(plan, "part").withColumn("qb", salt("query_id", "qs")).withColumn("cb", spread("cs")).select(*[F.col(n).alias(f"q_{n}") for n in ("part", "cb", "qb")], "query_id", F.col("x").alias("q_x"))
    names = ["part", "cb", "qb"]
    found = q.groupBy(*[f"q_{n}" for n in names]).cogroup(c.groupBy(*names)).applyInArrow(nearest(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(k: int):
    """The k nearest of a block of candidates for each query of a block."""

    def run(queries, held):
        import pyarrow as pa

        empty = pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not queries.num_rows or not held.num_rows:
            return empty
        ids, asked = held["vec_id"].to_numpy(), queries["query_id"].to_numpy()
        y = np.asarray(held["x"].combine_chunks().flatten()).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        ids, y = ids[order], y[order]
        heads = np.flatnonzero(np.diff(ids, prepend=ids[0] - 1))  # the first row of each id
        x = np.asarray(queries["q_x"].combine_chunks().flatten()).reshape(len(asked), -1)
        square = (y * y).sum(1)
        out: tuple[list, list, list] = ([], [], [])
        for lo in range(0, len(x), 64):
            rough = (x[lo : lo + 64] ** 2).sum(1)[:, None] - 2 * x[lo : lo + 64] @ y.T + square
            rough[asked[lo : lo + 64, None] == ids] = np.inf
            by_id = rough if len(heads) == len(ids) else np.minimum.reduceat(rough, heads, axis=1)
            cut = np.partition(by_id, min(k, len(heads)) - 1, axis=1)[:, min(k, len(heads)) - 1]
            # products round off: all within that error of the k-th are measured exactly
            error = 1e-9 * (square.max() + (x[lo : lo + 64] ** 2).sum(1))
            for i, (row, c) in enumerate(zip(rough, cut + error, strict=True), lo):
                some = np.flatnonzero((row <= c) & np.isfinite(row))
                d = np.sqrt(((y[some] - x[i]) ** 2).sum(1))
                first = np.lexsort((ids[some], d))
                first = first[np.sort(np.unique(ids[some][first], return_index=True)[1])][:k]  # an id's nearest row only
                out[0].append(np.full(len(first), asked[i]))
                out[1].append(ids[some[first]])
                out[2].append(d[first])
        return pa.table({n: pa.array(np.concatenate(v)) for n, v in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return run

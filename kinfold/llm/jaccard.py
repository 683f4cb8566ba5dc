"""Exact self-join of shingle sets by Jaccard similarity, size-aware.

Two sets link when 100 |A and B| >= percent |A or B|. Linked sets of sizes up
to L differ in at most k(L) elements, which gives candidates by size class:

* small sets (light): all subsets that lack at most k elements are enumerated;
  linked sets share their intersection among them;
* large sets (heavy): the hash range is cut into n > k segments; linked sets
  agree wholly in n - k of them, so each set posts its fuller segments (it may
  leave out n - k - 1) to inverted lists, which are scanned.

The boundary is set by cost: subsets are enumerated while a set of the class
has at most ``cost`` of them per element. A set near the end of its size class
posts to the next class too, so that no pair across a boundary is lost.

Texts of the same words are one class from the start, whose least document
stands for it. Lists of the same documents are one list. Lists are not expanded
into pairs: in each round every document is compared with one pivot of its
lists, links join components, and only lists that still mix components go on.
If those are long, their documents post again, large sets now in lists of single
shingles: the 100 - percent hundredths that are rarest among them (counted by
hash in ``PLACES`` places), and one more. Linked sets share one of these,
whatever the order, and a passage that many share is posted only by documents
of little else. What is left after the rounds is compared pair by pair: as rows
in short lists; in longer ones over blocks of a list. Where more than one a
document may link in a block, no pair becomes a row: the block gives a forest of
those that may, whose trees over all blocks are lists without a document in
common, and each of these is compared as a whole. Sketches, bitmaps of one to two bits an item that were made with the
postings, travel first and rule out what differs too much, so that texts go only
where they may link. So every linked pair of sets ends up in one
component, at about one comparison per set for groups of near copies.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from .common import discard, pieces, release, split_join, stored, trim

WORDS_KEPT = 100_000
#: Places in which shingles are counted by hash: their rarity, at most this many numbers whatever the corpus.
PLACES_LOG = 20
PLACES = 1 << PLACES_LOG
POSTED = "id long, node long, n long, sigs array<long>, sketch binary"


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z only, ASCII white space only


def name_of(words: list[bytes]) -> int:
    """The class of a text: a 64-bit hash of its words in order; -1 without words."""
    import xxhash

    return xxhash.xxh3_64_intdigest(b" ".join(words)) >> 1 if words else -1


class Shingler:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""

    def __init__(self, width: int):
        import xxhash

        self.width, self.hash, self.words = width, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        return self.of(words_of(text))

    def of(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.zeros(0, np.uint64)
        got = list(map(self.words.get, words))
        if None in got:
            if len(self.words) > WORDS_KEPT:
                self.words.clear()
            for i, h in enumerate(got):
                if h is None:
                    got[i] = self.words[words[i]] = self.hash(words[i])
        h = np.array(got, np.uint64)
        width = min(self.width, len(h))
        out = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
        return np.unique(out)


def place_of(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(64 - PLACES_LOG)).astype(np.int64)


def sketch(items: np.ndarray) -> bytes:
    """Bitmap of one to two bits an item: whether a place, the low bits of a hash, holds an odd number of items.

    Two sketches, the larger folded to the other's size, differ in no more places than the sets in items.
    """
    log = max(6, int(len(items) - 1).bit_length())
    odd = np.bincount((items & np.uint64((1 << log) - 1)).astype(np.int64), minlength=1 << log) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Rows of 64-bit words as sketches of so many words."""
    while maps.shape[1] > words:
        half = maps.shape[1] // 2
        maps = maps[:, :half] ^ maps[:, half:]
    return maps


def maps_of(column) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Words of each sketch of an Arrow column, and by their number the rows and their matrix."""
    sketches = column.to_pylist()
    words = np.array([len(x) // 8 for x in sketches], np.int64)
    by = {}
    for w in np.unique(words).tolist():
        at = np.flatnonzero(words == w)
        by[w] = at, np.frombuffer(b"".join(sketches[i] for i in at), np.uint64).reshape(-1, w)
    return words, by


class Signatures:
    """Signatures of sets, such that two different linked sets share one."""

    def __init__(self, percent: int, weight: np.ndarray | None = None, cost: int = 10, step: float = 1.4):
        """weight: how common the elements of each place are, if large sets are to post single elements; the same for all sets that are to meet."""
        self.percent, self.weight, self.cost, self.step = percent, weight, cost, step
        self.ends = [1]
        self.plans: dict[int, tuple[int, bool]] = {}

    def differ(self, size: int) -> int:
        """Elements in which linked sets of at most this size can differ."""
        return 2 * size * (100 - self.percent) // (100 + self.percent)

    def posted(self, size: int) -> int:
        """Elements of a large set that are posted: it shares at least percent of its own with any linked set."""
        return size * (100 - self.percent) // 100 + 1

    def classes(self, size: int) -> list[int]:
        """The size class of a set, and the next if a larger set of that may link."""
        while self.ends[-1] < size or len(self.ends) < 2 or self.ends[-2] < size:
            self.ends.append(max(self.ends[-1] + 1, int(self.ends[-1] * self.step)))
        i = bisect_left(self.ends, size)
        return [i, i + 1] if self.percent * (self.ends[i] + 1) <= 100 * size else [i]

    def light(self, end: int) -> bool:
        """Whether sets of a class enumerate subsets."""
        subsets = 0
        for j in range(self.differ(end) + 1):
            subsets += comb(end, j)
            if subsets > self.cost * end:
                return False
        return True

    def __call__(self, items: np.ndarray) -> np.ndarray:
        out = [self._of(items, i) for i in self.classes(len(items))] if len(items) else []
        return np.unique(np.concatenate(out)).astype(np.int64) if out else np.zeros(0, np.int64)

    def _of(self, items: np.ndarray, i: int) -> np.ndarray:
        if i not in self.plans:
            self.plans[i] = self.differ(self.ends[i]), self.light(self.ends[i])
        (k, light), salt = self.plans[i], np.uint64(i * 0xD6E8FEB86659FD93 % (1 << 64))
        if light:
            weight = mix(items + salt)
            total = weight.sum(keepdims=True, dtype=np.uint64)
            gone = [list(c) for size in range(1, min(k, len(items) - 1) + 1) for c in combinations(range(len(items)), size)]
            lacking = [total, *(total - weight[np.array([c for c in gone if len(c) == size])].sum(1, dtype=np.uint64) for size in {len(c) for c in gone})]
            return mix(np.concatenate(lacking))
        if self.weight is not None:
            # rarest first; items are sorted, so ties are in the order of their hashes
            return mix(items[np.argsort(self.weight[place_of(items)], kind="stable")[: self.posted(len(items))]])
        n = -(-3 * (k + 1) // 2)
        # items are sorted, and so are their segments
        width = np.uint64((1 << 64) // n + 1)
        segment = items // width
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        count = np.zeros(n, np.int64)
        content = np.zeros(n, np.uint64)
        at = segment[starts].astype(np.int64)
        content[at] = np.add.reduceat(mix(items + salt), starts)
        count[at] = np.diff(np.r_[starts, len(items)])
        least = np.sort(count)[n - k - 1]  # at most n - k - 1 segments are smaller
        chosen = np.flatnonzero(count >= least)
        return mix(content[chosen] + mix(chosen.astype(np.uint64) + salt))


class Rarity:
    """Counts of shingles by place in one task."""

    def __init__(self, kept: int):
        self.counts, self.kept, self.waiting, self.held = np.zeros(PLACES, np.int64), kept, [], 0

    def add(self, items: np.ndarray) -> None:
        self.waiting.append(place_of(items))
        self.held += len(items)
        if self.held >= 1 << 20:
            self._count()

    def _count(self) -> None:
        if self.waiting:
            self.counts += np.bincount(np.concatenate(self.waiting), minlength=PLACES)
        self.waiting, self.held = [], 0

    def common(self) -> tuple[np.ndarray, np.ndarray]:
        """The ``kept`` places that hold most, of those that hold two or more, and their counts."""
        self._count()
        best = np.argpartition(self.counts, PLACES - self.kept)[PLACES - self.kept :]
        best = best[self.counts[best] > 1]
        return best, self.counts[best]


def classes_of(batches):
    """mapInArrow function: (doc_id, text) to (doc_id, node), the class of the text."""
    import pyarrow as pa

    for batch in pieces(batches):
        nodes = [name_of(words_of(t)) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64())], ["doc_id", "node"])


def common_places(width: int, kept: int):
    """mapInArrow function: texts to (place, k), the ``kept`` places that most of a task's shingles fall into."""

    def run(batches):
        import pyarrow as pa

        shingles, rarity = Shingler(width), Rarity(kept)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                rarity.add(shingles(text))
        place, k = rarity.common()
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), pa.array(k, pa.int64())], ["place", "k"])
        del shingles, rarity
        trim()

    return run


def rarity_of(texts: DataFrame, width: int, kept: int) -> np.ndarray:
    """How often the shingles of each place occur, from the tasks' common ones; 0 for the others."""
    got = texts.select("text").mapInArrow(common_places(width, kept), "place int, k long").groupBy("place").agg(F.sum("k").alias("k")).filter("k >= 4").toPandas()  # at most PLACES rows
    out = np.zeros(PLACES, np.int32)
    out[got["place"].to_numpy(np.int64)] = np.minimum(got["k"].to_numpy(np.int64), 2**31 - 1)
    return out


def post(width: int, percent: int, shared=None):
    """mapInArrow function: (id, node, text) to POSTED, once a class and task; a text that isn't of the class gives nothing.
    A null node is the text's class.

    shared: a broadcast of ``rarity_of``, if large sets are to post single elements.
    """

    def run(batches):
        import pyarrow as pa

        shingles, signatures, seen = Shingler(width), Signatures(percent, shared and shared.value), set()
        for batch in pieces(batches):
            rows = []
            for i, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(text)
                node = name_of(words) if node is None else node
                if node not in seen and name_of(words) == node:
                    seen.add(node)
                    items = shingles.of(words)
                    rows.append((i, node, len(items), signatures(items), sketch(items)))
            ids, nodes, n, sigs, sketches = zip(*rows, strict=True) if rows else ((), (), (), (), ())
            offsets = np.cumsum([0, *map(len, sigs)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sigs) if sigs else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nodes, pa.int64()), pa.array(n, pa.int64()), lists, pa.array(sketches, pa.binary())], ["id", "node", "n", "sigs", "sketch"])
        shingles = signatures = seen = None
        trim()

    return run


def compare(width: int, percent: int):
    """mapInArrow function: (a, b, text of a, text of b) to the linked (a, b), compared exactly."""

    def run(batches):
        import pyarrow as pa

        shingles = Shingler(width)
        last: tuple = (None, None)
        for batch in pieces(batches):
            hit = []
            for _, b, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last[0] != b:
                    last = (b, shingles(y))
                one, other = shingles(x), last[1]
                both = len(np.intersect1d(one, other, assume_unique=True))
                hit.append(100 * both >= percent * (len(one) + len(other) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))
        shingles = last = None
        trim()

    return run


def alike(percent: int):
    """mapInArrow function: (a, b, n and sketch of a, n and sketch of b) to the (a, b) whose sketches let them link."""

    def run(batches):
        import pyarrow as pa

        for batch in pieces(batches, 1024):
            n, n2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 4))
            (words, one), (words2, other) = maps_of(batch.column(3)), maps_of(batch.column(5))
            hit = np.zeros(batch.num_rows, bool)
            for w, (at, maps) in one.items():
                for w2, (at2, maps2) in other.items():
                    rows = np.flatnonzero((words == w) & (words2 == w2))
                    x, y = maps[np.searchsorted(at, rows)], maps2[np.searchsorted(at2, rows)]
                    differ = np.bitwise_count(folded(x, min(w, w2)) ^ folded(y, min(w, w2))).sum(1, dtype=np.int64)
                    hit[rows] = differ * (100 + percent) <= (n[rows] + n2[rows]) * (100 - percent)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(hit))

    return run


def close(percent: int, many: int = 64):
    """applyInArrow function: a group's (name, x, y, id, comp, n, sketch) to pairs (a, b) of two components that may link;
    of a group with more than ``many`` a row only its (name, x, y), with null ids.
    """

    def run(table):
        import pyarrow as pa

        def out(a, b, keys=()):
            of = [pa.array([k] * len(a), kind) for k, kind in zip(keys or (None,) * 3, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
            return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), *of], ["a", "b", "name", "x", "y"])

        table = table.combine_chunks()
        ids, comp, n = (table[c].to_numpy() for c in ("id", "comp", "n"))
        if (comp == comp[0]).all():
            return out([], [])
        _, by = maps_of(table["sketch"])
        first, second, held = [], [], 0
        for w, (rows, maps) in by.items():
            for w2, (rows2, maps2) in by.items():
                if w > w2 or w2 > w and w2 * percent >= 200 * w:
                    continue  # done the other way round, or sets too different in size
                maps2 = folded(maps2, w)
                for k in range(len(rows)):
                    i = rows[k]
                    differ = np.bitwise_count(maps2 ^ maps[k]).sum(1, dtype=np.int64)
                    ok = (differ * (100 + percent) <= (n[rows2] + n[i]) * (100 - percent)) & (comp[rows2] != comp[i])
                    js = rows2[ok & (rows2 > i)] if w == w2 else rows2[ok]
                    first.append(np.full(len(js), ids[i]))
                    second.append(ids[js])
                    held += len(js)
                if held > many * len(ids):
                    return out([None], [None], [table[c][0].as_py() for c in ("name", "x", "y")])
        a, b = np.concatenate(first), np.concatenate(second)
        return out(np.minimum(a, b), np.maximum(a, b))

    return run


def reach(percent: int):
    """applyInArrow function: a group's (id, comp, n, sketch) to pairs (a, b) of rows that may link, less than one a row:
    over them each row reaches all rows of other components that it may link with, and what these reach.
    """

    def run(table):
        import pyarrow as pa

        table = table.combine_chunks()
        ids, comp, n = (table[c].to_numpy() for c in ("id", "comp", "n"))
        words, by = maps_of(table["sketch"])
        met = [(w, w2, min(w, w2)) for w in by for w2 in by if max(w, w2) * percent < 200 * min(w, w2)]  # others are too different in size
        views = {(w, low): folded(by[w][1], low) for pair in met for w, low in ((pair[0], pair[2]), (pair[1], pair[2]))}
        place = np.empty(len(ids), np.int64)
        for rows, maps in by.values():
            place[rows] = np.arange(len(maps))
        left = {w: np.arange(len(rows)) for w, (rows, _) in by.items()}  # not reached yet
        first, second, seen = [], [], np.zeros(len(ids), bool)
        for start in range(len(ids)):
            if seen[start]:
                continue
            seen[start], ahead = True, [start]
            while ahead:
                i = ahead.pop()
                for w, w2, low in met:
                    if w != words[i]:
                        continue
                    at = left[w2] = left[w2][~seen[by[w2][0][left[w2]]]]
                    rows = by[w2][0][at]
                    differ = np.bitwise_count(views[w2, low][at] ^ views[w, low][place[i]]).sum(1, dtype=np.int64)
                    js = rows[(differ * (100 + percent) <= (n[rows] + n[i]) * (100 - percent)) & (comp[rows] != comp[i])]
                    seen[js] = True
                    ahead += js.tolist()
                    first.append(np.full(len(js), ids[i]))
                    second.append(ids[js])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (first, second))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def within(width: int, percent: int):
    """applyInArrow function: a group's (id, comp, text) to links (a, b) that join its components, all pairs compared exactly."""

    def run(table):
        import pyarrow as pa

        shingles = Shingler(width)
        ids, comp = table["id"].to_pylist(), table["comp"].to_pylist()
        first = max(set(comp), key=comp.count) if len(ids) <= 4096 else None
        if all(c == first for c in comp):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        sets = [shingles(t) for t in table["text"].to_pylist()]
        rest = np.array([i for i, c in enumerate(comp) if c != first])  # pairs within the largest component have nothing to join
        n = np.array([*map(len, sets)])
        near = [np.flatnonzero(ok) for ok in may_link(sets, n, rest, percent)]
        links, top = [], {c: c for c in comp}

        def root(c):
            while top[c] != c:
                top[c] = top[top[c]]
                c = top[c]
            return c

        if sum(map(len, near)) > 64 * len(sets):
            near = [np.flatnonzero(ok) for ok in do_link(sets, n, rest, percent)]
            linked = lambda i, j: True
        else:

            def linked(i, j):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                return 100 * both >= percent * (n[i] + n[j] - both)

        for i, others in zip(rest.tolist(), near, strict=True):
            for j in others.tolist():
                if (x := root(comp[i])) != (y := root(comp[j])) and linked(i, j):
                    top[x] = y
                    links.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def may_link(sets: list[np.ndarray], n: np.ndarray, rest: np.ndarray, percent: int):
    """For each of ``rest``, which sets it may link with: none is missed.

    A set's bitmap has, at each place, whether it holds an odd number of items
    hashed there; two bitmaps differ in no more places than the sets in items.
    """
    log = min(16, max(8, int(2 * n.max(initial=1) - 1).bit_length()))
    owner = np.repeat(np.arange(len(sets)), n) << log
    odd = np.bincount(owner + (np.concatenate(sets) >> np.uint64(64 - log)).astype(np.int64), minlength=len(sets) << log) & 1
    maps = np.packbits(odd.astype(np.uint8)).reshape(len(sets), -1).view(np.uint64)
    for i in rest:
        differ = np.bitwise_count(maps ^ maps[i]).sum(1, dtype=np.int64)
        yield differ * (100 + percent) <= (n + n[i]) * (100 - percent)


def do_link(sets: list[np.ndarray], n: np.ndarray, rest: np.ndarray, percent: int):
    """For each of ``rest``, which sets it links with, by products of presence matrices over blocks of items."""
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    column = np.cumsum(np.r_[0, flat[1:] != flat[:-1]])
    shared = np.bincount(column)[column] > 1  # items of one set alone are in no intersection
    column, owner = np.cumsum(np.r_[True, np.diff(column[shared]) > 0][: shared.sum()]) - 1, owner[shared]
    both = np.zeros((len(rest), len(sets)), np.float32)
    for lo in range(0, column[-1] + 1 if len(column) else 0, 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        has = np.zeros((len(sets), min(4096, int(column[-1]) + 1 - lo)), np.float32)
        has[owner[i:j], column[i:j] - lo] = 1
        both += has[rest] @ has.T
    return 100 * both.astype(np.int64) >= percent * (n[rest, None] + n - both.astype(np.int64))


def blocks_of(lists: DataFrame, block: int) -> DataFrame:
    """(name, x, y, id, comp): a list (name, id, comp, size) is dealt by hash into blocks of about ``block``, and every two
    blocks meet in one group of about 2 * ``block`` rows.
    """
    blocks = F.ceil(F.col("size") / block).cast("int")
    x = F.pmod(F.xxhash64(F.lit(5), "id"), blocks).cast("int")
    cut = lists.withColumn("x", x).withColumn("y", F.explode(F.sequence(F.lit(0), blocks - 1))).filter((F.col("x") != F.col("y")) | (F.col("size") <= block))
    return cut.select("name", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), "id", "comp")


def verify_blocks(lists: DataFrame, texts: DataFrame, width: int, percent: int, block: int = 256) -> DataFrame:
    """Links (a, b) that join components within lists; no pair becomes a row."""
    return blocks_of(lists, block).join(texts, "id").groupBy("name", "x", "y").applyInArrow(within(width, percent), "a long, b long")


def clumps(meet: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Lists (name, id, n) without a document in common: two documents of a group (name, x, y) of ``meet`` that may link
    by their sketches are in one of them.
    """
    pairs = meet.join(sketches, "id").groupBy("name", "x", "y").applyInArrow(reach(percent), "a long, b long")
    found = connected_components(pairs).select(F.col("component").alias("name"), F.col("node").alias("id"))
    return stored(found.join(sketches.groupBy("id").agg(F.max("n").alias("n")), "id").select("name", "id", "n"), "clumps")


def weighed(lists: DataFrame, rows: int = 4, items: int = 600) -> DataFrame:
    """The lists with, as their size, their documents over ``rows`` or their items over ``items``, if that is more."""
    sizes = lists.groupBy("name").agg(F.ceil(F.greatest(F.count("*") / rows, F.sum("n") / items)).alias("size"))
    return lists.drop("size").join(sizes, "name")


def sifted(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may link by their sketches (id, n, sketch): none that link is missed."""
    with_a = pairs.join(sketches.select(F.col("id").alias("a"), "n", "sketch"), "a")
    both = with_a.join(sketches.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("sketch").alias("sketch2")), "b")
    return both.select("a", "b", "n", "sketch", "n2", "sketch2").mapInArrow(alike(percent), "a long, b long").distinct()


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components."""
    of = [labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
    return pairs.join(of[0], "a", "left").join(of[1], "b", "left").filter("coalesce(ca, a) != coalesce(cb, b)").select("a", "b")


def verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The linked ones of the pairs (a, b); texts: (id, text)."""
    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    both = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(compare(width, percent), "a long, b long")


def _joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components (node, component) with links (a, b) added: only links between components take part."""
    if labels is None:
        return stored(connected_components(links), "labels")
    of = [labels.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")) for x in "ab"]
    between = links.join(of[0], "a", "left").join(of[1], "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    more = stored(connected_components(between.filter("a != b").distinct()), "joins")
    old = labels.join(more.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    out = stored(old.unionByName(more.join(labels.select("node"), "node", "left_anti")), "labels")
    discard(labels, more)
    return out


def _lists(posted: DataFrame) -> DataFrame:
    """(name, id, n): lists of several documents that share a signature; lists of the same documents are one.

    A list's name is made of its least and its largest id and the exclusive or
    of all ids' hashes: equal lists have equal names, and should others meet by
    chance, more is compared but nothing lost. Signatures that over 1/4096 of
    the postings carry (found by approx_top_k, at most 512) are summed in each
    task before the sums are shuffled; only the others' postings meet in a window.
    """
    all_posted = posted.select("n", "id", F.explode("sigs").alias("sig"))
    hot = stored(all_posted.agg(F.expr("approx_top_k(sig, 512, 4096)").alias("t")).select(F.explode("t").alias("t")).filter("t.count > 256").select(F.col("t.item").alias("sig")), "hot")
    name = F.xxhash64("lo", "hi", "mixed").alias("name")
    group = Window.partitionBy("sig")
    cold = all_posted.join(F.broadcast(hot), "sig", "left_anti")
    ends = cold.withColumn("lo", F.min("id").over(group)).withColumn("hi", F.max("id").over(group)).filter("lo < hi").withColumn("mixed", F.bit_xor(F.xxhash64("id")).over(group))
    some = all_posted.join(F.broadcast(hot), "sig")
    sums = some.groupBy("sig").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.bit_xor(F.xxhash64("id")).alias("mixed")).filter("lo < hi")  # at most 512 rows
    out = ends.select(name, "id", "n").unionByName(some.join(F.broadcast(sums), "sig").select(name, "id", "n"))
    lists = stored(out.distinct(), "lists")
    discard(hot)
    return lists


def _mixed(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """The lists that still hold several components, with each id's component."""
    named = lists.join(labels.withColumnRenamed("node", "id"), "id", "left").select("name", "id", "n", F.coalesce("component", "id").alias("comp"))
    named = stored(named, "named")
    several = named.groupBy("name").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size")).filter("lo < hi").select("name", "size")
    mixed = stored(named.join(several, "name"), "mixed")
    discard(named)
    return mixed


def components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 4, percent: int = 85,
               rounds: int = 4, short: int = 16, kept: int = 8192, block: int = 256, wide: int = 2048, many: int = 1) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are lower-cased (A-Z) and split at ASCII white space. Texts that are
    null or without words have an empty set and link with nothing; their
    component is their own id. Rows of one id are one document: whatever links
    with one of its texts links with all of them. Rows with a null id link
    nothing and have a null component. Other columns, whatever their names,
    aren't read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    base = stored(rows.mapInArrow(classes_of, "doc_id long, node long"), "base")
    full = base.filter("node >= 0 and doc_id is not null")
    classes = stored(base.filter("node >= 0").groupBy("node").agg(F.min("doc_id").alias("id"), F.count("*").alias("size")), "classes")
    of_class = rows.join(classes.select("node", "id"), F.col("doc_id") == F.col("id")).select("id", "node", "text")
    nameless = rows.filter("doc_id is null").select(F.col("doc_id").alias("id"), F.lit(None).cast("long").alias("node"), "text")  # only their set's size is asked for
    posted = stored(of_class.unionByName(nameless).mapInArrow(post(width, percent), POSTED), "posted")
    release(spark)
    facts = stored(posted.groupBy("node").agg(F.max("n").alias("n")), "facts")
    sketches = stored(posted.filter("n > 0 and id is not null").select("id", "node", "n", "sketch").dropDuplicates(["id", "node"]), "sketches")
    release(spark)
    lists = _lists(posted.filter("id is not null"))
    discard(posted)
    release(spark)
    texts = of_class.join(lists.select("id").distinct(), "id", "left_semi").dropDuplicates(["id", "node"])
    texts = stored(texts, "texts")
    release(spark)

    # texts of one id are one document
    several = full.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("doc_id")
    own = full.join(several, "doc_id").join(classes.select("node", "id"), "node").filter("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    labels = _joined(None, own)
    mixed, before, again = _mixed(lists, labels), 0, False
    discard(lists)
    for r in range(rounds):
        pivots = mixed.groupBy("name").agg(F.min(F.struct(F.xxhash64(F.lit(r), "id").alias("h"), "id", "comp", "n")).alias("p"))
        near = mixed.join(pivots, "name").filter(f"p.comp != comp and 100 * least(p.n, n) >= {percent} * greatest(p.n, n)")
        pairs = near.groupBy(F.col("id").alias("a")).agg(F.min("p").alias("p")).select("a", F.col("p.id").alias("b"))
        found = stored(verify(sifted(pairs, sketches, percent), texts, width, percent), "links")
        labels = _joined(labels, found)
        fresh = _mixed(mixed.select("name", "id", "n"), labels)
        discard(found, mixed)
        mixed = fresh
        release(spark)
        longest, left = mixed.agg(F.coalesce(F.max("size"), F.lit(0)), F.count("*")).first()
        if longest <= short or r and left > 0.9 * before:
            break  # a round that joins little would be followed by others
        if not again:
            # long lists of different documents come from passages that many share: documents that are in
            # mixed lists post again, by the shingles that are rarest among them
            again = True
            some = stored(texts.join(mixed.select("id").distinct(), "id", "left_semi"), "some")
            weight = spark.sparkContext.broadcast(rarity_of(some, width, kept))
            posted = stored(some.select("id", "node", "text").mapInArrow(post(width, percent, weight), POSTED).drop("sketch"), "posted")
            lists = _lists(posted)
            discard(mixed, posted, some)
            mixed = _mixed(lists, labels)
            discard(lists)
            left = mixed.count()
        before = left
    # lists of documents that nearly link, but don't, stay long; shorter lists share many pairs, of which one row is compared
    a, b = (mixed.filter(F.col("size") <= short).select("name", F.col("id").alias(x), F.col("n").alias(f"{x}n"), F.col("comp").alias(f"{x}c")) for x in "ab")
    rest = a.join(b, "name").filter(f"a < b and ac != bc and 100 * least(an, bn) >= {percent} * greatest(an, bn)").select("a", "b").distinct()
    near = stored(sifted(rest, sketches, percent), "pairs")
    release(spark)
    long = blocks_of(mixed.filter(F.col("size") > short), wide)
    some = stored(long.join(sketches, "id").groupBy("name", "x", "y").applyInArrow(close(percent, many), "a long, b long, name long, x int, y int"), "close")
    release(spark)
    rows = near.unionByName(some.filter("a is not null").select("a", "b")).distinct()
    # one pair of a document first: most of the others lie in one component then
    firsts = rows.groupBy("a").agg(F.min("b").alias("b"))
    found = stored(verify(firsts, texts, width, percent), "links")
    labels = _joined(labels, found)
    discard(found)
    release(spark)
    others = stored(apart(rows.join(firsts, ["a", "b"], "left_anti"), labels), "pairs")
    # where more than ``many`` a document may link, only which of them do over others is asked; texts meet once then, whatever the lists they share
    dense = long.join(some.filter("a is null").select("name", "x", "y"), ["name", "x", "y"], "left_semi")
    gathered = clumps(dense, sketches, percent)
    release(spark)
    met = _mixed(gathered, labels)
    found = stored(verify(others, texts, width, percent).unionByName(verify_blocks(weighed(met), texts, width, percent, block)), "links")
    labels = _joined(labels, found)
    discard(found, mixed, texts, sketches, near, some, others, gathered, met)
    named = classes.join(labels.select(F.col("node").alias("id"), "component"), "id", "left").join(facts, "node", "left")
    named = stored(named.select("node", "size", "n", F.coalesce("component", "id").alias("component")), "named")
    discard(classes, labels, facts)
    # rows of large classes are named where they lie
    found = split_join(base, named, "node", base.count())
    component = F.when(F.col("node") < 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component"))
    return found.select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"), component.alias("component_id"))

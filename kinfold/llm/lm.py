"""Language-model scoring: a causal self-attention model in numpy, and word counts of the whole corpus.

Model: subword ids; embedding plus position, one masked attention head with a
residual, and a softmax over groups of id classes, one over the classes of the
group, and the share of an id within its class. Classes hold ids that follow similar
ids, in about equal shares of the training mass. Which id follows which is counted over all training rows; from
that come classes, input symbols, and the shares of classes and ids after the
ids of each of ``CONTEXTS`` hashed places. The attention model's probability is
interpolated with the discounted share of the id after the one before it, for
the pairs that occur most (at most ``max_pairs``). The model starts
from a fit on at most ``max_windows`` windows of at most ``max_docs`` training
documents; then each task trains it on all windows of its training rows, every
id being a target once, and the tasks' models are averaged by their targets.

Scoring: a text is read in overlapping windows of ``WINDOW`` ids that start
``STRIDE`` apart; each id is scored once, with at least WINDOW - STRIDE ids
before it, and windows of many texts are one batch.

Texts are cut at spaces into parts, whose ids and words are made once while a
task keeps them; ids of texts and counts of parts come from them in one pass.
Base score: words are counted over all training rows (partial sums per task,
one shuffle). The most frequent words, at most ``common``, are broadcast;
other words join their counts by hash, so no list of counts that grows with
the corpus leaves the cluster.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import cache, cached_property
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _boundary, rank_encoder
from .common import hold, pieces, release, remainder, stored, trim

WINDOW, STRIDE, WIDTH, GROUPS, BRANCHES, INPUTS, CONTEXTS = 32, 24, 16, 16, 16, 4096, 64
CLASSES, SHIFT = GROUPS * BRANCHES, BRANCHES.bit_length() - 1  # class = group * BRANCHES + branch
CAUSAL = np.tril(np.ones((WINDOW, WINDOW), np.float32))
BITS = np.float32(np.log2(np.e))  # powers are of two, which numpy makes faster than those of e
TOP = np.float32(60 * BITS)  # the greatest exponent: sums stay finite
ONES = np.ones(1 << 16, np.float32)


class Table:
    """Values by key: a key stands in the first free slot from that of its hash on, and at most half of the slots are taken."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.bits = max(1, int(2 * len(key)).bit_length())
        at, rank = self.bucket(key), np.arange(len(key))
        order = np.argsort(at, kind="stable")
        place = np.maximum.accumulate(at[order] - rank) + rank
        size = max(1 << self.bits, int(place.max(initial=0)) + 1) + 1  # the last slot stays free
        self.key, self.value, self.full = np.zeros(size, np.int64), np.zeros(size, value.dtype), np.zeros(size, bool)
        self.key[place], self.value[place], self.full[place] = key[order], value[order], True

    def bucket(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, own: np.ndarray) -> np.ndarray:
        """The slots of keys; a free one, whose value is 0, of a key that isn't there."""
        slot = self.bucket(own)
        miss = np.flatnonzero(self.key.take(slot) != own)
        while len(miss):
            miss = miss[self.full[slot[miss]]]
            slot[miss] += 1
            miss = miss[self.key[slot[miss]] != own[miss]]
        return slot


class Follows:
    """Ids that often follow an id in the corpus: their discounted shares, and what is left to the attention model."""

    def __init__(self, key: np.ndarray, share: np.ndarray, left: np.ndarray):
        """key: before * vocabulary + id; left: by the id before, with the shares it sums to 1."""
        self.shares, self.left = Table(key, share.astype(np.float32)), left

    def mix(self, before: np.ndarray, ids: np.ndarray, share: np.ndarray) -> np.ndarray:
        """The interpolation of the shares with other probabilities, all of them flat."""
        return self.shares.value.take(self.shares.find(before * len(self.left) + ids)) + self.left.take(before) * share


def follows(before: np.ndarray, ids: np.ndarray, counts: np.ndarray, total: np.ndarray, discount: float = 0.75, weight: float = 0.3) -> Follows | None:
    """From pairs and their counts, and how often each id is followed by any (``total``); ``weight`` is the shares' part of the whole."""
    if not len(ids):
        return None
    key = before.astype(np.int64) * len(total) + ids
    share = weight * (counts - discount) / total[before]
    left = 1 - np.bincount(before, share, len(total))
    return Follows(key, share, np.clip(left, 1e-12, 1))


@dataclass
class Model:
    end: int
    symbol: np.ndarray  # id -> input symbol
    klass: np.ndarray  # id -> class
    within: np.ndarray  # (id, place of the id before it) -> log10 of its share of its class there
    prior: np.ndarray  # (place of the id before, group) -> log of the group's share there
    inner: np.ndarray  # (place * GROUPS + group, branch) -> log of the class's share of its group there
    p: dict[str, np.ndarray]
    follows: Follows | None = None

    def joint(self) -> np.ndarray:
        """The three attention products as one, queries scaled, for powers of two."""
        return np.concatenate([self.p["q"] * (np.float32(WIDTH**-0.5) * BITS), self.p["k"], self.p["v"]], 1)

    def forward(self, ids: np.ndarray):
        """Hidden states of windows of ids, and what the gradient needs."""
        p, n = self.p, ids.shape[1]
        x = np.take(p["e"], self.symbol.take(ids), axis=0)
        x += p["pos"][:n]
        flat = x.reshape(-1, WIDTH)
        q, k, v = (product(flat, w).reshape(x.shape) for w in np.split(self.joint(), 3, axis=1))
        s = q @ np.ascontiguousarray(k.transpose(0, 2, 1))
        np.exp2(bounded(s), out=s)
        s *= CAUSAL[:n, :n]  # later places get no weight
        part = (1 / (s.reshape(-1, n) @ ONES[:n] + np.float32(1e-30))).reshape(*x.shape[:2], 1)
        o = s @ v
        o *= part
        h = product(o.reshape(-1, WIDTH), p["o"]).reshape(x.shape)
        h += x
        return h, (x, q, k, v, s, part, o)

    @cached_property
    def first(self) -> np.ndarray:
        """By place and group: logs of the shares of the groups, and beside them of the group's classes, for powers of two."""
        prior = np.broadcast_to(self.prior[:, None], (CONTEXTS, GROUPS, GROUPS))
        return np.concatenate([prior, self.inner.reshape(-1, GROUPS, BRANCHES)], 2).reshape(CONTEXTS, -1) * BITS

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """By group, the products for all groups and for its classes side by side; by place and group, what is added to them. For powers of two."""
        p, both, added = self.p, np.empty((GROUPS, WIDTH, GROUPS + BRANCHES), np.float32), np.empty((GROUPS, GROUPS + BRANCHES), np.float32)
        both[:, :, :GROUPS], both[:, :, GROUPS:], added[:, :GROUPS], added[:, GROUPS:] = p["c"], p["d"], p["b"], p["f"]
        both *= BITS
        added *= BITS
        return both, (self.first + added.ravel()).reshape(-1, GROUPS + BRANCHES)

    def outputs(self, h: np.ndarray, places: np.ndarray, klass: np.ndarray, cuts: list[int], heads: tuple[np.ndarray, np.ndarray]):
        """Weights of all groups and, beside them, of the classes of each row's group, and the sums of both.

        Rows are in order of their classes' groups, which begin at cuts.
        """
        both, added = heads
        z = np.empty((len(h), GROUPS + BRANCHES), np.float32)
        for g in range(GROUPS):
            np.matmul(h[cuts[g] : cuts[g + 1]], both[g], out=z[cuts[g] : cuts[g + 1]])
        z += np.take(added, places * GROUPS + (klass >> SHIFT), axis=0)
        np.exp2(bounded(z, -TOP), out=z)
        return z, (z.reshape(-1, BRANCHES) @ ONES[:BRANCHES]).reshape(-1, 2)

    def class_share(self, h: np.ndarray, places: np.ndarray, klass: np.ndarray, heads: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Probability of each row's class."""
        order, cuts = by_group(klass)
        klass = klass.take(order)
        z, sums = self.outputs(h.take(order, axis=0), places.take(order), klass, cuts, heads)
        own, other = spots(klass)
        z = z.ravel()
        share = np.empty(len(h), np.float32)
        share[order] = z.take(own) * z.take(other) / (sums[:, 0] * sums[:, 1])
        return np.maximum(share, np.float32(1e-37), out=share)

    def score(self, texts: list[np.ndarray], batch: int = 256) -> np.ndarray:
        """log10 probability of each text's ids and the end after them."""
        ctx, total = WINDOW - STRIDE, np.zeros(len(texts))
        if not texts:
            return total
        n = np.array([len(ids) + 1 for ids in texts])
        count = -(-n // STRIDE)
        begin = np.cumsum(ctx + 1 + count * STRIDE) - (ctx + 1 + count * STRIDE)
        line = np.full(begin[-1] + ctx + 1 + count[-1] * STRIDE, self.end, np.int64)
        for lo, ids in zip((begin + ctx + 1).tolist(), texts, strict=True):
            line[lo : lo + len(ids)] = ids
        owner = np.repeat(np.arange(len(texts)), count)
        at = (np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
        start, left, p = begin[owner] + at, n[owner] - at, self.p
        q, k, v = np.split(self.joint(), 3, axis=1)
        qv, k, heads = np.concatenate([q, v @ p["o"]], 1), np.ascontiguousarray(k.T), self.heads()
        # buffers are kept from batch to batch: fresh memory costs more than the products
        buffers = [np.empty((batch, *shape), np.float32) for shape in ((WINDOW, WIDTH), (WINDOW, 2 * WIDTH), (WIDTH, WINDOW), (STRIDE, WINDOW), (STRIDE, WIDTH))]
        one, mask = ONES[:WINDOW], CAUSAL[ctx:]
        for lo in range(0, len(owner), batch):
            hi = min(lo + batch, len(owner))
            rows = line.take(start[lo:hi, None] + np.arange(WINDOW + 1))
            x, two, keys, s, h = (b[: hi - lo] for b in buffers)
            np.take(p["e"], self.symbol.take(rows[:, :-1]), axis=0, out=x, mode="clip")  # other modes buffer their result
            x += p["pos"]
            product(x.reshape(-1, WIDTH), qv, two.reshape(-1, 2 * WIDTH))
            np.matmul(k, x.transpose(0, 2, 1), out=keys)
            np.matmul(two[:, ctx:, :WIDTH], keys, out=s)  # of the places before ctx nothing is scored
            np.exp2(bounded(s), out=s)
            s *= mask
            np.matmul(s, two[:, :, WIDTH:], out=h)
            h *= (1 / (s.reshape(-1, WINDOW) @ one + np.float32(1e-30))).reshape(-1, STRIDE, 1)
            h += x[:, ctx:]
            last, y = rows[:, ctx:-1].ravel(), rows[:, ctx + 1 :].ravel()
            places = place_of(last)
            share = self.class_share(h.reshape(-1, WIDTH), places, self.klass.take(y), heads) * np.exp(self.within.ravel().take(y * CONTEXTS + places) * np.log(10.0), dtype=np.float64)
            if self.follows is not None:
                share = self.follows.mix(last, y, share)
            log = np.log(share + 1e-300).reshape(-1, STRIDE)
            log *= np.arange(STRIDE) < left[lo:hi, None]
            total += np.bincount(owner[lo:hi], log.sum(1), len(texts))
        return total / np.log(10.0)


class Adam:
    """Adam over all parameters as one vector, of which those of ``p`` become views."""

    def __init__(self, p: dict[str, np.ndarray]):
        self.w, self.t, lo = np.concatenate([w.ravel() for w in p.values()]), 0, 0
        self.g, self.m, self.v, self.spare = (np.zeros_like(self.w) for _ in range(4))
        self.grads = {}
        for n, w in p.items():
            p[n], self.grads[n] = (x[lo : lo + w.size].reshape(w.shape) for x in (self.w, self.g))
            lo += w.size

    def step(self, grads: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        for n, g in grads.items():
            self.grads[n][...] = g
        g, m, v, s = self.g, self.m, self.v, self.spare
        m *= np.float32(0.9)  # the means' weights of 0.1 and 0.01 are left to the last lines
        m += g
        v *= np.float32(0.99)
        v += np.multiply(g, g, out=s)
        scale = (0.01 / (1 - 0.99**self.t)) ** 0.5
        np.sqrt(v, out=s)
        s += np.float32(1e-8 / scale)
        np.divide(m, s, out=s)
        self.w -= np.multiply(s, np.float32(rate * 0.1 / (1 - 0.9**self.t) / scale), out=s)


def fit(windows: np.ndarray, vocabulary: int, end: int, steps: int = 400, batch: int = 96, seed: int = 1, contexts: np.ndarray | None = None) -> Model:
    """Train on windows of WINDOW + 1 ids by Adam; contexts: ``context_counts`` of the corpus, else the windows' own."""
    rng = np.random.default_rng(seed)
    if contexts is None:
        contexts = np.bincount(context_keys(windows[:, :-1].ravel(), windows[:, 1:].ravel()), minlength=vocabulary * CONTEXTS).reshape(vocabulary, CONTEXTS)
    counts = contexts.sum(1) + 0.02
    order = np.argsort(-counts, kind="stable")
    klass = classes(contexts)
    within, prior, inner = shares(contexts, klass)
    symbol = np.empty(vocabulary, np.int64)
    symbol[order[: INPUTS - CLASSES]] = np.arange(vocabulary)[: INPUTS - CLASSES]
    symbol[order[INPUTS - CLASSES :]] = INPUTS - CLASSES + klass[order[INPUTS - CLASSES :]]
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    p = {"e": (rng.standard_normal((INPUTS, WIDTH)) * 0.3).astype(np.float32), "pos": (rng.standard_normal((WINDOW, WIDTH)) * 0.1).astype(np.float32)}
    p |= {n: init(WIDTH, WIDTH) for n in "qkvo"} | {"c": init(WIDTH, GROUPS), "b": np.zeros(GROUPS, np.float32)}
    p |= {"d": init(WIDTH, GROUPS, BRANCHES).swapaxes(0, 1).copy(), "f": np.zeros((GROUPS, BRANCHES), np.float32)}
    model = Model(end, symbol, klass, within, prior, inner, p)
    adam = Adam(p)
    for t in range(1, steps + 1):
        rows = windows[rng.integers(0, len(windows), batch)]
        adam.step(gradients(model, rows[:, :-1], klass[rows[:, 1:]]), 0.02 * min(1.0, 2 * (1 - t / (steps + 1))))
    return model


def gradients(model: Model, ids: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy of the target classes; targets under 0 don't count."""
    p = model.p
    h, (x, q, k, v, s, part_of, o) = model.forward(ids)
    flat = lambda y: y.reshape(-1, y.shape[-1])
    wanted = np.flatnonzero(target.ravel() >= 0)
    order, cuts = by_group(target.ravel().take(wanted))
    wanted = wanted.take(order)
    klass, own = target.ravel().take(wanted), flat(h).take(wanted, axis=0)
    heads = model.heads()
    z, sums = model.outputs(own, place_of(ids.ravel().take(wanted)), klass, cuts, heads)
    part = np.float32(1 / max(1, len(own)))
    both = z.reshape(-1, BRANCHES)
    both *= (part / sums).reshape(-1, 1)
    for at in spots(klass):
        z.ravel()[at] -= part
    g = {"c": np.zeros_like(p["c"]), "b": np.zeros_like(p["b"]), "d": np.empty_like(p["d"]), "f": np.empty_like(p["f"])}
    back, turned = np.zeros((len(own) + 1, WIDTH), np.float32), np.ascontiguousarray(heads[0].transpose(0, 2, 1)) / BITS
    for i in range(GROUPS):
        some = slice(cuts[i], cuts[i + 1])
        np.matmul(z[some], turned[i], out=back[some])
        w, sums = own[some].T @ z[some], ONES[: cuts[i + 1] - cuts[i]] @ z[some] if cuts[i + 1] - cuts[i] <= len(ONES) else z[some].sum(0)
        g["c"] += w[:, :GROUPS]
        g["b"] += sums[:GROUPS]
        g["d"][i], g["f"][i] = w[:, GROUPS:], sums[GROUPS:]
    place = np.full(target.size, len(own))  # of places that don't count: the last row, zeros
    place[wanted] = np.arange(len(own))
    dx = back.take(place, axis=0)
    # of a power of two, the slope is 1 / BITS of its own
    scale = np.repeat(np.array([1 / BITS, 1 / BITS, 1], np.float32), WIDTH)
    turned, joint = np.ascontiguousarray(p["o"].T), np.ascontiguousarray((model.joint() * scale).T)
    g["o"] = crossed(flat(o), dx)
    do = product(dx, turned).reshape(x.shape)
    do *= part_of  # weights are s times this, so s needn't be divided
    ds = do @ np.ascontiguousarray(v.transpose(0, 2, 1))
    ds -= (flat(do * o) @ ONES[:WIDTH]).reshape(*x.shape[:2], 1)  # o is the weights @ v, so this is what their row sum takes off
    ds *= s
    three = np.empty((*x.shape[:2], 3 * WIDTH), np.float32)
    np.matmul(ds, k, out=three[:, :, :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), q, out=three[:, :, WIDTH : 2 * WIDTH])
    np.matmul(s.transpose(0, 2, 1), do, out=three[:, :, 2 * WIDTH :])
    dx += product(flat(three), joint)
    qkv = crossed(flat(x), flat(three))
    g["pos"] = dx.reshape(x.shape).sum(0)
    g["q"], g["k"], g["v"] = np.split(qkv * scale, 3, axis=1)
    g["q"] = g["q"] * (np.float32(WIDTH**-0.5) * BITS)
    g["e"] = np.zeros(p["e"].shape, np.float32)
    np.add.at(g["e"].ravel(), (model.symbol.take(ids).reshape(-1, 1) * WIDTH + np.arange(WIDTH)).ravel(), dx.ravel())
    return g


def bounded(z: np.ndarray, least: np.float32 | None = None) -> np.ndarray:
    """Exponents at most TOP, and not under ``least``: they seldom are, which one look tells."""
    if z.size and z.max() > TOP:
        np.minimum(z, TOP, out=z)
    if least is not None and z.size and z.min() < least:
        np.maximum(z, least, out=z)
    return z


def product(x: np.ndarray, w: np.ndarray, out: np.ndarray | None = None, block: int = 1024) -> np.ndarray:
    """x @ w in blocks of rows: BLAS takes small products as they are, without copies."""
    out, cut = np.empty((len(x), w.shape[1]), np.float32) if out is None else out, len(x) // block * block
    np.matmul(x[:cut].reshape(-1, block, x.shape[1]), w, out=out[:cut].reshape(-1, block, w.shape[1]))
    np.matmul(x[cut:], w, out=out[cut:])
    return out


def crossed(x: np.ndarray, y: np.ndarray, block: int = 512) -> np.ndarray:
    """x.T @ y, as ``product``."""
    cut = len(x) // block * block
    return np.matmul(x[:cut].reshape(-1, block, x.shape[1]).transpose(0, 2, 1), y[:cut].reshape(-1, block, y.shape[1])).sum(0) + x[cut:].T @ y[cut:]


def by_group(klass: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Order of rows by their classes' groups, and where each group begins and ends."""
    group = (klass >> SHIFT).astype(np.uint8)
    return np.argsort(group, kind="stable"), [0, *np.cumsum(np.bincount(group, minlength=GROUPS)).tolist()]


def spots(klass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat places of each row's group and class in what ``outputs`` makes."""
    lo = np.arange(0, len(klass) * (GROUPS + BRANCHES), GROUPS + BRANCHES)
    return lo + (klass >> SHIFT), lo + ((klass & BRANCHES - 1) + GROUPS)


def context_keys(before: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Place of (id, hash of the id before it) in a flat table of CONTEXTS places an id."""
    return ids.astype(np.int64) * CONTEXTS + place_of(before)


def place_of(ids: np.ndarray) -> np.ndarray:
    """One of CONTEXTS places of an id, by hash."""
    return (ids.astype(np.int64) * 2654435761 >> 7) % CONTEXTS


def shares(contexts: np.ndarray, klass: np.ndarray, few: float = 32.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Model.within, prior and inner from the corpus' counts; rare places fall back to the shares over all places, each as ``few`` counts."""
    counts = contexts.sum(1) + 0.02
    sizes = np.bincount(klass, counts, CLASSES)
    alone = counts / sizes[klass]
    order = np.argsort(klass, kind="stable")
    first = np.flatnonzero(np.diff(klass[order], prepend=-1))
    by_class = np.zeros((CLASSES, CONTEXTS))
    by_class[klass[order[first]]] = np.add.reduceat(contexts[order], first)
    within = np.log10((contexts + few * alone[:, None]) / (by_class[klass] + few)).astype(np.float32)
    sizes, by_class = sizes.reshape(GROUPS, BRANCHES), by_class.T.reshape(CONTEXTS, GROUPS, BRANCHES)
    groups, by_group = sizes.sum(1), by_class.sum(2)
    prior = (by_group + few * groups / groups.sum()) / (by_group.sum(1, keepdims=True) + few)
    inner = (by_class + few * sizes / np.maximum(groups, 1e-30)[:, None]) / (by_group[:, :, None] + few)
    log = lambda share: np.log(np.maximum(share, 1e-26)).astype(np.float32)  # noqa: E731  (classes without ids)
    return within, log(prior), log(inner).reshape(-1, BRANCHES)


def classes(contexts: np.ndarray) -> np.ndarray:
    """A class for each id: ids are split into GROUPS parts, and each of these into BRANCHES."""
    n, mean = contexts.sum(1, keepdims=True), contexts.sum(0) / max(1, contexts.sum())
    x = np.sqrt((contexts + 2 * mean) / (n + 2))  # few counts shrink to the mean
    weight = n[:, 0] + 0.02
    klass = np.empty(len(x), np.int64)
    for g, group in enumerate(split(x, weight, np.arange(len(x)), GROUPS)):
        for b, own in enumerate(split(x, weight, group, BRANCHES)):
            klass[own] = g * BRANCHES + b
    return klass


def split(x: np.ndarray, weight: np.ndarray, ids: np.ndarray, most: int) -> list[np.ndarray]:
    """The heaviest part is halved across its ids' main direction until there are ``most`` or only single ids."""
    heap, ready, made = [(-weight[ids].sum(), 0, ids)], [], 0
    while heap and len(heap) + len(ready) < most:
        own = heapq.heappop(heap)[2]
        if len(own) == 1:
            ready.append(own)
            continue
        w = weight[own]
        y = x[own] - w @ x[own] / w.sum()
        direction = np.linalg.eigh((y * w[:, None]).T @ y)[1][:, -1]
        order = own[np.argsort(y @ direction, kind="stable")]
        mass = np.cumsum(weight[order])
        cut = int(np.clip(np.searchsorted(mass, mass[-1] / 2) + 1, 1, len(own) - 1))
        for part in (order[:cut], order[cut:]):
            made += 1
            heapq.heappush(heap, (-weight[part].sum(), made, part))
    return ready + [h[2] for h in heap]


def id_type(end: int) -> str:
    """How ids up to ``end`` are stored: little-endian, in two bytes if they fit."""
    return "<u2" if end < 1 << 16 else "<u4"


def pair_counts(rows: DataFrame, vocabulary: int, end: int) -> DataFrame:
    """(before, id, c): how often each id, and the end once a row, follows each id in all rows; the end stands before a row."""
    kind = id_type(end)
    last = np.array([end], kind).tobytes()

    def run(batches):
        import pyarrow as pa

        keys, counts, waiting, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def merge():
            nonlocal keys, counts
            new, n = np.unique(np.concatenate(waiting), return_counts=True)
            keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            waiting.clear()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(keys // vocabulary), pa.array(keys % vocabulary), pa.array(counts)], ["before", "id", "c"])

        for batch in pieces(batches):
            line = np.concatenate([np.array([end], kind), *[np.frombuffer(ids + last, kind) for ids in batch.column(0).to_pylist()]]).astype(np.int64)
            waiting.append(line[:-1] * vocabulary + line[1:])
            held += len(line)
            if held > 2_000_000:
                merge()
                held = 0
                if len(keys) > 2_000_000:
                    yield out()
                    keys, counts = keys[:0], counts[:0]
        if waiting:
            merge()
        yield out()

    return rows.select("ids").mapInArrow(run, "before long, id long, c long").groupBy("before", "id").agg(F.sum("c").alias("c"))


def context_counts(pairs: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id follows an id of each place: at most vocabulary x CONTEXTS numbers."""
    place = (F.shiftright(F.col("before") * 2654435761, 7) % CONTEXTS).alias("place")  # as place_of
    got = pairs.groupBy("id", place).agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros((vocabulary, CONTEXTS))
    counts[got["id"].to_numpy(np.int64), got["place"].to_numpy(np.int64)] = got["c"].to_numpy(np.int64)
    return counts


def most_frequent(counts: DataFrame, most: int, least: int = 1) -> DataFrame:
    """The rows with c of a power of two or more, the least that no more than ``most`` rows reach."""
    sizes = counts.groupBy(F.floor(F.log2("c")).cast("int").alias("e")).count().orderBy(F.desc("e")).collect()  # at most 64 rows
    bound, total = None, 0
    for r in sizes:
        total += r["count"]
        if total > most:
            break
        bound = 2 ** r["e"]
    return counts.filter(F.col("c") >= max(bound, least)) if bound else counts.filter("false")


def frequent_follows(pairs: DataFrame, vocabulary: int, most: int) -> Follows | None:
    total = np.ones(vocabulary)
    sums = pairs.groupBy("before").agg(F.sum("c").alias("c")).toPandas()  # at most vocabulary rows
    total[sums["before"].to_numpy(np.int64)] = sums["c"].to_numpy(np.int64)
    got = most_frequent(pairs, most, least=2).toPandas()
    return follows(*(got[c].to_numpy(np.int64) for c in ("before", "id", "c")), total)


def whole_windows(ids: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Inputs and targets of windows over a whole text, every id and the end being a target once, else -1."""
    ctx, n = WINDOW - STRIDE, len(ids) + 1
    count = -(-(ctx + n) // WINDOW)
    line, target = np.full(count * WINDOW, end, np.int64), np.full(count * WINDOW, -1, np.int64)
    line[ctx + 1 : ctx + n] = ids
    target[ctx : ctx + n - 1] = ids
    target[ctx + n - 1] = end
    return line.reshape(-1, WINDOW), target.reshape(-1, WINDOW)


def train_on_all(model: Model, rows: DataFrame, batch: int = 256, rate: float = 0.003, held: int = 8192) -> Model:
    """One pass over all windows of all rows: a model per task from ``model`` on, averaged by the tasks' targets.

    Sums are made by parameter in one shuffle, so the driver gets as many numbers as one model has.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        kept_parts.cache_clear()  # nothing is encoded any more
        hold()
        start = shared.value
        own = Model(start.end, start.symbol, start.klass, start.within, start.prior, start.inner, {n: w.copy() for n, w in start.p.items()})
        klass = np.append(own.klass, -1)  # the last one is that of no target
        adam, rng, seen, kept, waiting = Adam(own.p), np.random.default_rng(7), 0, [], 0

        def learn():
            nonlocal seen
            x, y = (np.concatenate(c) for c in zip(*kept, strict=True))
            order = rng.permutation(len(x))
            for lo in range(0, len(x), batch):
                some = order[lo : lo + batch]
                want = klass[y.take(some, axis=0)]
                # a last, small batch moves the model by its share
                adam.step(gradients(own, x.take(some, axis=0), want), rate * len(some) / batch)
                seen += int((want >= 0).sum())
            kept.clear()

        for part in pieces(batches):
            for ids in part.column(0).to_pylist():
                kept.append(whole_windows(np.frombuffer(ids, id_type(own.end)), own.end))
                waiting += len(kept[-1][0])
                if waiting >= held:
                    learn()
                    waiting = 0
        if kept:
            learn()
        flat = np.concatenate([own.p[n].ravel() for n in sorted(own.p)] + [np.ones(1)]).astype(np.float64) * seen
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "w"])
        trim()

    got = rows.select("ids").mapInArrow(run, "at long, w double").groupBy("at").agg(F.sum("w").alias("w")).toPandas().sort_values("at")["w"].to_numpy()
    if not len(got):
        return model
    p, lo = {}, 0
    for n in sorted(model.p):
        w = model.p[n]
        p[n] = (got[lo : lo + w.size] / got[-1]).reshape(w.shape).astype(np.float32)
        lo += w.size
    return Model(model.end, model.symbol, model.klass, model.within, model.prior, model.inner, p, model.follows)


class Seen:
    """Numbers of byte strings, in the order in which they are met, by 64-bit hashes: up to ``LONG`` bytes sums of random numbers by place and byte, else xxh3."""

    LONG, FREE, BITS = 64, -1, 21  # 2 ** BITS slots
    RANDOM = np.random.default_rng(11).integers(0, 2**64, LONG * 256, np.uint64)

    def clear(self) -> None:
        self.known, slots = 0, (1 << self.BITS) + (1 << self.BITS - 1)  # no string is looked for beyond the last
        self.keys, self.places = np.zeros(slots, np.uint64), np.full(slots, self.FREE, np.int32)

    def hashes_of(self, raw: bytes, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Hashes of strings that begin at ``first``, one after the other."""
        import xxhash

        b = np.frombuffer(raw, np.uint8)[first[0] :]
        at = np.arange(len(b)) - np.repeat(first - first[0], np.diff(first, append=len(raw)))
        at &= self.LONG - 1  # longer ones get another hash below
        at <<= 8
        at += b
        h = np.add.reduceat(self.RANDOM.take(at), first - first[0])
        for i in np.flatnonzero(size > self.LONG).tolist():
            h[i] = xxhash.xxh3_64_intdigest(raw[first[i] : first[i] + size[i]])
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slots of hashes, free ones if they aren't there."""
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        miss = np.flatnonzero(self.keys.take(slot) != h)
        while len(miss):
            miss = miss[self.places.take(slot.take(miss)) != self.FREE]
            slot[miss] += 1
            miss = miss[self.keys.take(slot.take(miss)) != h.take(miss)]
        return slot

    def number(self, raw: bytes, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of strings; ``fill`` gets those that are new."""
        h = self.hashes_of(raw, first, size)
        slot = self.find(h)
        if len(miss := np.flatnonzero(self.places.take(slot) == self.FREE)):
            new, at = np.unique(h[miss], return_index=True)
            place, left = np.arange(self.known, self.known + len(new), dtype=np.int32), np.arange(len(new))
            while len(left):
                free = self.find(new[left])
                self.keys[free], self.places[free] = new[left], place[left]
                left = left[self.places[free] != place[left]]  # of several for one slot, one has it
            begin = first[miss[at]]
            self.fill([raw[lo:hi] for lo, hi in zip(begin.tolist(), (begin + size[miss[at]]).tolist(), strict=True)])
            slot[miss] = self.find(h[miss])
        return self.places.take(slot)


class Parts(Seen):
    """Ids and word counts of texts by their parts between certain boundaries (see ``bpe``), each encoded once while it is kept.

    A part begins with its space, the first of a text with a line feed in front of it.
    What can be seen from the bytes around a space decides whether it is taken for a
    certain boundary; a part may hold others.
    """

    BEFORE, AFTER = np.arange(256) > 32, np.arange(256) > 32
    AFTER[[0xC2, 0xE1, 0xE2, 0xE3]] = False  # what may begin a white letter

    def __init__(self, encoder, kind: str, most: int = 1_000_000):
        self.encoder, self.kind, self.most = encoder, kind, most
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.n_ids, self.n_words, self.ids = 0, 0, np.zeros(0, self.kind)
        self.first, self.size, self.counts, self.owner, self.hashes = (np.zeros(0, np.int64) for _ in range(5))  # the last two: words

    def cut(self, raw: bytes, starts: np.ndarray) -> np.ndarray:
        """Where parts begin."""
        b = np.frombuffer(raw, np.uint8)
        p = np.flatnonzero(b[:-1] == 32)  # not the first byte, which is a line feed
        last, lead = b.take(p - 1), b.take(np.maximum(p - 2, 0))
        two = (lead >= 0xC3) & (lead < 0xE0)  # a letter of two bytes, of which those with 0xC2 may be white
        p = p[self.BEFORE.take(last) & ((last < 128) | two) & self.AFTER.take(b.take(p + 1))]
        begins = np.zeros(len(b), bool)
        begins[p] = begins[starts] = True
        return np.flatnonzero(begins)

    def encode(self, texts: list[str], counted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after the other, and how many each has; words are counted in texts where ``counted`` is true."""
        coded = [t.encode() for t in texts]
        raw, sizes = b"\n" + b"\n".join(coded), np.array([len(t) + 1 for t in coded])
        starts = np.cumsum(sizes) - sizes
        first = self.cut(raw, starts)
        parts = self.number(raw, first, np.diff(first, append=len(raw)))
        texts_first = np.searchsorted(first, starts)
        owner = np.repeat(np.arange(len(texts)), np.diff(texts_first, append=len(first)))
        counts = np.bincount(parts[counted[owner]], minlength=self.known)
        counts[: len(self.counts)] += self.counts
        self.counts = counts
        size = self.size.take(parts)
        return self.ids.take(stretches(self.first.take(parts), size)), np.bincount(owner, size, len(texts)).astype(np.int64)

    def fill(self, new: list[bytes]) -> None:
        """Encode new parts."""
        import xxhash

        keys = [key.decode() for key in new]
        white, plain, single = [i for i, key in enumerate(keys) if key.split() != [key[1:]] or key[0] != " "], np.ones(len(keys), bool), np.ones(len(keys), bool)
        single[white], alone, ids_alone, words, owner = False, [], [], [], []
        for i in white:
            if (key := keys[i])[0] != " " or " " in key[1:] or key[-1].isspace():
                alone.append(i)
                ids_alone.append(self.encoder(key.removeprefix("\n")))
            words += (own := key.encode().lower().split())
            owner += [i] * len(own)
        plain[alone] = False
        ids = self.encoder("".join(compress(keys, plain.tolist())))  # each begins with a space and has no other
        words += "".join(compress(keys, single.tolist())).encode().lower().split()
        size = np.zeros(len(keys), np.int64)
        size[plain] = np.diff(np.flatnonzero(self.encoder.spaced[ids]), append=len(ids))
        size[alone] = [len(own) for own in ids_alone]
        first, new = np.cumsum(size) - size, np.empty(size.sum(), self.kind)
        new[stretches(first[plain], size[plain])] = ids
        if alone:
            new[stretches(first[alone], size[alone])] = np.concatenate(ids_alone)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)
        owner = np.concatenate([np.array(owner, np.int64), np.flatnonzero(single)])
        self.first, self.size = put(self.first, self.known, first + self.n_ids), put(self.size, self.known, size)
        self.owner, self.hashes = put(self.owner, self.n_words, owner + self.known), put(self.hashes, self.n_words, hashes)
        self.ids = put(self.ids, self.n_ids, new)
        self.known, self.n_ids, self.n_words = self.known + len(keys), self.n_ids + len(new), self.n_words + len(words)

    def full(self) -> bool:
        return self.known > self.most or self.n_ids > 16 * self.most

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and counts of the words counted since the last call; where there are too many parts, they are forgotten."""
        self.counts = put(self.counts, len(self.counts), np.zeros(self.known - len(self.counts), np.int64))[: self.known]
        c = self.counts[self.owner[: self.n_words]]
        h, at = np.unique(self.hashes[: self.n_words][c > 0], return_inverse=True)
        counts = np.bincount(at, c[c > 0], len(h)).astype(np.int64)
        self.counts = np.zeros(0, np.int64)
        if self.full():
            self.clear()
        return h, counts


@cache
def kept_parts(path: str, pattern: str, kind: str) -> Parts:
    """Made once in a Python worker, as the encoder: later tasks find the parts that earlier ones met."""
    return Parts(rank_encoder(path, pattern), kind)


def put(array: np.ndarray, at: int, new: np.ndarray) -> np.ndarray:
    """The array with ``new`` from ``at`` on; one that is too short gets twice the room."""
    if at + len(new) > len(array):
        array = np.concatenate([array[:at], np.zeros(at + 2 * len(new), array.dtype)])
    array[at : at + len(new)] = new
    return array


def stretches(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places of stretches, one after the other."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


def short(text: str, held: int) -> list[str]:
    """A text cut at certain boundaries, after ``held`` characters or more each."""
    out, lo = [], 0
    while len(text) - lo > held and (p := _boundary(text, lo + held, len(text), last=False)) >= 0:
        out.append(text[lo:p])
        lo = p
    return [*out, text[lo:]]


def encoded(rows: DataFrame, path: str, pattern: str, end: int, held: int = 1 << 19) -> DataFrame:
    """``rows`` (doc_id, text, held_out) with their ids as ``id_type`` says, and rows of words (h, c) of those to learn from.

    Both are made in one pass over the texts, about ``held`` characters at a time.
    """

    def run(batches):
        import pyarrow as pa

        encoder, kind = rank_encoder(path, pattern), id_type(end)
        if len(encoder.sizes) > end:
            raise ValueError(f"ids of {path} reach the end's, {end}")
        parts, names = kept_parts(path, pattern, kind), ["doc_id", "text", "held_out", "ids", "h", "c"]
        nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.bool_(), pa.binary())]

        parts.counts = np.zeros(0, np.int64)  # a task that failed may have left some

        def counts():
            h, c = parts.words()
            for lo in range(0, len(h), 1 << 16):
                yield pa.RecordBatch.from_arrays([*nothing, *[pa.array([x[lo : lo + (1 << 16)].astype("<i8").tobytes()], pa.binary()) for x in (h, c)]], names)

        for batch in pieces(batches):
            cut = [short(t or "", held) for t in batch.column(1).to_pylist()]
            texts, owner = [t for own in cut for t in own], np.repeat(np.arange(len(cut)), [len(own) for own in cut])
            counted = np.array([on is False for on in batch.column(2).to_pylist()])[owner]
            ends, coded, lo = np.cumsum([len(t) for t in texts]), [], 0
            while lo < len(texts):
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + held, "right")))
                coded.append(parts.encode(texts[lo:hi], counted[lo:hi]))
                if parts.full():
                    yield from counts()
                lo = hi
            ids, sizes = (np.concatenate(c) for c in zip(*coded, strict=True))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, sizes, len(cut)).astype(np.int64))]) * ids.itemsize
            column = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([*batch.columns, column, *[pa.nulls(len(cut), pa.binary())] * 2], names)
        yield from counts()
        trim()

    return rows.mapInArrow(run, "doc_id long, text string, held_out boolean, ids binary, h binary, c binary")


def training_windows(rows: DataFrame, end: int, max_docs: int, max_windows: int) -> np.ndarray:
    """Windows of ids, evenly over the whole text of each of a bounded set of documents, chosen by hash."""
    total = rows.count()
    chance = min(1.0, 1.3 * max_docs / max(1, total))
    hashed = F.xxhash64(F.lit(17), "doc_id")
    few = rows.filter(hashed.cast("double") <= -(2.0**63) + chance * 2.0**64).orderBy(hashed, "doc_id", F.xxhash64("text")).limit(max_docs)
    each = max(1, max_windows // max_docs)

    def run(batches):
        import pyarrow as pa

        for batch in pieces(batches):
            out = []
            for ids in batch.column(1).to_pylist():
                line = np.concatenate([np.full(WINDOW - STRIDE + 1, end), np.frombuffer(ids, id_type(end)), np.full(WINDOW, end)])
                starts = np.unique(np.linspace(0, max(0, len(line) - 2 * WINDOW), each).astype(int))
                out.append(np.stack([line[s : s + WINDOW + 1] for s in starts]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["windows"])

    got = few.select("doc_id", "ids").mapInArrow(run, "windows binary").collect()
    return np.frombuffer(b"".join(sorted(bytes(r.windows) for r in got)), "<u4").reshape(-1, WINDOW + 1).astype(np.int64)


def word_counts(coded: DataFrame) -> DataFrame:
    """(h, c): hash and count of every word, of the rows of words that ``encoded`` made."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, "<i8")) for x in own], ["h", "c"])

    return coded.filter("h is not null").select("h", "c").mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def words_of(texts: list[str | None], logs: Table, held: int = 1 << 18):
    """By text: its words, how many of them ``logs`` has, the sum of their logs; lists of the other words' hashes and counts.

    About ``held`` words are looked up at a time.
    """
    import pyarrow as pa
    import xxhash

    size, known, base = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts))
    waiting, others, first = [], [], 0

    def look_up(end: int):
        h, owner = np.concatenate(waiting), np.repeat(np.arange(first, end), size[first:end])
        slot = logs.find(h)
        hit = logs.full.take(slot)
        np.add(known, np.bincount(owner, hit, len(texts)).astype(np.int64), out=known)
        np.add(base, np.bincount(owner, logs.value.take(slot), len(texts)), out=base)
        others.append((owner[~hit], h[~hit]))
        waiting.clear()

    for i, t in enumerate(texts):
        words = (t or "").encode().lower().split()
        size[i] = len(words)
        waiting.append(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64))
        if i + 1 == len(texts) or size[first : i + 1].sum() >= held:
            look_up(i + 1)
            first = i + 1
    owner, h = (np.concatenate(c) for c in zip(*others, strict=True)) if others else (np.zeros(0, np.int64),) * 2
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    start = np.flatnonzero(np.diff(owner, prepend=-1).astype(bool) | np.diff(h, prepend=0).astype(bool))
    tf = np.diff(start, append=len(h))
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[start], minlength=len(texts)))]).astype(np.int32))
    return size, known, base, [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (h[start], tf)]


def score(docs: DataFrame, path: str, pattern: str, held_out, key: str = "doc_id", text: str = "text", end: int = 50256,
          common: int = 100_000, max_docs: int = 1024, max_windows: int = 32_768, max_pairs: int = 1_000_000, steps: int = 400) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    held_out: a Column over doc_id; rows where it is false are learned from.
    Null and empty texts have one token, the end. Without any row to learn
    from, counts are zero and every id of the model is as likely as any.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("held_out", held_out)
    coded = stored(encoded(rows, path, pattern, end), "ids")
    rows = coded.filter("h is null").drop("h", "c")
    training = rows.filter(~F.col("held_out"))
    counts = stored(word_counts(coded), "words")
    ends = training.count()
    sums = counts.agg(F.count("*").alias("v"), F.sum("c").alias("n")).first()
    n, v = (sums.n or 0) + ends, sums.v + (ends > 0)
    top = most_frequent(counts, common).toPandas().sort_values("h")
    windows = training_windows(training, end, max_docs, max_windows)
    if len(windows):
        pairs = stored(pair_counts(training, end + 1, end), "pairs")
        model = fit(windows, end + 1, end, steps, contexts=context_counts(pairs, end + 1))
        model.follows = frequent_follows(pairs, end + 1, max_pairs)
        model = train_on_all(model, training)
    else:
        model = fit(np.full((1, WINDOW + 1), end), end + 1, end, 0)
    scale = np.log10(n + 0.1 * (v + 1))
    end_log = float(np.log10(ends + 0.1) - scale)
    logs = Table(top["h"].to_numpy(np.int64), np.log10(top["c"].to_numpy(np.int64) + 0.1) - scale)
    shared = spark.sparkContext.broadcast((model, logs))  # bounded by ``common`` and ``max_pairs``

    def run(batches):
        import pyarrow as pa

        kept_parts.cache_clear()
        hold()
        lm, logs = shared.value
        for batch in pieces(batches, 64):
            ids = [np.frombuffer(coded, id_type(end)) for coded in batch.column(3).to_pylist()]
            n_tokens, known, base, rest = words_of(batch.column(1).to_pylist(), logs)
            columns = [pa.array(n_tokens + 1), pa.array(known + (ends > 0)), pa.array(base + end_log), pa.array(lm.score(ids), pa.float64()), *rest]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "held_out", "n_tokens", "known", "base", "score", "h", "tf"])
        trim()

    out = stored(rows.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, h array<long>, tf array<long>").withColumn("rid", F.monotonically_increasing_id()), "scores")
    rest = out.select("rid", F.explode(F.arrays_zip("h", "tf")).alias("w")).select("rid", "w.h", "w.tf")
    c = F.coalesce("c", F.lit(0))
    judged = rest.join(counts.hint("shuffle_hash"), "h", "left").groupBy("rid").agg(F.sum(F.col("tf") * (F.log10(c + 0.1) - float(scale))).alias("more"), F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("found"))
    return out.drop("h", "tf").join(judged, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("found", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )

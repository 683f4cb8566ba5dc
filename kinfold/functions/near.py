"""Pairs of 64-bit hashes within some bits, in numpy: one block against another."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np

#: A candidate that a band finds costs as much as comparing this many neighbours in memory.
GATHER = 12
CHUNK = 1 << 20


def bands_of(varying: list[int], most: int) -> list[tuple[list[int], int]]:
    """(bits, radius) of the bands for which probing random hashes costs least; none if comparing all does.

    Of n bands of the bits that vary one differs in at most most // n bits (pigeonhole).
    """
    best, least = [], 1.0
    for n in range(1, min(16, len(varying)) + 1):
        radius, width = most // n, len(varying) // n
        probes = sum(comb(width, r) for r in range(radius + 1))
        cost = GATHER * n * probes / 2**width
        if radius <= 2 and probes <= 512 and width <= 24 and cost < least:
            best, least = [(varying[i::n], radius) for i in range(n)], cost
    return best


def _band(values: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(values), np.int64)
    for i, bit in enumerate(bits):
        out |= ((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << i
    return out


def _probes(one: np.ndarray, other: np.ndarray, bands) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(order, lo, hi): what a probe of ``one`` meets are the places lo to hi of ``other`` in that order."""
    for bits, radius in bands:
        order = np.argsort(_band(other, bits), kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(_band(other, bits), minlength=1 << len(bits)))])
        key = _band(one, bits)
        for mask in (sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(len(bits)), r)):
            yield order, ends[key ^ mask], ends[(key ^ mask) + 1]


def near(one: np.ndarray, other: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of all pairs of ``one`` and ``other`` (uint64) that differ in at most ``most`` bits; some come twice."""
    if not len(one) or not len(other):
        return
    varying = int(np.bitwise_or.reduce(one ^ one[0]) | np.bitwise_or.reduce(other ^ one[0]))
    bands = bands_of([b for b in range(64) if varying >> b & 1], most)
    if bands and sum(int((hi - lo).sum()) for _, lo, hi in _probes(one, other, bands)) * GATHER < len(one) * len(other):
        for order, lo, hi in _probes(one, other, bands):
            met = np.cumsum(hi - lo)
            at = 0
            while at < len(one):  # CHUNK candidates at a time, or those of one row
                before = met[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(met, before + CHUNK, "right")))
                count = (hi - lo)[at:to]
                i = np.repeat(np.arange(at, to), count)
                j = order[np.arange(len(i)) + np.repeat(lo[at:to] - np.cumsum(count) + count, count)]
                hit = np.bitwise_count(one[i] ^ other[j]) <= most
                if hit.any():
                    yield i[hit], j[hit]
                at = to
        return
    for i, x in enumerate(one):
        j = np.flatnonzero(np.bitwise_count(other ^ x) <= most)
        if len(j):
            yield np.full(len(j), i), j


class Forest:
    """Which links join what no link before has joined."""

    def __init__(self, n: int):
        self.top = list(range(n))

    def root(self, i: int) -> int:
        top = self.top
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    def joins(self, i: int, j: int) -> bool:
        x, y = self.root(i), self.root(j)
        self.top[x] = y
        return x != y

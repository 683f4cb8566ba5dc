"""60-bit SimHash of the words of a text: in DataFrame functions, and of whole texts in numpy."""

from __future__ import annotations

import re
from hashlib import md5

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 60
#: Hashes of units that a task keeps.
KEPT = 200_000


def word_bits(word: Column) -> Column:
    """The first 15 hexadecimal digits of the word's md5 as a number."""
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 15), 16, 10).cast("long")


def simhash(words: DataFrame, key: list[str], word: str = "word") -> DataFrame:
    """Rows (key..., fp): a bit is set if more than half of the key's distinct words have it."""
    distinct = words.select(*key, word_bits(F.col(word)).alias("h")).distinct()
    # packed partial sums: one count per bit and one total, combined map-side
    ones = [F.sum(F.shiftright("h", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(BITS)]
    sums = distinct.groupBy(*key).agg(F.count("*").alias("n"), *ones)
    bits = [F.when(2 * F.col(f"b{b}") > F.col("n"), F.lit(1 << b)).otherwise(F.lit(0)).cast("long") for b in range(BITS)]
    fp = bits[0]
    for b in bits[1:]:
        fp = fp.bitwiseOR(b)
    return sums.select(*key, fp.alias("fp"))


def units_of(text: str, kind: str) -> set[str]:
    """Distinct ``words`` (ASCII), ``pairs`` of neighbouring words or runs of four ``chars``."""
    if kind == "chars":
        return {text[i : i + 4] for i in range(len(text) - 3)}
    words = re.findall(r"\w+", text, re.ASCII)
    return set(words) if kind == "words" else {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


class Hasher:
    """SimHash of a set of units, as ``simhash`` has it; None without any."""

    def __init__(self):
        self.known: dict[str, bytes] = {}

    def __call__(self, units: set[str]) -> int | None:
        if not units:
            return None
        if len(self.known) > KEPT:
            self.known.clear()
        known, out = self.known, []
        for u in units:
            if (h := known.get(u)) is None:
                h = known[u] = md5(u.encode()).digest()[:8]
            out.append(h)
        hashes = np.unique(np.frombuffer(b"".join(out), ">u8") >> np.uint64(64 - BITS))
        ones = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 1 << 16):
            ones += np.unpackbits(hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
        return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def text_simhashes(kind: str):
    """mapInArrow function: (id, text) to (id, fp), for texts that have units of the kind; words are of lower-cased texts."""

    def run(batches):
        import pyarrow as pa

        hasher = Hasher()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fps = pa.array([None if t is None else hasher(units_of(t, kind)) for t in part.column(1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), fps], ["id", "fp"]).filter(fps.is_valid())

    return run

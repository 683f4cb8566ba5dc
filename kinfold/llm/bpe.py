"""Byte-level BPE as a monoid over text ranges.

``TreeCodec`` encodes the halves of a text recursively. Its join re-encodes a
window around the seam that grows on either side until it meets a certain
boundary (or the node's end); tokens outside the window then provably stay.
Decoding concatenates bytes up the same tree.

A boundary is *certain* where a space stands between two non-white characters:
the split pattern never matches across the place just before such a space, so
both sides encode independently of each other.
"""

from __future__ import annotations

import base64
import json
from functools import cache

import numpy as np

# The split pattern of the tokenizers library's byte-level files, and the bytes that
# such files write as themselves; they write the others as characters from 256 on, in order.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
OWN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]


class Encoder:
    """Text to unsigned 32-bit ids by byte-pair ranks, each match of the split pattern on its own.

    special: strings that stand for one id each, wherever they occur.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str, special: dict[str, int] | None = None):
        import tiktoken

        self.special = special or {}
        self.own = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.known = frozenset(self.special)
        self.sizes = np.zeros(1 + max([*ranks.values(), *self.special.values()]), np.int64)
        self.spaced = np.zeros(len(self.sizes), bool)  # ids that begin with a space
        for raw, i in ranks.items():
            self.sizes[i], self.spaced[i] = len(raw), raw[:1] == b" "
        for said, i in self.special.items():
            self.sizes[i] = len(said.encode())

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        return self.own.encode_to_numpy(text, allowed_special=self.known, disallowed_special=())


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@cache
def rank_encoder(path: str, pattern: str) -> Encoder:
    """By a rank file. Made once in a Python worker, which Spark reuses for later tasks."""
    return Encoder(read_ranks(path), pattern)


@cache
def json_encoder(path: str) -> Encoder:
    """By a byte-level file of the tokenizers library: the ids of its ``encode(text, add_special_tokens=False)``.

    The library takes merges in their order in the file. Where that is the
    order of the merged ids, as in files trained the usual way, ranks say the
    same; tests compare the two. Strings of added tokens in a text are those
    tokens, as in the library.
    """
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    model, split = said["model"], said["pre_tokenizer"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if model["type"] != "BPE" or split["type"] != "ByteLevel" or split["add_prefix_space"] or said["normalizer"] or ids != sorted(ids):
        raise ValueError(f"{path} isn't a plain byte-level file")
    own = {chr(b): b for b in OWN_BYTES}
    own |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in own)}
    ranks = {bytes(own[c] for c in token): i for token, i in model["vocab"].items()}
    return Encoder(ranks, BYTE_LEVEL, {t["content"]: t["id"] for t in said["added_tokens"]})


class TreeCodec:
    """Encode and decode by tree reduction; ``leaf`` is the most characters (encoding) or ids (decoding) of a leaf."""

    def __init__(self, encoder: Encoder, token_bytes: dict[int, bytes] | None = None, leaf: int = 512, window: int = 64):
        self.encoder, self.token_bytes, self.leaf, self.window = encoder, token_bytes, leaf, window

    def encode(self, text: str) -> np.ndarray:
        return self._node(text, 0, len(text))

    def _node(self, text: str, lo: int, hi: int) -> np.ndarray:
        if hi - lo <= self.leaf:
            return self.encoder(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join(text, lo, mid, hi, self._node(text, lo, mid), self._node(text, mid, hi))

    def _join(self, text: str, lo: int, mid: int, hi: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of text[lo:hi] from those of its parts before and from ``mid``."""
        a, w = lo, self.window
        while mid - w > lo and (a := _boundary(text, mid - w, mid, last=True)) < 0:
            a, w = lo, 2 * w
        b, w = hi, self.window
        while mid + w < hi and (b := _boundary(text, mid, mid + w, last=False)) < 0:
            b, w = hi, 2 * w
        # what the parts' ids have inside the window: both sides of a certain boundary stand apart, so ids end there
        gone, over = self._ids_of(left, len(text[a:mid].encode()), last=True), self._ids_of(right, len(text[mid:b].encode()), last=False)
        return np.concatenate([left[: len(left) - gone], self.encoder(text[a:b]), right[over:]])

    def _ids_of(self, ids: np.ndarray, size: int, last: bool) -> int:
        """How many of the last or first ids make up ``size`` bytes."""
        if not size:
            return 0
        some = ids[-size:][::-1] if last else ids[:size]
        sizes = np.cumsum(self.encoder.sizes[some])
        n = int(np.searchsorted(sizes, size)) + 1
        assert sizes[n - 1] == size
        return n

    def decode(self, ids) -> bytes:
        if len(ids) <= self.leaf:
            return b"".join(map(self.token_bytes.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def _boundary(text: str, lo: int, hi: int, last: bool) -> int:
    """The last or first certain boundary whose three characters lie in text[lo:hi], or -1."""
    p = text.rfind(" ", lo + 1, hi - 1) if last else text.find(" ", lo + 1, hi - 1)
    while p >= 0:
        if not text[p - 1].isspace() and not text[p + 1].isspace():
            return p
        p = text.rfind(" ", lo + 1, p) if last else text.find(" ", p + 1, hi - 1)
    return -1


@cache
def token_bytes(path: str) -> dict[int, bytes]:
    return {rank: raw for raw, rank in read_ranks(path).items()}


def codec_rows(path: str, pattern: str):
    """mapInArrow function: (key, text) to n_tokens, digests of the ids and of the decoded bytes."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        from .common import pieces

        token = token_bytes(path)
        words = list(map(str, range(1 + max(token))))
        codec = TreeCodec(rank_encoder(path, pattern), token)
        for batch in pieces(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text or "").tolist()
                said = ",".join(map(words.__getitem__, ids)).encode()
                rows.append((len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_rows(path: str, pattern: str):
    """mapInArrow function: (key, text) to the key, ids and decoded bytes: the operator's real outputs."""

    def run(batches):
        import pyarrow as pa

        from .common import pieces

        codec = TreeCodec(rank_encoder(path, pattern), token_bytes(path))
        for batch in pieces(batches):
            ids = [codec.encode(t or "").tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([codec.decode(x) for x in ids], pa.binary())],
                ["doc_id", "ids", "decoded"],
            )

    return run


def encode(docs, path: str, pattern: str, key: str = "doc_id", text: str = "text"):
    """Rows (doc_id, ids array<int>, decoded binary); a null text counts as empty, every row gives one row."""
    from pyspark.sql import functions as F

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(encode_rows(path, pattern), "doc_id long, ids array<int>, decoded binary")


def digests(docs, path: str, pattern: str, key: str = "doc_id", text: str = "text"):
    """Rows (doc_id, n_tokens, ids_sha256, decoded_sha256) of the same encoding and decoding.

    The digests are made beside the codec, so that ids of whole corpora don't
    travel through Arrow. Nulls and empty texts give no tokens.
    """
    from pyspark.sql import functions as F

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return rows.mapInArrow(codec_rows(path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

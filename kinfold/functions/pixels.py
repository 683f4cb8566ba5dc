"""Perceptual hashes of luma planes as numpy kernels, for use inside mapInPandas or mapInArrow."""

from __future__ import annotations

import numpy as np

_I = np.arange(32)
DCT = np.cos(np.pi * (2 * _I[None] + 1) * np.arange(8)[:, None] / 64)
PLACES = np.array([1 << i for i in range(64)], dtype=np.uint64)


def luma(pixels: np.ndarray) -> np.ndarray:
    """Integer luma of gray (h, w) or (h, w, 1), RGB or RGBA pixels; alpha doesn't count, as colours aren't premultiplied."""
    if pixels.ndim == 2 or pixels.shape[-1] == 1:
        return pixels.reshape(pixels.shape[:2]).astype(np.int64)
    r, g, b = (pixels[..., i].astype(np.int64) for i in range(3))
    return (299 * r + 587 * g + 114 * b) // 1000


def unmultiplied(rgba: np.ndarray) -> np.ndarray:
    """RGBA whose colours were multiplied by alpha, as plain colours; those of clear pixels stay."""
    alpha = rgba[..., 3:].astype(np.int64)
    part = (alpha > 0) & (alpha < 255)
    colour = np.where(part, np.minimum(255, rgba[..., :3].astype(np.int64) * 255 // np.maximum(alpha, 1)), rgba[..., :3])
    return np.concatenate([colour, alpha], -1)


def shrunk(pixels: np.ndarray, most: int = 240) -> np.ndarray:
    """Pixels fitted into a square by nearest samples, in 16-bit fixed point with rounding; never grown."""
    h, w = pixels.shape[:2]
    scale = min(1.0, most / max(h, w))
    size = [max(1, int(x * scale + 0.5)) for x in (h, w)]
    rows, cols = (np.minimum(old - 1, (np.arange(new) * ((old << 16) // new) + 0x8000) >> 16) for old, new in zip((h, w), size, strict=True))
    return pixels[rows][:, cols]


def png(pixels: np.ndarray) -> bytes:
    """A PNG file of gray, RGB or RGBA pixels."""
    import struct
    import zlib

    pixels = pixels.reshape(*pixels.shape[:2], -1).astype(np.uint8)
    h, w, channels = pixels.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    lines = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], 1).tobytes()
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[channels], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines, 6)) + chunk(b"IEND", b"")


def sampled(plane: np.ndarray, across: int, down: int) -> np.ndarray:
    """Nearest samples."""
    h, w = plane.shape
    return plane[np.arange(down) * h // down][:, np.arange(across) * w // across].astype(np.int64)


def pack(bits: np.ndarray) -> int:
    """64 booleans to a signed bit pattern."""
    return int(PLACES[bits.ravel()].sum(dtype=np.uint64).astype(np.int64))


def dhash(plane: np.ndarray) -> int:
    if not plane.size:
        return 0
    g = sampled(plane, 9, 8)
    return pack(g[:, :-1] > g[:, 1:])


def ahash(plane: np.ndarray) -> int:
    if not plane.size:
        return 0
    g = sampled(plane, 8, 8)
    return pack(g > g.sum() // 64)


def phash(plane: np.ndarray) -> int:
    """Signs of the low DCT coefficients against their median; the constant term is never set."""
    if not plane.size:
        return 0
    c = DCT @ sampled(plane, 32, 32) @ DCT.T
    bits = c > np.sort(c.ravel()[1:])[31]
    bits[0, 0] = False
    return pack(bits)


def frame_hash(gray: bytes) -> int:
    """pHash of a frame of 32 x 32 gray bytes."""
    return phash(np.frombuffer(gray, np.uint8).reshape(32, 32))


HASHES = {"dhash": dhash, "ahash": ahash, "phash": phash}


def hash_rows(width: int, height: int, kinds=("dhash", "ahash", "phash")):
    """mapInPandas function: (id, pixels: row-major luma) to the id and its hashes."""

    def run(frames):
        for frame in frames:
            planes = [np.asarray(p).reshape(height, width) for p in frame["pixels"]]
            yield frame[["id"]].assign(**{k: [HASHES[k](p) for p in planes] for k in kinds})

    return run

"""Scalar functions as Column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import PARTIAL_CHUNK, PARTIAL_THRESHOLD


def content_hash(content: Column, threshold: int = PARTIAL_THRESHOLD, chunk: int = PARTIAL_CHUNK) -> Column:
    """md5 of the bytes; above the threshold of the first, middle and last chunk and the size (8 bytes, little-endian)."""
    n = F.octet_length(content)
    digits = F.lpad(F.hex(n.cast("long")), 16, "0")
    size = F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)]))
    middle = F.substring(content, F.floor(n / 2).cast("int") - chunk // 2 + 1, F.lit(chunk))
    sampled = F.concat(F.substring(content, 1, chunk), middle, F.substring(content, n - chunk + 1, F.lit(chunk)), size)
    return F.when(n <= threshold, F.md5(content)).otherwise(F.md5(sampled))


def extension(name: Column) -> Column:
    """Lower-case extension after the last dot, without it; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("long")


def duration_close(a: Column, b: Column) -> Column:
    """Within a second, or 1 % of the mean."""
    return F.abs(a - b) <= F.greatest(F.lit(1.0), (a + b) / 2 * 0.01)


def duration_bucket(d: Column) -> Column:
    """Close durations lie in the same or neighbouring buckets: linear to 100 s, then logarithmic."""
    scaled = F.when(d <= 100, d).otherwise(100 * (1 + F.log(F.greatest(d, F.lit(100.0)) / 100)))
    return F.floor(scaled / 1.001)


def bytes_within(a: Column, b: Column, tolerance: float) -> Column:
    return (a > 0) & (b > 0) & (F.abs(a - b) / F.greatest(a, b) <= tolerance)


def _sum(pairs: Column, zero: str = "bigint") -> Column:
    return F.aggregate(pairs, F.lit(0).cast(zero), lambda s, x: s + x)


def _differing_bits(a: Column, b: Column) -> tuple[Column, Column]:
    n = F.least(F.size(a), F.size(b))
    bits = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
    return n, _sum(bits)


def frame_distance(a: Column, b: Column) -> Column:
    """Mean differing bits of paired frame hashes, rounded down; very large if one side has none."""
    n, bits = _differing_bits(a, b)
    return F.when(n > 0, F.floor(bits / n)).otherwise(F.lit(1 << 30)).cast("long")


def audio_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits of paired 32-bit words; 0 if one side has none."""
    n, bits = _differing_bits(a, b)
    return F.when(n > 0, 1 - bits / (32.0 * n)).otherwise(F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """0 if lengths differ or a norm is zero."""
    dot = lambda x, y: _sum(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), "double")
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / F.when(norm > 0, norm).otherwise(F.lit(1.0))).otherwise(F.lit(0.0))


def video_timestamps(duration: Column, n: int = 8) -> Column:
    """Evenly spaced places in 8 % to 92 % of the duration; three for short ones, none if unknown."""
    places = lambda k: F.array(*[duration * (0.08 + 0.84 * i / (k - 1)) if k > 1 else duration * 0.5 for i in range(k)])
    return F.when(duration <= 0, F.array().cast("array<double>")).when(duration < 10, places(3)).otherwise(places(n))


def poster_time(duration: Column) -> Column:
    return F.when(duration <= 0, F.lit(1.0)).otherwise(F.least(duration * 0.2, F.lit(60.0)))


def fitted(width: Column, height: Column, most: int = 240) -> tuple[Column, Column]:
    """Dimensions shrunk, never grown, into a square."""
    scale = F.least(F.lit(1.0), most / F.greatest(width, height))
    return tuple(F.greatest(F.lit(1), F.floor(x * scale + 0.5)).cast("int") for x in (width, height))


def thumb_key(path: Column, size: Column, mod_unix: Column, pixels: int = 240) -> Column:
    return F.sha1(F.concat_ws("|", path, size, mod_unix, F.lit(pixels)))


def in_dir(directory: Column, wanted: str) -> Column:
    """Whether a folder is the wanted one or below it."""
    wanted = wanted.rstrip("/")
    return (directory == wanted) | directory.startswith(wanted + "/")


def grid_hash(pixels: Column, width: int, height: int, kind: str) -> Column:
    """dHash or aHash of a row-major luma array, by nearest samples, as a bit pattern (bit 8 * y + x)."""
    across = 9 if kind == "dhash" else 8
    at = lambda x, y: F.get(pixels, (y * height // 8) * width + x * width // across).cast("long")
    if kind == "dhash":
        bits = [(8 * y + x, at(x, y) > at(x + 1, y)) for y in range(8) for x in range(8)]
    else:
        cells = [at(x, y) for y in range(8) for x in range(8)]
        mean = F.floor(reduce(lambda a, b: a + b, cells) / 64)
        bits = [(i, c > mean) for i, c in enumerate(cells)]
    return reduce(lambda a, b: a.bitwiseOR(b), [F.when(on, F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")) for i, on in bits])

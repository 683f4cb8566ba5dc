"""Media fingerprints by external tools, where they are installed; their output is parsed in DataFrame functions."""

from __future__ import annotations

import json
import os
import re
import shutil
import subprocess

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import FRAMES, IMAGES, LEAST_AUDIO_WORDS, LONG_VIDEO_SECONDS, SIGNATURE_BINS
from ..functions.pixels import HASHES, frame_hash, luma
from ..functions.scalar import extension

# How a decoder's log names the time of a frame, and seconds given to a probe and to frames.
PTS_TIME = r"pts_time:\s*([0-9]+\.?[0-9]*)"
PROBE_SECONDS, FRAME_SECONDS = 30, 60
FRAME_BYTES = 32 * 32
PLAIN = ("ppm", "pgm", "pnm")

PROBE = "streams array<struct<width:int,height:int>>, format struct<duration:string>"
ACOUSTIC = "duration double, fingerprint array<bigint>"


def tools(names=("ffprobe", "ffmpeg", "fpcalc", "magick")) -> dict[str, str | None]:
    """Places of the tools on this machine, None if absent."""
    return {n: shutil.which(n) for n in names}


def effective_mode(mode: str, found: dict[str, str | None]) -> str:
    """visual and acoustic fall back to exact without their tools."""
    need = {"visual": ("ffprobe", "ffmpeg"), "acoustic": ("fpcalc",)}.get(mode, ())
    return mode if all(found.get(n) for n in need) else "exact"


def run_tool(files: DataFrame, command: list[str], timeout: float = 60, out: str = "out") -> DataFrame:
    """The tool's output for each path, {} in the command standing for it; null on failure, absence or timeout."""

    def run(frames):
        for frame in frames:
            said = []
            for path in frame["path"]:
                try:
                    p = subprocess.run([path if c == "{}" else c for c in command], capture_output=True, timeout=timeout)
                    said.append(p.stdout.decode("utf-8", "replace") if p.returncode == 0 else None)
                except (OSError, subprocess.SubprocessError):
                    said.append(None)
            yield frame[["path"]].assign(**{out: said})

    return files.select("path").mapInPandas(run, f"path string, {out} string")


def parse_probe(said: Column) -> Column:
    """struct(duration, width, height) of a probe's JSON; null without a positive duration."""
    j = F.from_json(said, PROBE)
    duration = F.try_to_number(j["format"]["duration"], F.lit("999999999.999999")).cast("double")
    one = F.get(j["streams"], 0)
    return F.when(duration > 0, F.struct(duration.alias("duration"), one["width"].alias("width"), one["height"].alias("height")))


def parse_acoustic(said: Column) -> Column:
    """struct(duration, fingerprint); null without a positive duration or any word."""
    j = F.from_json(said, ACOUSTIC)
    return F.when((j["duration"] > 0) & (F.size(j["fingerprint"]) > 0), j)


def usable_acoustic(parsed: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    return parsed.filter(F.size(fingerprint) >= LEAST_AUDIO_WORDS)


def keyframe_times(log: Column) -> Column:
    """Times that a decoder's log names."""
    return F.transform(F.regexp_extract_all(log, F.lit(PTS_TIME), F.lit(1)), lambda t: t.cast("double"))


def nearest_index(times: Column, target: Column) -> Column:
    """Index of the time nearest to the target, the first of equals."""
    return F.array_min(F.transform(times, lambda t, i: F.struct(F.abs(t - target).alias("d"), i.alias("i"))))["i"]


def packet_signature(sizes: DataFrame, key: list[str], index: str, size: str, least: int = SIGNATURE_BINS, bins: int = SIGNATURE_BINS) -> DataFrame:
    """(key, psig): sizes in sequence summed into bins and scaled to a sum of 1; none for short or empty series."""
    totals = sizes.groupBy(*key).agg(F.count("*").alias("n"), F.sum(size).alias("total")).filter((F.col("n") >= least) & (F.col("total") > 0))
    binned = sizes.join(totals, key).groupBy(*key, F.floor(F.col(index) * bins / F.col("n")).cast("int").alias("bin")).agg((F.sum(size) / F.first("total")).alias("v"))
    held = binned.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("bin", "v"))).alias("m"))
    return held.select(*key, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.coalesce(F.get(F.array(F.element_at("m", b)), 0), F.lit(0.0)).cast("float")).alias("psig"))


def decoded_images(spark, files: DataFrame) -> DataFrame:
    """``files`` (with path) with id, width, height, dhash, ahash, phash, decoded and format; undecodable files stay, with nulls.

    Plain formats are decoded here, others by a converter, if one is installed.
    """
    images = files.filter(extension(F.col("name")).isin(*IMAGES, *PLAIN))
    read = images.select("path").mapInPandas(_hash_images, "path string, width int, height int, dhash long, ahash long, phash long")
    named = F.regexp_replace(extension(F.col("name")), "^jpeg$", "jpg")
    out = files.join(read, "path", "left").withColumns({"decoded": F.col("dhash").isNotNull(), "format": named})
    return out.withColumn("id", F.xxhash64("path"))


def _hash_images(frames):
    for frame in frames:
        rows = []
        for path in frame["path"]:
            pixels = read_image(path)
            plane = None if pixels is None else luma(pixels)
            rows.append((path, *((None,) * 5 if plane is None else (plane.shape[1], plane.shape[0], *(HASHES[k](plane) for k in ("dhash", "ahash", "phash"))))))
        import pandas as pd

        out = pd.DataFrame(rows, columns=["path", "width", "height", "dhash", "ahash", "phash"])
        yield out.astype({c: "Int64" for c in out.columns[1:]})


def read_image(path: str) -> np.ndarray | None:
    """Pixels (h, w) or (h, w, channels) of an image: plain PNG and PNM by this library, others by an external converter, if there is one."""
    try:
        with open(path, "rb") as f:
            raw = f.read()
    except OSError:
        return None
    pixels = decode_png(raw) if raw[:8] == b"\x89PNG\r\n\x1a\n" else decode_pnm(raw)
    if pixels is None:
        for command in (["magick", path, "ppm:-"], ["convert", path, "ppm:-"], ["ffmpeg", "-v", "error", "-i", path, "-frames:v", "1", "-f", "image2pipe", "-c:v", "ppm", "-"]):
            said = _run(command, FRAME_SECONDS)
            if said and (pixels := decode_pnm(said[0])) is not None:
                break
    return pixels


def decode_pnm(raw: bytes) -> np.ndarray | None:
    """Binary gray and colour PNM of 8 bits."""
    m = re.match(rb"P([56])\s+(\d+)\s+(\d+)\s+255\s", raw)
    if not m:
        return None
    channels, w, h = (1, 3)[m[1] == b"6"], int(m[2]), int(m[3])
    data = np.frombuffer(raw, np.uint8, offset=m.end())
    return data[: w * h * channels].reshape(h, w, channels) if len(data) >= w * h * channels else None


def decode_png(raw: bytes) -> np.ndarray | None:
    """PNG of 8 bits a channel, without interlacing; None for others and for torn files."""
    import struct
    import zlib

    at, data, head, palette = 8, b"", None, None
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", body) if kind == b"IHDR" else head
        palette = np.frombuffer(body, np.uint8).reshape(-1, 3) if kind == b"PLTE" else palette
        data += body if kind == b"IDAT" else b""
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 3, 4, 6):
        return None
    w, h, channels = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    try:
        lines = np.frombuffer(zlib.decompress(data), np.uint8)
    except zlib.error:
        return None
    if len(lines) != h * (w * channels + 1):
        return None
    lines = lines.reshape(h, -1)
    out = np.zeros((h + 1, (w + 1) * channels), np.uint8)
    for y in range(h):
        _unfilter(int(lines[y, 0]), lines[y, 1:], out[y], out[y + 1], channels)
    pixels = out[1:, channels:].reshape(h, w, channels)
    if head[3] == 3:
        return palette[pixels[..., 0]]
    return pixels[..., :1] if head[3] == 4 else pixels


def _unfilter(kind: int, line: np.ndarray, above: np.ndarray, out: np.ndarray, step: int) -> None:
    """Undo a line's filter into ``out``, which like ``above`` has a pixel of zeros on its left."""
    if kind in (0, 2):
        out[step:] = line + (above[step:] if kind == 2 else 0)
        return
    for c in range(step):
        if kind == 1:
            out[step + c :: step] = np.cumsum(line[c::step], dtype=np.uint8)
            continue
        left = upper = 0
        for x, (v, up) in enumerate(zip(line[c::step].tolist(), above[step + c :: step].tolist(), strict=True), 1):
            if kind == 3:
                guess = (left + up) // 2
            else:
                p = left + up - upper
                guess = min((left, up, upper), key=lambda q, p=p: abs(p - q))
            left, upper = (v + guess) % 256, up
            out[x * step + c] = left


def _run(command: list[str], timeout: float) -> tuple[bytes, str] | None:
    """A tool's output and log; None if it is absent, fails or takes too long."""
    try:
        p = subprocess.run(command, capture_output=True, timeout=timeout)
    except (OSError, subprocess.SubprocessError):
        return None
    return (p.stdout, p.stderr.decode("utf-8", "replace")) if p.returncode == 0 else None


def probe_video(path: str, ffprobe: str = "ffprobe") -> tuple[float, int, int] | None:
    """(duration, width, height) of the first video stream; None without a positive duration."""
    said = _run([ffprobe, "-v", "error", "-select_streams", "v:0", "-show_entries", "stream=width,height:format=duration", "-of", "json", path], PROBE_SECONDS)
    try:
        found = json.loads(said[0])
        duration, stream = float(found["format"]["duration"]), (found.get("streams") or [{}])[0]
    except (TypeError, ValueError, KeyError):
        return None
    return (duration, int(stream.get("width") or 0), int(stream.get("height") or 0)) if duration > 0 else None


def packet_sizes(path: str, ffprobe: str = "ffprobe") -> list[float]:
    """Sizes of the packets of the first video stream; empty if there are fewer than the signature's bins."""
    said = _run([ffprobe, "-v", "error", "-select_streams", "v:0", "-show_entries", "packet=size", "-of", "csv=p=0", path], PROBE_SECONDS)
    sizes = [float(x) for x in re.findall(r"^\s*(\d+)", said[0].decode("ascii", "replace"), re.M)] if said else []
    return sizes if len(sizes) >= SIGNATURE_BINS else []


def packet_bins(sizes: list[float], bins: int = SIGNATURE_BINS) -> list[float] | None:
    """``packet_signature`` of one video."""
    if not sizes or sum(sizes) <= 0:
        return None
    total = np.bincount(np.arange(len(sizes)) * bins // len(sizes), sizes, bins)
    return (total / total.sum()).astype(np.float32).tolist()


def frame_times(duration: float, n: int = FRAMES) -> list[float]:
    """As ``video_timestamps``: n places in 8 % to 92 % of the duration, three for short videos."""
    if duration <= 0:
        return []
    n = 3 if duration < 10 else n
    return [duration * (0.08 + 0.84 * i / (n - 1)) for i in range(n)] if n > 1 else [duration / 2]


def frames_of(path: str, before: list[str], after: list[str], ffmpeg: str) -> tuple[list[bytes], list[float]]:
    """Gray frames of 32 x 32 that the decoder writes, and the times that its log names."""
    said = _run([ffmpeg, "-v", "info", "-nostdin", *before, "-i", path, *after, "-f", "rawvideo", "-pix_fmt", "gray", "-"], FRAME_SECONDS)
    if not said or len(said[0]) % FRAME_BYTES:
        return [], []
    return [said[0][i : i + FRAME_BYTES] for i in range(0, len(said[0]), FRAME_BYTES)], [float(t) for t in re.findall(PTS_TIME, said[1])]


def keyframe_pass(path: str, duration: float, ffmpeg: str) -> list[bytes]:
    """The keyframes nearest to the wanted times; none if frames and times don't pair up or there are fewer than three."""
    frames, times = frames_of(path, ["-skip_frame", "nokey"], ["-vf", "scale=32:32,showinfo", "-vsync", "0"], ffmpeg)
    if len(frames) != len(times) or len(frames) < 3:
        return []
    return [frames[min(range(len(times)), key=lambda i: abs(times[i] - t))] for t in frame_times(duration)]


def single_pass(path: str, duration: float, ffmpeg: str) -> list[bytes]:
    """All frames by one decoding run from the first wanted time on."""
    times = frame_times(duration)
    if len(times) < 2:
        return []
    rate = (len(times) - 1) / (times[-1] - times[0])
    frames, _ = frames_of(path, ["-ss", f"{times[0]:.3f}"], ["-vf", f"fps={rate:.6f},scale=32:32", "-frames:v", str(len(times))], ffmpeg)
    return frames if len(frames) >= 3 else []


def seek_pass(path: str, duration: float, ffmpeg: str, keyframes: bool) -> list[bytes]:
    """One run a frame: exact, or at the keyframe before the time."""
    out = []
    for t in frame_times(duration):
        frames, _ = frames_of(path, [*(["-skip_frame", "nokey"] if keyframes else []), "-ss", f"{t:.3f}"], ["-frames:v", "1", "-vf", "scale=32:32"], ffmpeg)
        out += frames[:1]
    return out


def fingerprint_video(path: str, duration: float, ffmpeg: str = "ffmpeg") -> list[int] | None:
    """Frame hashes by the first way that gives three frames or more: cheap ones first, other ones for long videos."""
    short = duration <= LONG_VIDEO_SECONDS
    ways = [lambda: keyframe_pass(path, duration, ffmpeg), lambda: single_pass(path, duration, ffmpeg)] if short else [lambda: seek_pass(path, duration, ffmpeg, True)]
    for way in [*ways, lambda: seek_pass(path, duration, ffmpeg, False)]:
        if len(frames := way()) >= 3:
            return [frame_hash(f) for f in frames]
    return None


def scan_videos(files: DataFrame, ffprobe: str = "ffprobe", ffmpeg: str = "ffmpeg", with_frames: bool = True) -> DataFrame:
    """(path, duration, width, height, psig, vhashes); nulls for what a tool doesn't give."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for path in frame["path"]:
                duration, width, height = probe_video(path, ffprobe) or (None, None, None)
                hashes = fingerprint_video(path, duration, ffmpeg) if duration and with_frames else None
                rows.append((path, duration, width, height, packet_bins(packet_sizes(path, ffprobe)) if duration else None, hashes))
            yield pd.DataFrame(rows, columns=["path", "duration", "width", "height", "psig", "vhashes"]).astype({"width": "Int64", "height": "Int64"})

    return files.select("path").mapInPandas(run, "path string, duration double, width int, height int, psig array<float>, vhashes array<long>")


def scan_audio(files: DataFrame, fpcalc: str = "fpcalc") -> DataFrame:
    """(path, duration, ahashes) of audio files with a usable fingerprint."""
    said = run_tool(files, [fpcalc, "-json", "-raw", "-length", "0", "{}"], timeout=120)
    parsed = said.select("path", parse_acoustic(F.col("out")).alias("a")).select("path", "a.duration", F.col("a.fingerprint").alias("ahashes"))
    return usable_acoustic(parsed, "ahashes")


class ToolPaths:
    """Places of the external tools, in a JSON file; a missing or broken file is an empty one."""

    def __init__(self, path: str):
        self.path, self.known = path, {}
        try:
            with open(path, encoding="utf-8") as f:
                self.known = {k: v for k, v in json.load(f).items() if isinstance(v, str)}
        except (OSError, ValueError, AttributeError):
            pass

    def of(self, tool: str) -> str | None:
        own = self.known.get(tool)
        return own if own and os.access(own, os.X_OK) else shutil.which(tool)

    def save(self, tool: str, place: str) -> None:
        self.known[tool] = place
        with open(f"{self.path}.new", "w", encoding="utf-8") as f:
            json.dump(self.known, f, indent=1)
        os.replace(f"{self.path}.new", self.path)

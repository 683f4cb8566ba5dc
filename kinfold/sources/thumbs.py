"""Thumbnails: small PNG files by key, written once (a JPEG encoder isn't at hand)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import IMAGES, THUMB_PIXELS, VIDEOS
from ..functions.pixels import png, shrunk
from ..functions.scalar import extension, poster_time, thumb_key
from .media import FRAME_SECONDS, _run, decode_pnm, read_image


def targets(members: DataFrame) -> DataFrame:
    """(path, is_video, thumb): the images and videos among the members, each path once, with its key."""
    ext = extension(F.col("path"))
    some = members.filter(ext.isin(*IMAGES, *VIDEOS)).dropDuplicates(["path"])
    return some.select("path", ext.isin(*VIDEOS).alias("is_video"), thumb_key(F.col("path"), F.col("size"), F.col("mod_unix"), THUMB_PIXELS).alias("thumb"))


def place(folder: str, key: str) -> str:
    return os.path.join(folder, key[:2], key + ".png")


def write_thumbs(wanted: DataFrame, folder: str, durations: DataFrame | None = None, ffmpeg: str = "ffmpeg") -> DataFrame:
    """Write what isn't there yet; rows (thumb, state): there, made or failed. ``folder`` must be shared by the executors.

    Files appear whole, by a rename, so that a task that runs twice does no
    harm. durations: (path, duration) of videos, for their poster's time.
    """
    rows = wanted.select("path", "is_video", "thumb")
    rows = rows.join(durations, "path", "left") if durations is not None else rows.withColumn("duration", F.lit(0.0))
    rows = rows.withColumn("at", poster_time(F.coalesce("duration", F.lit(0.0))))

    def run(frames):
        for frame in frames:
            states = []
            for path, video, key, at in zip(frame["path"], frame["is_video"], frame["thumb"], frame["at"], strict=True):
                file = place(folder, key)
                if os.path.exists(file):
                    states.append("there")
                    continue
                if video:
                    said = _run([ffmpeg, "-v", "error", "-nostdin", "-ss", f"{at:.3f}", "-i", path, "-frames:v", "1", "-f", "image2pipe", "-c:v", "ppm", "-"], FRAME_SECONDS)
                    pixels = decode_pnm(said[0]) if said else None
                else:
                    pixels = read_image(path)
                if pixels is None:
                    states.append("failed")
                    continue
                os.makedirs(os.path.dirname(file), exist_ok=True)
                with open(f"{file}.{os.getpid()}", "wb") as f:
                    f.write(png(shrunk(pixels, THUMB_PIXELS)))
                os.replace(f.name, file)
                states.append("made")
            yield frame[["thumb"]].assign(state=states)

    return rows.select("path", "is_video", "thumb", "at").mapInPandas(run, "thumb string, state string")

"""Spectrogram images of bat recorders, and the clicks in them.

An image is an 8-bit BMP of 64 rows, the highest frequency first (or of 64 columns, turned), darkest where it is
loudest; its first column is a scale.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The recorder's rate, samples a column, bands of an image, and the band that clicks are sought in.
RATE, HOP, BANDS = 176_000, 512, 64
CLICK_HZ = (24_000, 54_000)


def read_bmp(content: bytes) -> np.ndarray | None:
    """Columns by bands, the lowest band first, 0 to 1; null if it is no such image."""
    if content[:2] != b"BM" or len(content) < 54:
        return None
    at, width, height, bits = *struct.unpack("<I", content[10:14]), *struct.unpack("<ii", content[18:26]), *struct.unpack("<H", content[28:30])
    row = -(-width // 4) * 4
    if bits != 8 or width <= 0 or BANDS not in (abs(height), width) or len(content) < at + row * abs(height):
        return None
    image = np.frombuffer(content, np.uint8, row * abs(height), at).reshape(abs(height), row)[:, :width]
    image = image if height < 0 else image[::-1]
    image = image if image.shape[0] == BANDS else np.rot90(image, 1, (1, 0))
    loud = 255.0 - image
    loud[-1] = 1.0  # the lowest band is empty
    return (loud / loud.max())[::-1, 1:].T


def image_frames(found: DataFrame) -> DataFrame:
    """file_id, page, frame, t, mags of image files(path, content), like a spectrogram's; other files give none."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for path, content in zip(x["path"], x["content"]):
                image = read_bmp(bytes(content))
                if image is not None and len(image):
                    yield pd.DataFrame({"file_id": path, "page": 0, "frame": np.arange(len(image)), "t": np.arange(len(image)) * HOP / RATE, "mags": list(image.astype(np.float32))})

    return found.select("path", "content").mapInPandas(cut, "file_id string, page int, frame int, t double, mags array<float>")


def click_frames(frames: DataFrame, factor: float = 1.5) -> DataFrame:
    """Frames whose mean between 24 and 54 kHz lies above the file's by factor deviations."""
    step = RATE / 2 / BANDS
    low, high = int(np.ceil(CLICK_HZ[0] / step)), int(np.floor(CLICK_HZ[1] / step))
    band = F.slice("mags", low + 1, high - low)
    mean = F.aggregate(band, F.lit(0.0), lambda a, m: a + m.cast("double")) / (high - low)
    whole = Window.partitionBy("file_id")
    level = frames.select("file_id", "page", "frame", mean.alias("level"))
    return level.withColumn("on", (F.col("level") > F.avg("level").over(whole) + factor * F.stddev_pop("level").over(whole)).cast("int"))


def clicks(frames: DataFrame, factor: float = 1.5, longest: int = 17) -> DataFrame:
    """file_id, page, s, e: runs of click frames, in frames; runs of more than longest are no clicks."""
    from fieldsong.operators.intervals import run_lengths

    return run_lengths(click_frames(frames, factor), ["file_id", "page"], "frame", "on").where(F.col("e") - F.col("s") <= longest)


def click_spans(found: DataFrame) -> DataFrame:
    """file_id, seconds from a file's first click to its last."""
    return found.groupBy("file_id").agg(((F.max("e") - F.min("s")) * (HOP / RATE)).alias("seconds"))


def bmp_bytes(image: np.ndarray) -> bytes:
    """An image file of columns by bands, 0 to 1, the lowest band first: what read_bmp() reads, but for the lowest band and to 255 steps.

    The column of the scale comes first.
    """
    rows = np.concatenate([np.zeros((1, image.shape[1])), np.floor(255 * np.asarray(image, float))]).T[::-1]
    height, width = rows.shape
    line = np.zeros((height, -(-width // 4) * 4), np.uint8)
    line[:, :width] = 255 - rows
    body = line[::-1].tobytes()
    palette = b"".join(bytes([k, k, k, 0]) for k in range(256))
    at = 54 + len(palette)
    return b"BM" + struct.pack("<IHHI", at + len(body), 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, len(body), 0, 0, 256, 0) + palette + body


def image_files(frames: DataFrame) -> DataFrame:
    """name, content: a BMP of each recording's frames(file_id, frame, mags), of BANDS magnitudes, over the recording's largest."""

    def make(x: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(x.sort_values("frame")["mags"]).astype(float)
        return pd.DataFrame({"name": [f"{x['file_id'].iloc[0]}.bmp"], "content": [bmp_bytes(m / max(m.max(), 1e-300))]})

    return frames.where(F.size("mags") == BANDS).groupBy("file_id").applyInPandas(make, "name string, content binary")

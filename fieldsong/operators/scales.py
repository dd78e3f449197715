"""Scales and clean-up of frames of magnitudes, spectra over several tapers, and upkeep of annotation files."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldsong.operators.signal import KEYS, per_page

#: What is added before a logarithm, and the constants of per-channel energy normalisation.
LOG_OFFSET = 1e-7
GAIN, BIAS, POWER, SECONDS, EPS = 0.8, 10.0, 0.25, 0.060, 1e-6


def decibels(mags: Column) -> Column:
    """Distance from 0 dB, on a scale that is the same for all pages."""
    return F.transform(mags, lambda m: F.abs(10 * F.log10(m + LOG_OFFSET)))


def compressed(mags: Column) -> Column:
    """A power of each magnitude, the logistic function at -1.2."""
    return F.transform(mags, lambda m: F.pow(m, F.lit(1 / (1 + math.exp(1.2)))))


def channel_normalised(mags: Column, hop_s: float) -> Column:
    """Each magnitude over a running mean along its frame's bins, which starts from zero, then compressed."""
    s = 1 - math.exp(-hop_s / SECONDS)
    running = lambda got, m: F.concat(got, F.array(s * m + (1 - s) * F.coalesce(F.try_element_at(got, F.lit(-1)), F.lit(0.0))))
    means = F.aggregate(mags, F.array().cast("array<double>"), running)
    return F.zip_with(mags, means, lambda m, mean: F.pow(m * F.pow(EPS + mean, F.lit(-GAIN)) + BIAS, F.lit(POWER)) - BIAS**POWER)


def median_image(frames: DataFrame, size: int = 5) -> DataFrame:
    """Medians of size by size bins (size odd); the outermost size // 2 frames and bins of a page stay as they are."""
    if size < 1 or size % 2 == 0:
        raise ValueError("size is odd")
    half = size // 2
    page = Window.partitionBy(*KEYS)
    near = F.collect_list("mags").over(page.orderBy("frame").rowsBetween(-half, half))
    place = F.row_number().over(page.orderBy("frame"))
    inner = (F.col("place") > half) & (F.col("place") <= F.col("rows") - half)

    def median(m: Column, k: Column) -> Column:
        box = F.flatten(F.transform("near", lambda row: F.slice(row, k - half + 1, F.lit(size))))
        return F.when((k >= half) & (k < F.size("mags") - half), F.element_at(F.array_sort(box), size * size // 2 + 1)).otherwise(m)

    seen = frames.withColumn("near", near).withColumn("place", place).withColumn("rows", F.count(F.lit(1)).over(page))
    return seen.withColumn("mags", F.when(inner, F.transform("mags", median)).otherwise(F.col("mags"))).drop("near", "place", "rows")


def slepian(n: int, bandwidth: float, k: int) -> np.ndarray:
    """k tapers of n points, most concentrated first: eigenvectors of the tridiagonal matrix that commutes with the concentration problem."""
    i = np.arange(n)
    off = i[1:] * (n - i[1:]) / 2
    matrix = np.diag(((n - 1) / 2 - i) ** 2 * np.cos(2 * np.pi * bandwidth / n)) + np.diag(off, 1) + np.diag(off, -1)
    tapers = np.linalg.eigh(matrix)[1][:, ::-1][:, :k].T
    means, slopes = tapers.sum(axis=1), (tapers * (n - 1 - 2 * i)).sum(axis=1)
    return tapers * np.where(np.where(i[:k] % 2 == 0, means, slopes) < 0, -1.0, 1.0)[:, None]


def multitaper(pages: DataFrame, width: int = 256, hop: int = 128, bandwidth: float = 2.5, k: int = 3) -> DataFrame:
    """file_id, page, frame, t, mags: power of each frame, summed over k tapers; 256 frames are transformed at once."""
    tapers = slepian(width, bandwidth, k)

    def kernel(x: np.ndarray, fs: int) -> dict:
        x = x - x.mean() if len(x) else x
        frames = np.lib.stride_tricks.sliding_window_view(x, width)[: len(x) - width : hop] if len(x) > width else np.empty((0, width))
        mags = [row for i in range(0, len(frames), 256) for row in sum(np.abs(np.fft.rfft(frames[i : i + 256] * v, axis=1)[:, : width // 2]) ** 2 for v in tapers).astype(np.float32)]
        return {"frame": np.arange(len(frames)), "t": np.arange(len(frames)) * hop / fs, "mags": mags}

    return per_page(pages, kernel, "frame int, t double, mags array<float>")


def without_duplicates(segments: DataFrame, by: list[str], species: Column, order: str = "ord") -> DataFrame:
    """The first of segments that are alike once species are spelled alike."""
    alike = Window.partitionBy(*by, "s", "e", "species").orderBy(order)
    return segments.withColumn("species", species).withColumn("nth", F.row_number().over(alike)).where("nth = 1").drop("nth")


def empty_files(files: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """Annotation files without a segment."""
    return files.join(segments.select(*by), by, "left_anti")


def annotated(sounds: DataFrame, annotations: DataFrame, name: str = "path") -> DataFrame:
    """Sound files beside which an annotation file of the same name and .data lies."""
    there = annotations.where(F.col(name).endswith(".data")).select(F.expr(f"substring({name}, 1, length({name}) - 5)").alias(name))
    return sounds.join(there, name, "left_semi")


def species_of_codes(tags: DataFrame, codes: DataFrame, code: str = "code") -> DataFrame:
    """Each tag's species by its code, `Don't Know` for codes that the list hasn't; of repeated codes the last name in order counts."""
    names = codes.groupBy(code).agg(F.max("species").alias("species"))
    return tags.join(names, code, "left").withColumn("species", F.coalesce("species", F.lit("Don't Know")))

"""Pages of samples to frames, energies and intervals. Each kernel works on one page; all else is columns.

A page is a row (file_id, page, fs, samples); kernels return rows that Spark groups, joins and merges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["file_id", "page"]


#: Bytes of columns that per_page() hands on at once.
BATCH_BYTES = 1 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by their keys over all shuffle partitions: little data may be much work, which adaptive execution would draw together in a few tasks."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def per_page(pages: DataFrame, kernel: Callable[[np.ndarray, int], dict], schema: str) -> DataFrame:
    """kernel(samples, fs) gives columns of equal length for each page; many pages' columns are handed on together."""

    def joined(names: list[str], rows: list[tuple]) -> pd.DataFrame:
        sizes = [len(r[2][0]) for r in rows]
        out = {"file_id": np.repeat(np.array([r[0] for r in rows], dtype=object), sizes), "page": np.repeat([r[1] for r in rows], sizes)}
        for k, name in enumerate(names):
            parts = [r[2][k] for r in rows]
            flat = all(isinstance(v, np.ndarray) and v.ndim == 1 for v in parts)
            out[name] = np.concatenate(parts) if flat else [v for part in parts for v in part]
        return pd.DataFrame(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, rows, held = [], [], 0
        for x in batches:
            for file_id, page, fs, samples in zip(x["file_id"], x["page"], x["fs"], x["samples"]):
                got = {k: v.to_numpy() if isinstance(v, pd.Series) else v for k, v in kernel(np.asarray(samples, dtype=float), int(fs)).items()}
                columns = list(got.values())
                if not len(columns[0]):
                    continue
                names = list(got)
                rows.append((file_id, page, columns))
                held += sum(v.nbytes if isinstance(v, np.ndarray) and v.dtype != object else sum(getattr(e, "nbytes", 8) for e in v) for v in columns)
                if held >= BATCH_BYTES:
                    yield joined(names, rows)
                    rows, held = [], 0
        if rows:
            yield joined(names, rows)

    return pages.select(*KEYS, "fs", "samples").mapInPandas(run, f"file_id string, page int, {schema}")


def window_of(name: str, n: int) -> np.ndarray:
    """A window of n samples: Hann, Hamming, Blackman, Blackman-Harris (as sums of cosines), Welch, Parzen or Ones."""
    cosines = {"Hann": (0.5, 0.5), "Hamming": (0.54, 0.46), "Blackman": (0.42, 0.5, 0.08), "BlackmanHarris": (0.358375, 0.48829, 0.14128, 0.01168)}
    if name in cosines:
        phase = 2 * np.pi * np.arange(n) / (n - 1)
        return sum((-1) ** k * a * np.cos(k * phase) for k, a in enumerate(cosines[name]))
    if name == "Welch":
        return 1 - ((np.arange(n) - (n - 1) / 2) / ((n - 1) / 2)) ** 2
    if name == "Parzen":
        u = np.abs(np.arange(n) - n / 2) / (n / 2)
        return np.where(u < 0.5, 1 - 6 * u**2 * (1 - u), 2 * (1 - u) ** 3)
    if name == "Ones":
        return np.ones(n)
    raise ValueError(f"unknown window {name}")


def magnitudes(x: np.ndarray, width: int, hop: int, window: str = "Hann") -> np.ndarray:
    """Frames by bins; the mean of the samples is taken off first, and a last frame that ends with them is left out."""
    if len(x) < 2:
        return np.empty((0, width // 2))
    width = min(width, len(x) - 1)
    x = x - x.mean()
    frames = np.lib.stride_tricks.sliding_window_view(x, width)[: max(0, len(x) - width) : hop]
    return np.abs(np.fft.rfft(frames * window_of(window, width), axis=1))[:, : width // 2]


def spectrogram(pages: DataFrame, width: int = 256, hop: int = 128, window: str = "Hann") -> DataFrame:
    """file_id, page, frame, t, mags."""

    def kernel(x: np.ndarray, fs: int) -> dict:
        sg = magnitudes(x, width, hop, window)
        return {"frame": np.arange(len(sg)), "t": np.arange(len(sg)) * hop / fs, "mags": list(sg.astype(np.float32))}

    return per_page(pages, kernel, "frame int, t double, mags array<float>")


def log_scaled(frames: DataFrame) -> DataFrame:
    """Magnitudes in decibels above the page's least magnitude that is not 0."""
    least = F.min(F.array_min(F.filter("mags", lambda m: m > 0))).over(Window.partitionBy(*KEYS))
    return frames.withColumn("least", least).withColumn("mags", F.transform("mags", lambda m: (10 * F.log10(F.greatest(m, F.col("least")) / F.col("least"))).cast("float"))).drop("least")


def band_limited(frames: DataFrame, low_bin: int, high_bin: int) -> DataFrame:
    return frames.withColumn("mags", F.slice("mags", low_bin + 1, high_bin - low_bin))


def masked(frames: DataFrame, low_bin: int, high_bin: int) -> DataFrame:
    return frames.withColumn("mags", F.transform("mags", lambda m, i: F.when((i < low_bin) | (i >= high_bin), F.lit(0.0).cast("float")).otherwise(m)))


def loudest_bins(frames: DataFrame) -> DataFrame:
    return frames.select(*KEYS, "frame", (F.array_position("mags", F.array_max("mags")) - 1).cast("int").alias("bin"))


def to_runs(frames: DataFrame, flag: str, hop_s: float) -> DataFrame:
    """Runs of frames where flag is 1, as [s, e) in seconds."""
    from fieldsong.operators.intervals import run_lengths

    return run_lengths(frames, KEYS, "frame", flag, hop_s)


def power_segments(frames: DataFrame, hop_s: float, threshold: float = 1.0, width: int = 21) -> DataFrame:
    """Frames whose loudest bin, in decibels and smoothed by a median of 21, lies above the page's mean by threshold deviations."""
    near = Window.partitionBy(*KEYS).orderBy("frame").rowsBetween(-(width // 2), width // 2)
    whole = Window.partitionBy(*KEYS)
    db = frames.select(*KEYS, "frame", (10 * F.log10(F.greatest(F.array_max("mags").cast("double"), F.lit(1e-12)))).alias("db"))
    n = F.size(F.collect_list("db").over(near))
    padded = F.array_sort(F.concat(F.collect_list("db").over(near), F.array_repeat(F.lit(0.0), width - n)))  # zeros stand beyond the ends
    smooth = db.withColumn("smooth", F.element_at(padded, width // 2 + 1))
    flagged = smooth.withColumn("on", (F.col("smooth") > F.avg("smooth").over(whole) + threshold * F.stddev_pop("smooth").over(whole)).cast("int"))
    return to_runs(flagged, "on", hop_s)


def amplitude_segments(pages: DataFrame, share: float) -> DataFrame:
    """Runs of samples louder than a share of the page's loudest, in seconds."""

    def kernel(x: np.ndarray, fs: int) -> dict:
        loud = np.abs(x)
        turns = np.flatnonzero(np.diff(loud > share * loud.max(initial=0.0), prepend=False, append=False))
        return {"s": turns[::2] / fs, "e": turns[1::2] / fs}

    return per_page(pages, kernel, "s double, e double")


def fir_taps(low: float | None, high: float | None, fs: int, taps: int = 129) -> np.ndarray:
    """A Hamming-windowed sinc filter that passes low to high Hz; None leaves a side open."""
    n = np.arange(taps) - (taps - 1) / 2

    def below(f: float) -> np.ndarray:
        return 2 * f / fs * np.sinc(2 * f / fs * n) * np.hamming(taps)

    top = below(high) / below(high).sum() if high else (n == 0).astype(float)
    return top - below(low) / below(low).sum() if low else top


def band_passed(pages: DataFrame, low: float | None, high: float | None) -> DataFrame:
    def kernel(x: np.ndarray, fs: int) -> dict:
        return {"fs": [fs], "samples": [np.convolve(x, fir_taps(low, high, fs), "same")[: len(x)] if len(x) else x]}

    return per_page(pages, kernel, "fs int, samples array<double>")


def resampled(pages: DataFrame, rate: int, reach: int = 32) -> DataFrame:
    """Samples at another rate, by a Hann-windowed sinc of so many samples on either side."""

    def kernel(x: np.ndarray, fs: int) -> dict:
        if fs == rate:
            return {"fs": [fs], "samples": [x]}
        scale = min(1.0, rate / fs)
        at = np.arange(int(len(x) * rate / fs)) * fs / rate
        offsets = np.arange(-int(reach / scale), int(reach / scale) + 1)
        out = np.empty(len(at))
        padded = np.pad(x, len(offsets))
        for a in range(0, len(at), 4096):
            near = np.floor(at[a : a + 4096]).astype(int)[:, None] + offsets
            d = at[a : a + 4096, None] - near
            weight = scale * np.sinc(scale * d) * (0.5 + 0.5 * np.cos(np.pi * np.clip(d * scale / reach, -1, 1)))
            out[a : a + 4096] = (padded[near + len(offsets)] * weight).sum(axis=1)
        return {"fs": [rate], "samples": [out]}

    return per_page(pages, kernel, "fs int, samples array<double>")


def pitch(pages: DataFrame, width: int, threshold: float = 0.5) -> DataFrame:
    """file_id, page, win, t, f0: the fundamental of windows of width samples, half of it apart; null where unvoiced.

    The squared difference to the signal tau later, over its running mean, is searched for its first trough under
    the threshold, and the trough's foot is refined by a parabola.
    """

    def kernel(x: np.ndarray, fs: int) -> dict:
        starts = np.arange(0, len(x) - 2 * width, width // 2)
        f0 = np.full(len(starts), np.nan)
        for k, s in enumerate(starts):
            part, later = x[s : s + width], np.lib.stride_tricks.sliding_window_view(x[s : s + 2 * width - 1], width)
            d = ((later - part) ** 2).sum(axis=1)
            d[1:] *= np.arange(1, width) / np.maximum(np.cumsum(d[1:]), 1e-300)
            d[0] = 1
            under = np.flatnonzero(d[1:] < threshold)
            if len(under):
                rises = np.flatnonzero(d[under[0] + 2 :] >= d[under[0] + 1 : -1])
                if len(rises):
                    tau = under[0] + 1 + rises[0]
                    bend = 2 * d[tau] - d[tau - 1] - d[tau + 1]
                    if bend:
                        f0[k] = fs / (tau + (d[tau + 1] - d[tau - 1]) / (2 * bend))
        return {"win": np.arange(len(starts)), "t": starts / fs, "f0": [None if np.isnan(f) else f for f in f0]}

    return per_page(pages, kernel, "win int, t double, f0 double")


def voiced_segments(pitches: DataFrame, least: float, hop_s: float) -> DataFrame:
    flagged = pitches.withColumn("frame", F.col("win")).withColumn("on", F.coalesce((F.col("f0") > least).cast("int"), F.lit(0)))
    return to_runs(flagged, "on", hop_s)


def _grown(m: np.ndarray, reach: int) -> np.ndarray:
    """Each set cell's diamond of so many steps, set too."""
    for _ in range(reach):
        p = np.pad(m, 1)
        m = p[1:-1, 1:-1] | p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]
    return m


def _regions(m: np.ndarray) -> np.ndarray:
    """Set cells labelled by the smallest cell number of their region (8 neighbours), others -1."""
    big = m.size
    lab = np.where(m, np.arange(big).reshape(m.shape), big)
    while True:
        p = np.pad(lab, 1, constant_values=big)
        near = np.min([p[1 + a : p.shape[0] - 1 + a, 1 + b : p.shape[1] - 1 + b] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
        new = np.where(m, near, big)
        new = np.where(m, np.append(new.ravel(), big)[new], big)
        if (new == lab).all():
            return np.where(m, lab, -1)
        lab = new


def clipped_segments(frames: DataFrame, hop_s: float, threshold: float = 3.0, least_area: int = 70, least_axis: float = 5.0) -> DataFrame:
    """Regions of a page that stand out by threshold from the medians of their frame and of their bin, as [s, e).

    What stands out is closed and grown by two steps; regions of more cells than least_area whose ellipse has a
    minor axis over least_axis count.
    """

    def find(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("frame")
        sg = np.stack(x["mags"])
        out = (sg > threshold * np.median(sg, axis=1, keepdims=True)) & (sg > threshold * np.median(sg, axis=0))
        out = _grown(~_grown(~_grown(np.pad(out, 4), 2), 2), 2)[4:-4, 4:-4]
        lab, rows = _regions(out), []
        for one in np.unique(lab[lab >= 0]):
            t, f = np.nonzero(lab == one)
            spread = np.cov(np.stack([t, f]), bias=True) + np.eye(2) / 12
            if len(t) > least_area and 4 * np.sqrt(np.linalg.eigvalsh(spread)[0]) > least_axis:
                rows.append((x["file_id"].iloc[0], x["page"].iloc[0], t.min() * hop_s, (t.max() + 1) * hop_s))
        return pd.DataFrame(rows, columns=["file_id", "page", "s", "e"])

    return frames.groupBy(*KEYS).applyInPandas(find, "file_id string, page int, s double, e double")


def wind_strength(pages: DataFrame, low: float = 50.0, high: float = 500.0, width: int = 4096) -> DataFrame:
    """file_id, page, mean, sd of the logarithm of the power density between low and high Hz."""

    def kernel(x: np.ndarray, fs: int) -> dict:
        if not len(x):
            return {"mean": [], "sd": []}
        n = min(width, len(x))
        frames = np.lib.stride_tricks.sliding_window_view(x, n)[:: max(1, n // 2)]
        power = (np.abs(np.fft.rfft((frames - frames.mean(axis=1, keepdims=True)) * window_of("Hann", n), axis=1)) ** 2).mean(axis=0)
        f = np.fft.rfftfreq(n, 1 / fs)
        part = np.log10(np.maximum(power[(f >= low) & (f <= high)], 1e-12))
        return {"mean": [part.mean()], "sd": [part.std()]}

    return per_page(pages, kernel, "mean double, sd double")


def mfcc(frames: DataFrame, bands: DataFrame, count: int = 13) -> DataFrame:
    """file_id, page, frame, c, value: cosine transform of the logarithms of mel band energies.

    bands(k, band, weight) is a short table of the filter bank; a batch of frames is two matrix products. Bands
    without any weight take no part.
    """
    bank = bands.where("weight > 0").toPandas()  # bins of a frame times bands: configuration
    n = int(bank["band"].max()) + 1
    heights = np.zeros((int(bank["k"].max()) + 1, n))
    heights[bank["k"], bank["band"]] = bank["weight"]
    used = np.flatnonzero(heights.any(axis=0))
    waves = np.sqrt(2.0 / n) * np.cos(np.pi / n * (used[:, None] + 0.5) * np.arange(count))

    def of(mags: pd.Series) -> pd.Series:
        if mags.empty:
            return pd.Series([], dtype=object)
        m = np.stack(mags)[:, : len(heights)].astype(float)
        return pd.Series(list(np.log(m * m @ heights[:, used] + 1e-10) @ waves))

    values = F.pandas_udf(of, "array<double>")
    return frames.select(*KEYS, "frame", F.posexplode(values("mags")).alias("c", "value"))

"""Spectral derivatives and what follows from them: contours, frequency modulation, mean frequency, goodness of pitch; loudness as people hear it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from fieldsong.operators.scales import slepian
from fieldsong.operators.signal import per_page

#: The filters that stand for human loudness at 80 dB and a rate of 16 kHz, numerators and denominators, one after the other.
LOUDNESS_RATE = 16_000
LOUDNESS = [
    ([0.4492, -0.1435, -0.2278, -0.0142, 0.0408, -0.1240, 0.0410, 0.1048, -0.0186, -0.0319, 0.0054], [1.0000, -0.6282, 0.2966, -0.3726, 0.0021, -0.4203, 0.2220, 0.0061, 0.0675, 0.0578, 0.0322]),
    ([0.9592, -1.9184, 0.9592], [1.0000, -1.9167, 0.9201]),
]
#: Samples of silence behind a page, in which the filters ring out.
RING = 8192


def equal_loudness(pages: DataFrame) -> DataFrame:
    """Pages at 16 kHz as loud as people hear them; others raise. The filters work by their response, with room to ring out."""

    def kernel(x: np.ndarray, fs: int) -> dict:
        if fs != LOUDNESS_RATE:
            raise ValueError(f"the filters are for {LOUDNESS_RATE} Hz, not {fs}")
        if not len(x):
            return {"fs": [fs], "samples": [x]}
        n = 1 << int(np.ceil(np.log2(len(x) + RING)))
        wave = np.fft.rfft(x, n)
        for b, a in LOUDNESS:
            wave *= np.fft.rfft(b, n) / np.fft.rfft(a, n)
        return {"fs": [fs], "samples": [np.fft.irfft(wave, n)[: len(x)]]}

    return per_page(pages, kernel, "fs int, samples array<double>")


def derivative_of(x: np.ndarray, fs: int, width: int, hop: int, tapers: int = 2, bandwidth: float = 2.5) -> dict[str, np.ndarray]:
    """power (over its largest), slope (the spectral derivative), time and frequency parts, modulation a bin, of frames by bins.

    The products of neighbouring tapered spectra have the change over time as real part and that over frequency as
    imaginary part; the derivative looks along each bin's direction of largest change. Bins go from the highest frequency down.
    """
    starts = np.arange(0, len(x) - width, hop)
    frames = x[starts[:, None] + np.arange(width)] if len(starts) else np.zeros((0, width))
    spectra = np.stack([np.fft.fft(frames * t, axis=1)[:, width // 2 :] for t in slepian(width, bandwidth, tapers)], axis=2)
    both = (spectra[:, :, :-1] * np.conj(spectra[:, :, 1:])).sum(axis=2)
    time, frequency = both.real, both.imag
    power = (np.abs(spectra) ** 2).sum(axis=2)
    if not len(starts):
        return {"power": power, "slope": time, "time": time, "frequency": frequency, "modulation": np.zeros(width - width // 2)}
    most = (frequency**2).max(axis=0)
    modulation = np.arctan((time**2).max(axis=0) / np.where(most == 0, 1, most))
    return {"power": power / max(power.max(), 1e-300), "slope": -time * np.sin(modulation) + frequency * np.cos(modulation), "time": time, "frequency": frequency, "modulation": modulation}


def wiener_entropy(power: np.ndarray) -> np.ndarray:
    """Logarithm of each frame's geometric over its arithmetic mean."""
    return np.log(np.maximum(power, 1e-300)).mean(axis=1) - np.log(np.maximum(power.mean(axis=1), 1e-300))


def mean_frequency(time: np.ndarray, frequency: np.ndarray, fs: int) -> tuple[np.ndarray, np.ndarray]:
    """The bins' frequencies as they count here, and each frame's mean of them by the size of the change."""
    bins = time.shape[1]
    hz = fs // 2 / bins * (np.arange(bins) + 1)
    size = time**2 + frequency**2
    total = size.sum(axis=1)
    return hz, (hz * size).sum(axis=1) / np.where(total == 0, 1, total)


def contour_cells(d: dict[str, np.ndarray], fs: int, threshold: float = 0.5) -> np.ndarray:
    """Cells where the derivative crosses zero downwards in one of four directions and both neighbours there stand out.

    How much that is falls with the distance from the frame's mean frequency and grows with its entropy. The outermost
    frames and bins have none; before the first frame stands the last one, and likewise for bins. True cells come with
    the lowest bin first.
    """
    slope, power = d["slope"], d["power"]
    if len(power) < 3:
        return np.zeros(power.shape, bool)
    hz, mean = mean_frequency(d["time"], d["frequency"], fs)
    with np.errstate(divide="ignore"):
        least = threshold * np.abs(wiener_entropy(power))[:, None] / np.abs(hz[None] - mean[:, None])
    shifted = lambda m, a, b: np.roll(m, (-a, -b), (0, 1))
    out = np.zeros(power.shape, bool)
    for roll, (a, b), (c, e) in (((1, 0), (-1, 0), (1, 0)), ((0, 1), (0, -1), (0, 1)), ((1, 1), (-1, -1), (1, 1)), ((1, -1), (-1, 1), (-1, 1))):
        crossing = slope * np.roll(slope, roll, (0, 1)) < 0
        out |= crossing & (shifted(power, a, b) > least) & (shifted(power, c, e) > least)
    out &= slope < 0
    out[[0, -1]], out[:, [0, -1]] = False, False
    return out[:, ::-1]


def contours(pages: DataFrame, width: int = 256, hop: int = 128, threshold: float = 0.5) -> DataFrame:
    """file_id, page, frame, bin: contour cells of each page; pages shorter than three frames have none."""

    def kernel(x: np.ndarray, fs: int) -> dict:
        frame, bins = np.nonzero(contour_cells(derivative_of(x, fs, width, hop), fs, threshold))
        return {"frame": frame, "bin": bins}

    return per_page(pages, kernel, "frame int, bin int")


def change_features(pages: DataFrame, width: int = 256, hop: int = 128) -> DataFrame:
    """file_id, page, frame, entropy, mean_hz: Wiener entropy and mean frequency of each frame's change."""

    def kernel(x: np.ndarray, fs: int) -> dict:
        d = derivative_of(x, fs, width, hop)
        return {"frame": np.arange(len(d["power"])), "entropy": wiener_entropy(d["power"]), "mean_hz": mean_frequency(d["time"], d["frequency"], fs)[1]}

    return per_page(pages, kernel, "frame int, entropy double, mean_hz double")


def pitch_goodness(pages: DataFrame, width: int = 256, hop: int = 128) -> DataFrame:
    """file_id, page, bin, goodness, modulation: how strongly each bin's derivative over power repeats itself in time, and its frequency modulation.

    Bins go from the highest frequency down. Pages without a frame have none.
    """

    def kernel(x: np.ndarray, fs: int) -> dict:
        d = derivative_of(x, fs, width, hop)
        if not len(d["power"]):
            return {"bin": [], "goodness": [], "modulation": []}
        good = np.abs(np.fft.fft(d["slope"] / np.maximum(d["power"], 1e-300), axis=0)).max(axis=0)
        return {"bin": np.arange(len(good)), "goodness": good, "modulation": d["modulation"]}

    return per_page(pages, kernel, "bin int, goodness double, modulation double")

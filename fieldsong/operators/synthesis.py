"""The signal of single nodes of a wavelet packet tree, rebuilt, and detection on the energy of rebuilt bands.

The tree is that of operators.wavelets: not thinned at its last level. Rebuilding filters a node's coefficients once
by the synthesis filter of its side and then, level by level, sets them apart by zeros and filters again; what the
filters spoil at the ends is cut there.
"""

from __future__ import annotations

from math import ceil, gcd

import numpy as np
from pyspark.sql import DataFrame

from fieldsong.functions.nodes import band_position
from fieldsong.operators.signal import fir_taps, per_page
from fieldsong.operators.wavelets import packet


def spread(data: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """data with zeros between, filtered, where the filter has all of its data: each filter half makes every other value."""
    out = np.empty(2 * (len(data) - len(taps) // 2 + 1))
    out[::2], out[1::2] = np.convolve(data, taps[::2], "valid"), np.convolve(data, taps[1::2], "valid")
    return out


def mirrored(data: np.ndarray, before: int, after: int) -> np.ndarray:
    return np.concatenate([data[:before][::-1], data, data[len(data) - after :][::-1]])


def rebuilt(coefficients: np.ndarray, node: int, filters: tuple[np.ndarray, np.ndarray], size: int | None = None) -> np.ndarray:
    """The part of the signal that a node holds, twice over: the parts of all nodes of a level add up to twice the signal.

    filters: low and high pass of analysis; those of synthesis are their mirror images. size: samples that are
    kept, or all. The root's coefficients are the signal. The parts come later than the signal by 2 samples at the
    first level, and by twice that and some more at each further one. Where there are fewer coefficients than the
    filters need, nothing is heard: zeros.
    """
    low, high = (f[::-1] for f in filters)
    if node == 0:
        return coefficients if size is None else coefficients[:size]
    if len(coefficients) < 2 * len(low):
        return np.zeros(len(coefficients) << (node + 1).bit_length() - 2 if size is None else size)
    data = np.convolve(coefficients, low if node % 2 else high, "same")
    edge = (len(low) + len(high)) // 8
    while (node := (node - 1) // 2) > 0:
        data = spread(mirrored(data, edge + 1, edge - 1), low if node % 2 else high)
    return data if size is None else np.pad(data[:size], (0, max(0, size - len(data))))


def only_band(data: np.ndarray, node: int) -> np.ndarray:
    """data without the frequencies that are not the node's own: what spreading mirrored to the other bands goes."""
    level = int(np.log2(node + 1))
    at, bands = band_position(node), 2 ** (level + 1)
    wave, n = np.fft.rfft(data), len(data)
    wave[: n * at // bands] = 0
    wave[n * (at + 1) // bands :] = 0
    return np.fft.irfft(wave, n)


def node_signals(pages: DataFrame, nodes: list[int], filters: tuple[np.ndarray, np.ndarray], own_band: bool = False) -> DataFrame:
    """file_id, page, node, samples: each node's rebuilt signal, as long as the page. Empty pages have none."""

    def kernel(x: np.ndarray, fs: int) -> dict:
        if not len(x):
            return {"node": [], "samples": []}
        parts = {n: rebuilt(c, n, filters, len(x)) for n, c in packet(x, nodes, *filters).items()}
        return {"node": list(parts), "samples": [only_band(c, n) if own_band else c for n, c in parts.items()]}

    return per_page(pages, kernel, "node int, samples array<double>")


def energy_curve(c: np.ndarray, reach: int) -> np.ndarray:
    """Means of c over the 2 reach + 1 values around each; the first and last reach values have none and are 0."""
    out = np.zeros(len(c))
    if len(c) > 2 * reach + 1:
        upto = np.concatenate([[0.0], np.cumsum(c)])
        out[reach : len(c) - reach] = (upto[2 * reach + 1 :] - upto[: len(c) - 2 * reach]) / (2 * reach + 1)
    return out


def window_calls(c: np.ndarray, fs: float, threshold: float, smoothing: float, window: float, step: float) -> np.ndarray:
    """Whether the mean of the energy curve in each window lies over exp(mean + threshold deviations) of log |c|."""
    size, hop = ceil(window * fs), ceil(step * fs)
    n = ceil(len(c) / hop) if len(c) else 0
    reach, loud = int(smoothing * size), np.abs(c)
    if not loud.any() or len(c) <= 2 * reach + 1:
        return np.zeros(n, bool)
    upto = np.concatenate([[0.0], np.cumsum(energy_curve(loud, reach))])
    logs = np.log(np.maximum(loud, 1e-300))
    starts = np.arange(n) * hop
    ends = np.minimum(starts + size, len(c))
    return (upto[ends] - upto[starts]) / np.maximum(1, ends - starts) > np.exp(logs.mean() + threshold * logs.std())


def on_seconds(windows: np.ndarray, step: float, seconds: int) -> np.ndarray:
    """Whole seconds that windows of calls, step seconds apart, touch."""
    out = np.zeros(seconds, bool)
    for k in np.flatnonzero(windows):
        out[int(k * step) : min(ceil(k * step + 1), seconds)] = True
    return out


def band_calls(
    pages: DataFrame, nodes: list[int], filters: tuple[np.ndarray, np.ndarray], threshold: float, smoothing: float, band: tuple[float | None, float | None] | None = None, window: float = 1.0, step: float | None = None
) -> DataFrame:
    """file_id, page, win, present: windows in which any node's rebuilt band is loud for the page.

    smoothing: the energy curve's reach as a share of a window; band: Hz that are left of a rebuilt signal. Windows of
    other than a second, or that overlap, are reported as the whole seconds that they touch. A page that is silent or
    too short for the curve has no calls; an empty one no windows.
    """
    hop = step or window

    def kernel(x: np.ndarray, fs: int) -> dict:
        if not len(x):
            return {"win": [], "present": []}
        found = []
        for n, c in packet(x, nodes, *filters).items():
            c = rebuilt(c, n, filters, len(x))
            c = only_band(c, n) if n else c
            c = np.convolve(c, fir_taps(*band, fs), "same") if band else c
            found.append(window_calls(c, fs, threshold, smoothing, window, hop))
        any_node = np.any(found, axis=0)
        if window != 1 or hop != window:
            any_node = on_seconds(any_node, hop, ceil(len(x) / fs))
        return {"win": np.arange(len(any_node)), "present": any_node.astype(int)}

    return per_page(pages, kernel, "win int, present int")


def resolution(window: float, step: float) -> float:
    """The finest time that windows and steps share, in hundredths of a second."""
    return gcd(int(100 * window), int(100 * step)) / 100

"""Pages of samples cleaned before detection, and detectors on their loudness: band filters, impulses, envelopes, syllables, pitch ranges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsong.operators.signal import KEYS, magnitudes, per_page, to_runs

SAMPLES = "fs int, samples array<double>"


def butterworth(order: int, low: float, high: float, fs: int) -> np.ndarray:
    """A Butterworth band pass as sections of second order (b0 b1 b2 a0 a1 a2), by the bilinear transform."""
    warp = 4.0 * np.tan(np.pi * np.array([low, high]) / fs)  # for a rate of 2
    width, middle = warp[1] - warp[0], np.sqrt(warp[0] * warp[1])
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order)) * width / 2
    both = np.concatenate([poles + np.sqrt(poles**2 - middle**2), poles - np.sqrt(poles**2 - middle**2)])
    z = (4 + both) / (4 - both)
    upper = z[z.imag > 1e-12]
    real = np.sort(z[np.abs(z.imag) <= 1e-12].real)
    pairs = [(2 * p.real, abs(p) ** 2) for p in upper] + [(real[k] + real[k + 1], real[k] * real[k + 1]) for k in range(0, len(real) - 1, 2)]
    sections = np.array([[1, 0, -1, 1, -s, p] for s, p in pairs])
    at = np.exp(-2j * np.arctan(middle / 4))  # the gain is 1 in the middle of the band
    gain = np.prod([(x[0] + x[2] * at**2) / (1 + x[4] * at + x[5] * at**2) for x in sections])
    sections[:, :3] /= abs(gain) ** (1 / len(sections))
    return sections


def _response(sections: np.ndarray, n: int) -> np.ndarray:
    z = np.exp(-2j * np.pi * np.fft.rfftfreq(n))
    out = np.ones(len(z), complex)
    for b0, b1, b2, _, a1, a2 in sections:
        out *= (b0 + b1 * z + b2 * z**2) / (1 + a1 * z + a2 * z**2)
    return out


def _butterworth_kernel(x: np.ndarray, fs: int, low: float, high: float, order: int, ways: tuple[bool, ...]) -> list[np.ndarray]:
    h = _response(butterworth(order, max(low, 1e-3 * fs), min(high, 0.4999 * fs), fs), n := 1 << int(np.ceil(np.log2(len(x) + 16 * fs / max(high - low, 1) * order + 2))))
    pad = (n - len(x)) // 2
    wide = np.fft.rfft(np.pad(x, (pad, n - len(x) - pad)))
    return [np.fft.irfft(wide * (np.abs(h) ** 2 if both else h), n)[pad : pad + len(x)] for both in ways]


def butterworth_levels(pages: DataFrame, low: float, high: float, order: int = 6) -> DataFrame:
    """file_id, page, rms_both, rms_once: root mean squares of the band, both ways and one way, from one transform; null for an empty page."""

    def kernel(x: np.ndarray, fs: int) -> dict:
        rms = [float(np.sqrt((y**2).mean())) if len(y) else None for y in _butterworth_kernel(x, fs, low, high, order, (True, False))]
        return {"rms_both": [rms[0]], "rms_once": [rms[1]]}

    return per_page(pages, kernel, "rms_both double, rms_once double")


def butterworth_passed(pages: DataFrame, low: float, high: float, order: int = 6, both_ways: bool = True) -> DataFrame:
    """Pages with only low to high Hz left; both ways, the phase is kept and the filter works twice.

    A page is filtered by its spectrum with room at both ends for the filter to ring out. Bands that reach the rate's
    half are cut just below it.
    """

    def kernel(x: np.ndarray, fs: int) -> dict:
        return {"fs": [fs], "samples": _butterworth_kernel(x, fs, low, high, order, (both_ways,))}

    return per_page(pages, kernel, SAMPLES)


def _masked_blocks(x: np.ndarray, fs: int, percentile: float, share: float, longest: int) -> tuple[np.ndarray, int]:
    size = min((1 << k for k in range(5, 11)), key=lambda w: abs(w - fs // 250))
    sg = magnitudes(x, size, size)
    loud = ((sg > np.percentile(sg, percentile, axis=0)).sum(axis=1) > share * sg.shape[1]) if len(sg) else np.zeros(0, bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], loud.astype(int), [0]])))
    masked = np.zeros(len(loud), int)
    for a, b in zip(edges[::2], edges[1::2]):
        masked[a:b] = b - a <= longest
    return masked, size


def impulse_blocks(pages: DataFrame, percentile: float = 90.0, share: float = 0.75, longest: int = 10) -> DataFrame:
    """file_id, page, block, size, masked: blocks of about 1/250 s in which over a share of the bands is above its own percentile.

    Runs of more than `longest` such blocks are calls close to the microphone and stay.
    """

    def kernel(x: np.ndarray, fs: int) -> dict:
        masked, size = _masked_blocks(x, fs, percentile, share, longest)
        return {"block": np.arange(len(masked)), "size": np.full(len(masked), size), "masked": masked}

    return per_page(pages, kernel, "block int, size int, masked int")


def impulses_masked(pages: DataFrame, percentile: float = 90.0, share: float = 0.75, longest: int = 10) -> DataFrame:
    """Pages with the samples of masked impulse blocks set to 0; what follows the last whole block is as it was."""

    def kernel(x: np.ndarray, fs: int) -> dict:
        masked, size = _masked_blocks(x, fs, percentile, share, longest)
        x = x.copy()
        x[: len(masked) * size][np.repeat(masked > 0, size)] = 0
        return {"fs": [fs], "samples": [x]}

    return per_page(pages, kernel, SAMPLES)


#: The envelope's filter, by hundredths of a tenth of a second.
ENVELOPE = [
    0.078573, 0.053921, 0.041608, 0.036006, 0.031521, 0.029435, 0.028122, 0.027287, 0.026241, 0.025226, 0.024076, 0.022927, 0.021704, 0.020487, 0.019721,
    0.019015, 0.018564, 0.017953, 0.01753, 0.017077, 0.016544, 0.015762, 0.015056, 0.014457, 0.013913, 0.013299, 0.012879, 0.012568, 0.012455, 0.012056,
    0.011634, 0.011077, 0.010707, 0.010217, 0.009884, 0.009596, 0.0093607, 0.0090198, 0.0086909, 0.0083841, 0.0081482, 0.0079185, 0.0076363, 0.0073406, 0.0070687,
    0.0068438, 0.0065873, 0.0063689, 0.00617, 0.0059743, 0.0057562, 0.0055351, 0.0053634, 0.0051801, 0.0049743, 0.0047431, 0.0045649, 0.0043972, 0.004246, 0.0041016,
    0.0039503, 0.0038013, 0.0036351, 0.0034856, 0.0033271, 0.0032067, 0.003057, 0.0029207, 0.002776, 0.0026562, 0.0025302, 0.0024185, 0.0022967, 0.0021861, 0.0020697,
    0.0019552, 0.0018563, 0.0017562, 0.0016605, 0.0015522, 0.0014483, 0.0013492, 0.00126, 0.0011788, 0.0010909, 0.0010049, 0.00091528, 0.00082062, 0.00074465, 0.00067159,
    0.00060259, 0.00053371, 0.00046135, 0.00039071, 0.00032736, 0.00026183, 0.00018987, 0.00011976, 6.0781e-05, 0.0,
]


def envelope_taps(hop_s: float) -> np.ndarray:
    """The envelope's filter at a rate of frames: as many taps as there are frames in a tenth of a second, one at least."""
    n = max(1, int(1 / hop_s / 10))
    return np.interp(np.arange(1, len(ENVELOPE), len(ENVELOPE) / n), np.arange(len(ENVELOPE)), ENVELOPE)


def envelope_segments(frames: DataFrame, hop_s: float, threshold: float) -> DataFrame:
    """Runs of frames whose mean magnitude, filtered, is over the page's median by threshold deviations.

    The page has a tenth of a second of silence before it and half the filter's length looks ahead, so runs are
    reported that tenth late, and can end after the page; this is how the detector is defined.
    """
    taps = envelope_taps(hop_s)
    late = max(1, int(1 / hop_s / 10))

    def smooth(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("frame")
        padded = np.concatenate([np.zeros(late), x["level"], np.zeros(late)])
        e = np.convolve(padded, taps)[len(taps) // 2 : len(taps) // 2 + len(padded) - late]
        return pd.DataFrame({"file_id": x["file_id"].iloc[0], "page": x["page"].iloc[0], "frame": np.arange(len(e)), "on": (e > np.median(e) + threshold * e.std()).astype(int)})

    level = frames.select(*KEYS, "frame", (F.aggregate("mags", F.lit(0.0), lambda a, m: a + m) / F.size("mags")).alias("level"))
    return to_runs(level.groupBy(*KEYS).applyInPandas(smooth, "file_id string, page int, frame int, on int"), "on", hop_s)


def syllable_segments(frames: DataFrame, hop_s: float, drop: float = 10.0, stop: float = 0.8, least_s: float = 0.05, width: int = 21) -> DataFrame:
    """file_id, page, s, e: from the loudest frame on, stretches that are within `drop` decibels of their peak, until peaks are under stop times the largest."""

    def find(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("frame")
        padded = np.pad(x["db"].to_numpy(), width // 2)
        db = np.median(np.lib.stride_tricks.sliding_window_view(padded, width), axis=1)
        top, rows = db.max(), []
        while top > 0 and db.max() > stop * top:
            peak = int(db.argmax())
            under = db <= db[peak] - drop
            a = int(np.flatnonzero(under[:peak])[-1]) if under[:peak].any() else 0
            b = peak + int(np.flatnonzero(under[peak:])[0]) if under[peak:].any() else len(db) - 1
            db[a : max(b, peak + 1)] = 0
            if (b - a) * hop_s > least_s:
                rows.append((x["file_id"].iloc[0], x["page"].iloc[0], a * hop_s, b * hop_s))
        return pd.DataFrame(rows, columns=["file_id", "page", "s", "e"])

    db = frames.select(*KEYS, "frame", (10 * F.log10(F.greatest(F.array_max("mags").cast("double"), F.lit(1e-12)))).alias("db"))
    return db.groupBy(*KEYS).applyInPandas(find, "file_id string, page int, s double, e double")


def in_pitch_range(segments: DataFrame, pitches: DataFrame, low: float, high: float, least: float) -> DataFrame:
    """Segments(file_id, s, e) whose mean fundamental, of the windows above `least` Hz that begin in them, is from low to high; without any they go."""
    heard = pitches.where(F.col("f0") > least).select("file_id", "t", "f0")
    met = segments.join(heard, "file_id").where((F.col("t") >= F.col("s")) & (F.col("t") < F.col("e")))
    mean = met.groupBy("file_id", "s", "e").agg(F.avg("f0").alias("f0")).where(F.col("f0").between(low, high))
    return segments.join(mean.select("file_id", "s", "e"), ["file_id", "s", "e"], "left_semi")

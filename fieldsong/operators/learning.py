"""Rows for learning and rules made from them, windy recordings, thresholds by blocks, and stretched copies of sounds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsong.operators.signal import per_page, window_of

#: Shares of a set of seven nodes above which a segment is the bird's.
BOTH_OVER, FIRST_OVER, FIFTH_OVER = 0.2, 0.4, 0.3


def node_shares(energies: DataFrame, by: list[str], nodes: list[int]) -> DataFrame:
    """by, shares: of each segment the mean energies of the nodes, in the list's order, over their sum. Segments without energy have nulls.

    energies(*by, node, win, energy) has the segment's windows.
    """
    mean = energies.where(F.col("node").isin(nodes)).groupBy(*by, "node").agg(F.avg("energy").alias("e"))
    packed = mean.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("node", "e"))).alias("m"), F.sum("e").alias("total"))
    one = lambda n: F.when(F.col("total") > 0, F.coalesce(F.element_at("m", F.lit(n)), F.lit(0.0)) / F.col("total"))
    return packed.select(*by, F.array(*map(one, nodes)).alias("shares"))


def learning_rows(shares: DataFrame, segments: DataFrame, reviewed: DataFrame, by: list[str], start: str = "s") -> DataFrame:
    """shares of segments(*by, s) with target: whether the review kept a segment that starts or ends when it starts.

    reviewed(*by without the segment's number, s, e) are the segments that are left.
    """
    file = [c for c in by if c in reviewed.columns]
    marks = reviewed.select(*file, F.explode(F.array("s", "e")).alias(start)).distinct().withColumn("target", F.lit(1))
    return shares.join(segments.select(*by, start), by).join(marks, [*file, start], "left").fillna(0, ["target"])


def rule(shares: Column) -> Column:
    """The bird's own rule on the shares of seven nodes: one of the first two and one of the fifth and sixth stand out, or the first or fifth does alone."""
    s = lambda k: F.get(shares, F.lit(k))
    pair = ((s(0) > BOTH_OVER) | (s(1) > BOTH_OVER)) & ((s(4) > BOTH_OVER) | (s(5) > BOTH_OVER))
    return F.coalesce(pair | (s(0) > FIRST_OVER) | (s(4) > FIFTH_OVER), F.lit(False))


def energies_with_truth(energies: DataFrame, truth: DataFrame, nodes: int) -> DataFrame:
    """file_id, win, energies (of the nodes 1 on, null where one is missing), present: a row a second that both know."""
    packed = energies.where((F.col("node") >= 1) & (F.col("node") <= nodes)).groupBy("file_id", "win").agg(F.map_from_entries(F.collect_list(F.struct("node", "energy"))).alias("m"))
    rows = packed.join(truth.select("file_id", F.col("bin").alias("win"), "present"), ["file_id", "win"])
    return rows.select("file_id", "win", F.transform(F.sequence(F.lit(1), F.lit(nodes)), lambda n: F.try_element_at("m", n)).alias("energies"), "present")


def welch(x: np.ndarray, fs: int, width: int = 512) -> np.ndarray:
    """One-sided power density: mean of periodograms under a Hamming window, half a width apart; a shorter piece is one."""
    n = min(width, len(x))
    shape = window_of("Hamming", n + 1)[:-1]
    frames = np.lib.stride_tricks.sliding_window_view(x, n)[:: max(1, n - n // 2)]
    power = (np.abs(np.fft.rfft(frames * shape, axis=1)) ** 2).mean(axis=0) / (fs * (shape**2).sum())
    power[1 : (n + 1) // 2] *= 2
    return power


#: The band of wind in Hz, and the mean of its logarithms above which a recording is too noisy.
WIND_BAND, TOO_NOISY = (50, 500), 2.0


def windy(pages: DataFrame) -> DataFrame:
    """file_id, level, sd, noisy: mean over a recording's whole seconds of the wind band's mean log power, of its deviation, and whether that is too much.

    Recordings of under a second have no row.
    """

    def kernel(x: np.ndarray, fs: int) -> dict:
        rows = []
        for k in range(len(x) // fs):
            p = np.log10(np.maximum(welch(x[k * fs : (k + 1) * fs], fs), 1e-300))
            part = p[int(len(p) * 2 * WIND_BAND[0] / fs) : int(len(p) * 2 * WIND_BAND[1] / fs)]
            if len(part):
                rows.append((part.mean(), part.std()))
        return {"level": [r[0] for r in rows], "sd": [r[1] for r in rows]}

    each = per_page(pages, kernel, "level double, sd double")
    return each.groupBy("file_id").agg(F.avg("level").alias("level"), F.avg("sd").alias("sd")).withColumn("noisy", F.col("level") > TOO_NOISY)


def block_thresholded(coefficients: DataFrame, thresholds: DataFrame, by: list[str], size: int, kind: str = "soft") -> DataFrame:
    """by, i, c: coefficients(*by, i, c) shrunk, or cut, by the threshold of their block of `size`: thresholds(*by, block, t).

    Blocks without a threshold stay as they are.
    """
    if kind not in ("soft", "hard"):
        raise ValueError("thresholds are soft or hard")
    rows = coefficients.withColumn("block", F.floor(F.col("i") / size)).join(thresholds, [*by, "block"], "left")
    t = F.coalesce("t", F.lit(0.0))
    left = F.greatest(F.abs("c") - t, F.lit(0.0))
    shrunk = F.when(F.col("c") < 0, -left).otherwise(left) if kind == "soft" else F.when(F.abs("c") < t, 0.0).otherwise(F.col("c"))
    return rows.select(*by, "i", shrunk.alias("c"))


def stretch(x: np.ndarray, rate: float, width: int = 2048) -> np.ndarray:
    """x played at rate times its speed with its pitches kept, by a phase vocoder; as long as x: what is missing is silence."""
    n, hop = len(x), width // 4
    if n < 2 or rate == 1:
        return x.copy()
    shape = window_of("Hann", width + 1)[:-1]
    padded = np.pad(x, width // 2, "reflect" if n > width // 2 else "constant")
    frames = np.lib.stride_tricks.sliding_window_view(padded, width)[::hop]
    spectra = np.fft.rfft(frames * shape, axis=1)
    steps = np.arange(0, len(spectra), rate)
    spectra = np.concatenate([spectra, np.zeros((2, spectra.shape[1]))])
    at, share = steps.astype(int), (steps % 1)[:, None]
    size = (1 - share) * np.abs(spectra[at]) + share * np.abs(spectra[at + 1])
    turn = np.linspace(0, np.pi * hop, spectra.shape[1])
    moved = np.angle(spectra[at + 1]) - np.angle(spectra[at]) - turn
    moved -= 2 * np.pi * np.round(moved / (2 * np.pi))
    phase = np.angle(spectra[0]) + np.concatenate([np.zeros((1, len(turn))), np.cumsum(turn + moved, axis=0)[:-1]])
    out, weight = np.zeros(len(steps) * hop + width), np.zeros(len(steps) * hop + width)
    pieces = np.fft.irfft(size * np.exp(1j * phase), width, axis=1) * shape
    for k, piece in enumerate(pieces):
        out[k * hop : k * hop + width] += piece
        weight[k * hop : k * hop + width] += shape**2
    out = (out / np.maximum(weight, weight.max() / 2))[width // 2 :]  # where few frames overlap, at the ends, sound fades
    return np.pad(out[:n], (0, max(0, n - len(out))))


def speed_changed(pages: DataFrame, copies: int, spread: float = 0.05, width: int = 2048, seed: int = 1) -> DataFrame:
    """file_id (with the copy's number), page, fs, samples, rate: copies of sounds played faster or slower, as training sets are made larger.

    Rates are normal about 1; they follow from the seed, the recording and the copy, so that a task that is run again gives the same.
    """
    unit = lambda k: (F.pmod(F.xxhash64(F.lit(seed + k), "file_id", "page", "copy"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    normal = F.sqrt(-2 * F.ln(unit(0))) * F.cos(2 * np.pi * unit(1))
    each = pages.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).withColumn("rate", F.greatest(F.lit(0.5), 1 + spread * normal))
    slow = F.pandas_udf(lambda samples, rates: samples.combine(rates, lambda x, r: stretch(np.asarray(x, float), float(r), width)), "array<double>")
    return each.select(F.concat_ws("_", "file_id", "copy").alias("file_id"), "page", "fs", slow("samples", "rate").alias("samples"), "rate")

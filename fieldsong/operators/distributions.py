"""Distributions of energy over time and frequency of short pieces of sound: every sample has a spectrum of as many bins as there are samples.

The work grows with the square of a piece's length, so pieces over LONGEST samples raise: cut recordings into segments first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsong.operators.signal import per_page, spread

LONGEST = 2048
#: Cells of distributions that totals() holds at once.
CELLS = 1 << 20


def taper(n: int, a: float) -> np.ndarray:
    """An odd window of n values or one fewer, a + (1 - a) cosine from its middle; the middle is 1."""
    half = (n - 1) // 2
    return a + (1 - a) * np.cos(np.pi * np.arange(-half, half + 1) / (half + 1))


def odd(n: float) -> int:
    return int(n) + 1 - int(n) % 2


def plain(x: np.ndarray) -> np.ndarray:
    """Power by time and frequency: transforms under a window of a quarter of the piece, scaled to unit length where it is cut at the ends.

    Of pieces of equal length, one below the other, all at once; wigner() too.
    """
    n = x.shape[-1]
    h = taper(odd(n // 4), 0.5)
    half, rows = len(h) // 2, np.zeros((*x.shape, n))
    for i in range(n):
        tau = np.arange(-min(i, round(n / 2) - 1, half), min(n - i - 1, round(n / 2) - 1, half) + 1)
        rows[..., i, tau % n] = x[..., i + tau] * h[half + tau] / np.linalg.norm(h[half + tau])
    return np.abs(np.fft.fft(rows, axis=-1)) ** 2


def lagged(x: np.ndarray, window: np.ndarray | None, smoothing: np.ndarray | None) -> np.ndarray:
    """Products of values tau after and tau before each time, by time and lag (negative lags from the end), windowed over the lags and averaged over near times."""
    n = x.shape[-1]
    half = round(n / 2) - 1 if window is None else min(round(n / 2) - 1, len(window) // 2)
    out = np.zeros((*x.shape, n))
    reach = 0 if smoothing is None else len(smoothing) // 2
    wide = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(reach + half, reach + half)])
    for tau in range(-half, half + 1):
        products, inside = np.zeros(x.shape), np.zeros(n)
        for p in range(-reach, reach + 1):
            at = np.arange(n) - p
            fits = (at - abs(tau) >= 0) & (at + abs(tau) < n)
            g = 1.0 if smoothing is None else smoothing[reach + p]
            after, before = (reach + half - p + t for t in (tau, -tau))
            products += np.where(fits, g * wide[..., after : after + n] * wide[..., before : before + n], 0)
            inside += np.where(fits, g, 0)
        weight = 1.0 if window is None else window[len(window) // 2 + tau]
        out[..., tau % n] = weight * np.where(inside > 0, products / np.where(inside > 0, inside, 1), 0)
    return out


def wigner(x: np.ndarray, window: np.ndarray | None = None, smoothing: np.ndarray | None = None) -> np.ndarray:
    """The Wigner-Ville distribution by time and bin; with a window over lags the pseudo one, with a window over times too the smoothed one."""
    return np.fft.fft(lagged(x, window, smoothing), axis=-1).real


KINDS = {
    "plain": plain,
    "wigner": wigner,
    "pseudo": lambda x: wigner(x, taper(odd(x.shape[-1] // 4), 0.5)),
    "smoothed": lambda x: wigner(x, taper(odd(x.shape[-1] // 4), 0.54), taper(odd(x.shape[-1] // 10), 0.54)),
}


def fitting(n: int) -> None:
    if n > LONGEST:
        raise ValueError(f"{n} samples are too many for a distribution, {LONGEST} at most")


def distribution(pages: DataFrame, kind: str) -> DataFrame:
    """file_id, page, i, cells: a row a sample, with the energy of each bin, of the kinds plain, wigner, pseudo or smoothed."""

    def kernel(x: np.ndarray, fs: int) -> dict:
        fitting(len(x))
        got = KINDS[kind](x) if len(x) > 3 else np.zeros((0, 0))
        return {"i": np.arange(len(got)), "cells": list(got)}

    return per_page(pages, kernel, "i int, cells array<double>")


def totals(pages: DataFrame, kinds: list[str]) -> DataFrame:
    """file_id, kind, cells: each bin of distribution() summed over all samples of a recording, in tasks.

    Recordings are spread over tasks and sorted within them, so a recording's pages come one after the other, and a
    task holds CELLS at once (or one piece) and one recording's sums. Pieces of different lengths are added bin by bin.
    """

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[np.ndarray]]]:
        """Recordings and samples of some pages in turn."""
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            fitting(int(sizes.max()))
            ends = np.cumsum(sizes)
            rows = max(1, CELLS // max(1, int(sizes.max())) ** 2)
            for a in range(0, len(ids), rows):
                yield ids[a : a + rows], [flat[e - n : e] for e, n in zip(ends[a : a + rows], sizes[a : a + rows])]

    def summed(pieces: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many bins each run of pieces has, and the sums by kind, run and bin."""
        sizes = np.array([len(x) if len(x) > 3 else 0 for x in pieces])
        out = np.zeros((len(kinds), len(pieces), max(1, sizes.max())))
        for n in set(sizes.tolist()) - {0}:
            at = np.flatnonzero(sizes == n)
            x = np.stack([pieces[k] for k in at])
            for k, kind in enumerate(kinds):
                out[k, at, :n] = KINDS[kind](x).sum(axis=-2)
        return np.maximum.reduceat(sizes, starts), np.add.reduceat(out, starts, axis=1)

    def rows(ids: list, widths: np.ndarray, sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        inside = np.arange(sums.shape[2]) < widths[:, None]
        offsets = pa.array(np.concatenate([[0], np.cumsum(widths)]), pa.int32())
        for k, kind in enumerate(kinds):
            cells = pa.ListArray.from_arrays(offsets, pa.array(sums[k][inside], pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array([kind] * len(ids), pa.string()), cells], ["file_id", "kind", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last recording, which may go on: its id, bins and sums
        for ids, pieces in slices(batches):
            starts = np.array([k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]])
            widths, sums = summed(pieces, starts)
            names = [ids[k] for k in starts]
            if held and held[0] == names[0]:
                width = max(sums.shape[2], held[2].shape[1])
                sums = np.pad(sums, ((0, 0), (0, 0), (0, width - sums.shape[2])))
                sums[:, 0, : held[2].shape[1]] += held[2]
                widths[0] = max(widths[0], held[1])
            elif held:
                yield from rows([held[0]], np.array([held[1]]), held[2][:, None])
            if len(names) > 1:
                yield from rows(names[:-1], widths[:-1], sums[:, :-1])
            held = names[-1], widths[-1], sums[:, -1]
        if held:
            yield from rows([held[0]], np.array([held[1]]), held[2][:, None])

    dealt = spread(pages.select("file_id", "samples"), "file_id").sortWithinPartitions("file_id")
    return dealt.mapInArrow(run, "file_id string, kind string, cells array<double>").where(F.size("cells") > 0)

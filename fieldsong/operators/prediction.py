"""Linear prediction: coefficients of frames from their autocorrelations, and formants from the polynomials' roots."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsong.operators.signal import per_page, window_of


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: the optimiser would put a column's expression wherever it is named."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def circular_autocorrelation(x: Column, order: int) -> Column:
    """Sums of products of a frame's values with those 0 to order places on, round its end; null for an empty frame."""

    def sums(x: Column) -> Column:
        turned = lambda k: F.concat(F.slice(x, k % F.size(x) + 1, F.size(x)), F.slice(x, 1, k % F.size(x)))
        products = lambda k: F.aggregate(F.zip_with(x, turned(k), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.lit(order)), products))

    return let(x, sums)


def levinson(r: Column, order: int) -> Column:
    """struct<a: array<double>, error: double>: prediction coefficients 1, a1 ... of autocorrelations r, and what they leave.

    The recursion goes from order to order: the new coefficients are the old ones and, times the reflection, the old
    ones turned round. A frame without energy, or predicted wholly at a lower order, gets zeros for the rest. An
    expression in the JVM: r is an array, and the fold carries one array.
    """

    def solved(r: Column) -> Column:
        start = F.struct(F.array(F.lit(1.0)).alias("a"), F.element_at(r, 1).cast("double").alias("error"))

        def step(acc: Column, k: Column) -> Column:
            a, error = acc["a"], acc["error"]
            # Sum of a[j] r[k + 1 - j] over j = 0 .. k, against the error so far.
            against = F.aggregate(F.zip_with(a, F.reverse(F.slice(r, 2, k + 1)), lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
            wide = F.concat(a, F.array(F.lit(0.0)))
            reflection = F.when(error > F.get(r, F.lit(0)) * 1e-12, -against / error).otherwise(F.lit(0.0))
            return let(reflection, lambda m: F.struct(F.zip_with(wide, F.reverse(wide), lambda x, y: x + m * y).alias("a"), (error * (1 - m * m)).alias("error")))

        return F.when(r.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.lit(order - 1)), start, step))

    return let(r, solved)


def prediction_coefficients(frames: DataFrame, by: list[str], x: str, order: int) -> DataFrame:
    """by, a, error of frames with an array x of samples; empty frames have nulls."""
    found = frames.select(*by, circular_autocorrelation(F.col(x), order).alias("r")).select(*by, levinson(F.col("r"), order).alias("lpc"))
    return found.select(*by, "lpc.a", "lpc.error")


def levinson_kernel(r: np.ndarray) -> tuple[np.ndarray, float]:
    """The same for one array of autocorrelations."""
    a, error = np.ones(1), float(r[0])
    for k in range(len(r) - 1):
        reflect = -float(a @ r[k + 1 : 0 : -1]) / error if error > r[0] * 1e-12 else 0.0
        wide = np.append(a, 0.0)
        a, error = wide + reflect * wide[::-1], error * (1 - reflect * reflect)
    return a, error


#: What is taken off each sample before prediction: so much of the filtered sample before it.
TILT = 0.63


def formants(pages: DataFrame, width: int, order: int | None = None) -> DataFrame:
    """file_id, page, frame, t, k, hz: angles of the roots, on or above the real line, of each frame's prediction polynomial, rising.

    Frames of width samples stand one behind the other, under a Hann window and a first-order filter. Order: 2 and
    one for every whole kilohertz of the rate. Silent frames have none.
    """

    def kernel(x: np.ndarray, fs: int) -> dict:
        n = order or 2 + fs // 1000
        rows = []
        for k, start in enumerate(range(0, len(x) - width, width)):
            y = x[start : start + width] * window_of("Hann", width)
            tilted, last = np.empty(width), 0.0
            for i, v in enumerate(y):
                last = tilted[i] = v - TILT * last
            power = np.fft.irfft(np.abs(np.fft.rfft(tilted)) ** 2, width)[: n + 1]
            if power[0] <= 0:
                continue
            roots = np.roots(levinson_kernel(power)[0])
            angles = np.sort(np.angle(roots[roots.imag >= 0]))
            rows += [(k, start / fs, j, a / (2 * np.pi) * fs) for j, a in enumerate(angles)]
        return dict(pd.DataFrame(rows, columns=["frame", "t", "k", "hz"]))

    return per_page(pages, kernel, "frame int, t double, k int, hz double")

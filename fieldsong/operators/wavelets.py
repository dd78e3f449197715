"""Wavelet packets: window energies of the tree's nodes, thresholds, the best basis and change points.

The tree is not thinned at its last level: a node holds twice the coefficients of its place, and every second
one is split further or summed up. Edges are mirrored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldsong.operators.signal import KEYS, per_page


def daubechies(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Low and high pass filters of 2 n taps, from the roots inside the unit circle of the halfband polynomial."""
    taps = np.array([1.0])
    y = np.roots([comb(n - 1 + k, k) for k in range(n - 1, -1, -1)]) if n > 1 else []
    for root in y:
        both = np.roots([1, 4 * root - 2, 1])
        taps = np.convolve(taps, [1, -both[np.argmin(np.abs(both))]])
    for _ in range(n):
        taps = np.convolve(taps, [1, 1])
    low = np.real(taps)
    low = low / low.sum() * np.sqrt(2)
    return low[::-1], low * (-1.0) ** (np.arange(2 * n) + 1)


def children(data: np.ndarray, low: np.ndarray, high: np.ndarray, root: bool) -> tuple[np.ndarray, np.ndarray]:
    """Both children of a node's coefficients, not thinned."""
    data = data if root else data[::2]
    if not len(data):
        return data, data
    n = len(low)
    wide = np.pad(data, (n + 1, n - 1), "symmetric") if len(data) > n else np.pad(data, (n + 1, n - 1), "edge")
    return tuple(np.convolve(wide, f, "same")[n:-n] for f in (low, high))


def packet(data: np.ndarray, nodes: list[int], low: np.ndarray, high: np.ndarray) -> dict[int, np.ndarray]:
    """Coefficients of the nodes asked for; only their ancestors are computed besides."""
    wanted = set(nodes)
    for n in nodes:
        while n:
            n = (n - 1) // 2
            wanted.add(n)
    tree = {0: data}
    for n in sorted(wanted):
        if 2 * n + 1 in wanted or 2 * n + 2 in wanted:
            tree[2 * n + 1], tree[2 * n + 2] = children(tree[n], low, high, n == 0)
    return {n: tree[n] for n in nodes}


def node_energies(pages: DataFrame, nodes: list[int], seconds: float, filters: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """file_id, page, node, win, real_window, energy: mean squares over windows of at least so many seconds."""

    def kernel(x: np.ndarray, fs: int) -> dict:
        sizes, real, energy = [], [], []
        for node, c in packet(x, nodes, *filters).items():
            rate = fs / 2 ** int(np.log2(node + 1))
            size = ceil(seconds * rate)
            c = c[::2] if node else c
            n = len(c) // size
            sizes.append(n)
            real.append(size / rate)
            energy.append((c[: n * size].reshape(n, size) ** 2).mean(axis=1))
        win = np.concatenate([np.arange(n) for n in sizes])
        return {"node": np.repeat(list(dict.fromkeys(nodes)), sizes), "win": win, "real_window": np.repeat(real, sizes), "energy": np.concatenate(energy)}

    return per_page(pages, kernel, "node int, win int, real_window double, energy double")


def level_shares(energies: DataFrame) -> DataFrame:
    """With share: a node's energy in percent of its level's in the window."""
    level = F.floor(F.log2(F.col("node") + 1)).cast("int")
    return energies.withColumn("level", level).withColumn("share", 100 * F.col("energy") / F.sum("energy").over(Window.partitionBy(*KEYS, "level", "win")))


def soft(x: Column, t: float) -> Column:
    return F.signum(x) * F.greatest(F.abs(x) - t, F.lit(0.0))


def hard(x: Column, t: float) -> Column:
    return F.when(F.abs(x) < t, 0.0).otherwise(x)


def node_costs(coefficients: DataFrame, by: list[str], kind: str, threshold: float = 0.0) -> DataFrame:
    """by, cost of coefficients(by, c): how many exceed the threshold, their entropy, or Stein's risk."""
    d = F.col("c") * F.col("c")
    t2 = threshold * threshold
    cost = {
        "threshold": F.count_if(F.abs("c") > threshold).cast("double"),
        "entropy": F.sum(F.when(d > 0, -d * F.ln(d)).otherwise(0.0)),
        "sure": F.sum(F.when(d > t2, 1.0 + t2).otherwise(d - 1.0)),
    }[kind]
    return coefficients.groupBy(*by).agg(cost.alias("cost"))


def best_leaves(costs: DataFrame, by: list[str]) -> DataFrame:
    """by, node: leaves of the cheapest tree of costs(by, node, cost), a full tree of at most 2047 nodes a key."""

    def fold(x: pd.DataFrame) -> pd.DataFrame:
        cost = x.set_index("node")["cost"].to_dict()
        inner = [n for n in cost if 2 * n + 2 in cost]
        split = set()
        for n in sorted(inner, reverse=True):
            below = cost[2 * n + 1] + cost[2 * n + 2]
            if below < cost[n]:
                cost[n] = below
                split.add(n)
        leaves, open_ = [], [0]
        while open_:
            n = open_.pop()
            (open_.extend((2 * n + 1, 2 * n + 2)) if n in split else leaves.append(n))
        return pd.DataFrame({**{c: x[c].iloc[0] for c in by}, "node": sorted(leaves)})

    kinds = ", ".join(f"{c} {dict(costs.dtypes)[c]}" for c in by)
    return costs.groupBy(*by).applyInPandas(fold, f"{kinds}, node int")


def best_level(costs: DataFrame, by: list[str]) -> DataFrame:
    """by, level: how deep a full tree is worth it: the first level whose cheapest node is not cheaper than the one before has, or the last."""
    level = F.floor(F.log2(F.col("node") + 1)).cast("int")
    least = costs.groupBy(*by, level.alias("level")).agg(F.min("cost").alias("least"))
    line = Window.partitionBy(*by).orderBy("level")
    steps = least.withColumn("before", F.lag("least").over(line)).where("level > 0")
    stop = F.coalesce(F.min(F.when(F.col("least") >= F.col("before"), F.col("level"))), F.max("level"))
    return steps.groupBy(*by).agg(stop.alias("level"))


#: A series of change points may be so long: the work grows with its square.
MOST_POINTS = 10_000


def change_points(x: np.ndarray, longest: int, alpha: float, background: float = 1.0) -> list[tuple[int, int, str]]:
    """Segments [s, e) of x whose variance leaves the background: signals (s), nuisances (n), signals on them (o).

    The cheapest cut of the series is found step by step. The last point is background, ends a signal of at most
    longest points, or ends a nuisance of more, which has a background of its own, tracked as it goes, with
    signals upon it that lie beyond it from the general background. A cut costs 1.1 alpha ln n more.
    """
    n = len(x)
    if n > MOST_POINTS:
        raise ValueError(f"{n} windows are too many to search for changes, {MOST_POINTS} at most: take shorter pages or longer windows")
    x2 = np.maximum(np.asarray(x, dtype=float) ** 2, 1e-12)
    penalty = 1.1 * alpha * np.log(max(n, 2))
    upto = np.concatenate([[0.0], np.cumsum(x2)])
    # cost[t]: the cheapest cut of the first t points, of which the first is background.
    cost, cut = np.zeros(n + 1), [(0, "b")] * (n + 1)
    # Of nuisances only the last steps' costs, levels and sizes are held, by step modulo ring.
    ring = longest + 1
    inner, size, levels = np.zeros((n, ring)), np.zeros((n, ring)), np.ones((n, ring))
    inner_cut = np.zeros((n, n + 1), dtype=np.int32)
    for t in range(2, n + 1):
        v = x2[t - 1]
        back = np.arange(max(1, t - longest), t)
        length = t - back
        mean = np.maximum((upto[t] - upto[back]) / length, 1e-12)
        price = length * (1 + np.log(mean))
        options = [(cost[t - 1] + np.log(background) + v / background, t - 1, "b")]
        k = int(np.argmin(cost[back] + price))
        options.append((cost[back[k]] + price[k] + penalty, int(back[k]), "s"))
        # Nuisances that began at k: one step on for each.
        k = t - 1
        here, last = t % ring, (t - 1) % ring
        inner[k, here], levels[k, here], size[k, here] = 1 + np.log(v), v, 1
        run = np.arange(1, t - 1)
        if len(run):
            stay = inner[run, last] + np.log(levels[run, last]) + v / levels[run, last]
            now = levels[run, last][:, None]
            beyond = np.where(now > background, mean > now, np.where(now < background, mean < now, True))
            signal = np.where((back[None] > run[:, None]) & beyond, inner[run][:, back % ring] + price + penalty, np.inf)
            at = signal.argmin(axis=1)
            lowest = signal[np.arange(len(run)), at]
            took = lowest <= stay
            seat = back[at] % ring
            new_size = np.where(took, size[run, seat], size[run, last] + 1)
            new_level = np.where(took, levels[run, seat], levels[run, last] + (v - levels[run, last]) / (size[run, last] + 1))
            size[run, here], levels[run, here] = new_size, new_level
            inner[run, here], inner_cut[run, t] = np.where(took, lowest, stay), np.where(took, back[at], 0)
            old = run[t - run > longest]
            if len(old):
                k = int(np.argmin(cost[old] + inner[old, here]))
                options.append((cost[old[k]] + inner[old[k], here] + penalty, int(old[k]), "n"))
        cost[t], at_, kind = min(options, key=lambda o: (o[0], "nsb".index(o[2])))
        cut[t] = (at_, kind)
    found, t = [], n
    while t > 1:
        k, kind = cut[t]
        if kind != "b":
            found.append((k, t, kind))
        if kind == "n":
            u = t
            while u > k + 1:
                m = int(inner_cut[k, u])
                if m:
                    found.append((m, u, "o"))
                u = m if m else u - 1
        t = k
    return sorted(found)


def change_segments(energies: DataFrame, longest_s: float, alpha: float) -> DataFrame:
    """file_id, page, node, s, e, type: changes in node_energies(), against the page's lower tenth as background."""

    def find(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("win")
        e, step = x["energy"].to_numpy(), x["real_window"].iloc[0]
        e = e + 1e-5 if e.max() > 1e-2 else e
        series = np.sqrt(e / max(np.percentile(e, 10), 1e-12))
        got = change_points(series, ceil(longest_s / step), alpha)
        return pd.DataFrame([(x["file_id"].iloc[0], x["page"].iloc[0], x["node"].iloc[0], s * step, t * step, k) for s, t, k in got], columns=["file_id", "page", "node", "s", "e", "type"])

    return energies.groupBy(*KEYS, "node").applyInPandas(find, "file_id string, page int, node int, s double, e double, type string")


def denoised(pages: DataFrame, level: int, filters: tuple[np.ndarray, np.ndarray], factor: float = 4.5) -> DataFrame:
    """Pages rebuilt from an orthogonal wavelet tree whose coefficients under factor times the noise are shrunk.

    The noise is the median size of the finest details over 0.6745. Periodic edges.
    """
    low, high = filters

    def split(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wide = np.concatenate([c, np.resize(c, len(low))])
        view = np.lib.stride_tricks.sliding_window_view(wide, len(low))[: len(c) : 2]
        return view @ low[::-1], view @ high[::-1]

    def join(a: np.ndarray, d: np.ndarray) -> np.ndarray:
        out = np.zeros(2 * len(a))
        for k in range(len(low)):
            np.add.at(out, (2 * np.arange(len(a)) + k) % len(out), a * low[::-1][k] + d * high[::-1][k])
        return out

    def kernel(x: np.ndarray, fs: int) -> dict:
        if not len(x):
            return {"fs": [fs], "samples": [x]}
        block = 2**level
        c, details = np.pad(x, (0, -len(x) % block)), []
        for _ in range(level):
            c, d = split(c)
            details.append(d)
        noise = np.median(np.abs(details[0])) / 0.6745
        for d in reversed(details):
            c = join(c, np.sign(d) * np.maximum(np.abs(d) - factor * noise, 0))
        return {"fs": [fs], "samples": [c[: len(x)]]}

    return per_page(pages, kernel, "fs int, samples array<double>")

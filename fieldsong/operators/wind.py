"""What wind leaves in each node of a wavelet tree: a cubic through other nodes' log energies, by squares or by quantile.

All windows of a group are fitted at once: the nodes, and so the polynomial's terms, are the same for each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Nodes of a tree of five levels that are not asked about wind (its ends), the highest frequency that is, and what
#: the columns of the polynomial are multiplied by.
LEAVES, ENDS, WIND_BELOW = range(31, 63), (31, 47), 6000.0
COLUMN_SCALE = np.array([1000.0, 100.0, 10.0, 1.0])
LEAST_RESIDUAL = 1e-6


def polynomial(f: np.ndarray) -> np.ndarray:
    return np.vander(np.log(f), 4, increasing=True)


def least_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of each column of y on x."""
    return np.linalg.lstsq(x, y, rcond=None)[0]


def quantile_fit(x: np.ndarray, y: np.ndarray, q: float, most: int = 250, still: float = 1e-3) -> np.ndarray:
    """Coefficients that leave a share q of each column of y below x, by squares weighted anew each round.

    All columns are solved at once, as a stack of small systems; a column is done when its coefficients (of the scaled
    terms) move by `still` at most, and no later than after `most` rounds.
    """
    z = x * COLUMN_SCALE
    beta = np.ones((y.shape[1], 4))
    weight = np.ones((y.shape[1], len(x)))
    todo = np.arange(y.shape[1])
    for _ in range(most):
        if not len(todo):
            break
        w = weight[todo]
        left = np.einsum("cn,ni,nj->cij", w, z, z)
        right = np.einsum("cn,ni,nc->ci", w, z, y[:, todo])
        new = np.einsum("cij,cj->ci", np.linalg.pinv(left), right)
        rest = y[:, todo].T - new @ z.T
        rest = np.where(np.abs(rest) < LEAST_RESIDUAL, np.where(rest >= 0, LEAST_RESIDUAL, -LEAST_RESIDUAL), rest)
        weight[todo] = 1 / np.abs(np.where(rest < 0, q * rest, (1 - q) * rest))
        moved = np.abs(new - beta[todo]).max(axis=1)
        beta[todo] = new
        todo = todo[moved > still]
    return (beta * COLUMN_SCALE).T


def wind_nodes(targets: list[int]) -> list[int]:
    """Leaves that say what the wind is: no targets, no children of targets, not at the tree's ends."""
    return [n for n in LEAVES if n not in targets and (n - 1) // 2 not in targets and n not in ENDS]


def predicted(energies: DataFrame, bands: DataFrame, targets: list[int], how: str = "squares", over: float = 1.0, q: float = 0.2, lift: float = 0.0) -> DataFrame:
    """file_id, page, win, node, wind: the energy that wind gives each target node of a window.

    energies(file_id, page, node, win, energy) with the root 0, the leaves and the targets; bands(node, f_lo, f_hi).
    how: "squares" or "quantile" (a share q of the nodes lies below; lift is added to its logarithms). A target of the
    fourth level has the mean of the predictions at the middles of its two halves. The prediction goes `over` times
    as far from the node's background, its mean log energy in the tenth of windows with the least root energy.
    Windows without energies of at least five wind nodes have no prediction.
    """
    nodes = wind_nodes(targets)
    band = {r.node: (r.f_lo, r.f_hi) for r in bands.where(F.col("node").isin([*nodes, *targets])).collect()}  # at most a tree's nodes
    nodes = [n for n in nodes if n in band and sum(band[n]) / 2 < WIND_BELOW]
    targets = [n for n in targets if n in band]
    middle = {n: sum(band[n]) / 2 for n in band}
    # The quietest windows of a page are found once, by the root's energy.
    root = energies.where("node = 0").withColumn("calm", F.row_number().over(Window.partitionBy("file_id", "page").orderBy("energy", "win")))
    calm = root.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("file_id", "page"))).where(F.col("calm") <= F.round(F.col("n") * 0.1)).select("file_id", "page", "win")
    log = F.ln(F.greatest("energy", F.lit(1e-12)))
    ground = energies.where(F.col("node").isin(targets)).join(calm, ["file_id", "page", "win"], "left_semi").groupBy("file_id", "page", "node").agg(F.avg(log).alias("ground"))
    rows = energies.where(F.col("node").isin(nodes)).groupBy("file_id", "page", "win").agg(F.map_from_entries(F.collect_list(F.struct("node", log))).alias("logs"))
    rows = rows.where(F.size("logs") == len(nodes))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = polynomial(np.array([middle[n] for n in nodes])) if nodes else None
        for batch in batches:
            if not len(batch) or len(nodes) < 5 or not targets:
                continue
            y = np.array([[logs[n] for n in nodes] for logs in map(dict, batch["logs"])]).T
            beta = least_squares(x, y) if how == "squares" else quantile_fit(x, y, q)
            for n in targets:
                wide = (band[n][1] - band[n][0]) / 4
                at = [middle[n] - wide, middle[n] + wide] if 15 <= n < 31 else [middle[n]] * 2
                low, high = (polynomial(np.array([f]))[0] @ beta + (lift if how == "quantile" else 0.0) for f in at)
                yield pd.DataFrame({"file_id": batch["file_id"], "page": batch["page"], "win": batch["win"], "node": n, "low": low, "high": high})

    found = rows.mapInPandas(fit, "file_id string, page int, win int, node int, low double, high double").join(ground, ["file_id", "page", "node"], "left")
    base = F.coalesce("ground", F.lit(0.0))
    further = lambda c: F.exp((F.col(c) - base) * over + base)
    return found.select("file_id", "page", "win", "node", ((further("low") + further("high")) / 2).alias("wind"))

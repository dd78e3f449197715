"""Choosing a recogniser's nodes and threshold: standardised energies, a grid of settings, greedy and subset search."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldsong.operators.signal import KEYS


def standardised(energies: DataFrame, m: int, constant: float = 0.0) -> DataFrame:
    """Logarithms of energies, averaged over m windows on either side, less their node's mean and over its deviation.

    constant is what a node's windows get where all are alike, as one alone is.
    """
    near = Window.partitionBy(*KEYS, "node").orderBy("win").rowsBetween(-m, m)
    whole = Window.partitionBy(*KEYS, "node")
    smooth = energies.withColumn("y", F.ln(F.avg("energy").over(near) + 1e-12))
    sd = F.stddev_pop("y").over(whole)
    return smooth.select(*KEYS, "node", "win", F.when(sd > 0, (F.col("y") - F.avg("y").over(whole)) / sd).otherwise(float(constant)).alias("z"))


def _score(hit: set, truth: set) -> float:
    """F-score that weighs recall twice; 0 where undefined."""
    tp = len(hit & truth)
    return 5 * tp / (5 * tp + 4 * (len(truth) - tp) + len(hit) - tp) if tp else 0.0


def greedy_nodes(z: DataFrame, truth: DataFrame, nodes: list[int], thresholds: list[float]) -> DataFrame:
    """file_id, threshold, nodes, fbeta: nodes in order, each kept if it betters the F-score of the windows detected.

    z(file_id, page, node, win, z) and truth(file_id, win, present). The grid of thresholds and files is spread
    over tasks; one search sees one file's windows.
    """
    grid = z.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    hits = z.where(F.col("node").isin(nodes)).join(F.broadcast(grid), F.col("z") > F.col("threshold"))  # a short list
    true = truth.where("present = 1").groupBy("file_id").agg(F.collect_list("win").alias("true"))
    per = hits.groupBy("file_id", "threshold", "node").agg(F.collect_set("win").alias("hit")).join(true, "file_id", "left")

    def search(x: pd.DataFrame) -> pd.DataFrame:
        real = set(x["true"].iloc[0]) if x["true"].iloc[0] is not None else set()
        own = {n: set(h) for n, h in zip(x["node"], x["hit"])}
        kept, found, best = [], set(), 0.0
        for n in nodes:
            now = _score(found | own.get(n, set()), real)
            if n in own and now > best:
                kept, found, best = [*kept, n], found | own[n], now
        return pd.DataFrame({"file_id": [x["file_id"].iloc[0]], "threshold": [x["threshold"].iloc[0]], "nodes": [kept], "fbeta": [best]})

    return per.groupBy("file_id", "threshold").applyInPandas(search, "file_id string, threshold double, nodes array<int>, fbeta double")


def best_subset(hits: DataFrame, nodes: list[int], most: int = 6, price: float = 0.01) -> DataFrame:
    """threshold, nodes, score: of all sets of up to most nodes the best F-score less price a node, at each threshold.

    hits(threshold, file_id, win, present, node) has a row for each node that detects a window, and rows with a
    null node keep windows that none detects. Windows are reduced to counts by which nodes detect them, at most
    2 ** len(nodes) of them, and sets are spread over tasks.
    """
    bit = {n: 1 << k for k, n in enumerate(nodes)}
    mask = F.sum(F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in bit.items() for v in kv]), F.col("node")), F.lit(0)))
    seen = hits.groupBy("threshold", "file_id", "win").agg(F.max("present").alias("present"), mask.alias("mask"))
    counts = seen.groupBy("threshold", "mask").agg(F.sum("present").alias("pos"), F.sum(1 - F.col("present")).alias("neg"))
    sets = [(sum(bit[n] for n in c), list(c)) for k in range(1, most + 1) for c in combinations(nodes, k)]
    trial = hits.sparkSession.createDataFrame(sets, "own int, nodes array<int>")
    got = F.col("mask").bitwiseAND(F.col("own")) != 0
    sums = counts.join(trial, F.lit(True)).groupBy("threshold", "own").agg(F.first("nodes").alias("nodes"), F.sum(F.when(got, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(got, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(got, 0).otherwise(F.col("pos"))).alias("fn"))
    score = F.when(F.col("tp") > 0, 5 * F.col("tp") / (5 * F.col("tp") + 4 * F.col("fn") + F.col("fp"))).otherwise(0.0) - price * F.size("nodes")
    best = Window.partitionBy("threshold").orderBy(F.desc("score"), F.size("nodes"), "own")
    return sums.withColumn("score", score).withColumn("nth", F.row_number().over(best)).where("nth = 1").select("threshold", "nodes", "score")

"""Making a recogniser from annotated recordings, testing it, and checking detections by given frame probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldsong.operators import intervals, synthesis, wavelets
from fieldsong.operators.evaluate import point_biserial
from fieldsong.operators.signal import band_passed, spread

#: Nodes above these are too coarse for a recogniser; a recording's nodes that are tried; the score at which a search ends.
COARSE, TRIED, ENOUGH = 15, 10, 0.95
#: Rows of peaks that a task hands on at once.
PEAKS = 20_000


def family_order(nodes: list[int]) -> list[int]:
    """nodes with every node's children, and theirs, that are in the list before it; else the order stays."""
    out: list[int] = []

    def add(n: int) -> None:
        if n not in out:
            for child in sorted((m for m in nodes if m != n and _below(m, n)), reverse=True):
                add(child)
            out.append(n)

    for n in nodes:
        add(n)
    return out


def _below(node: int, above: int) -> bool:
    while node > above:
        node = (node - 1) // 2
    return node == above


def candidate_nodes(energies: DataFrame, truth: DataFrame, bands: DataFrame, low: float, high: float) -> DataFrame:
    """file_id, nodes: the nodes of a recording whose energies go with its calls most, children before parents.

    energies(file_id, node, win, energy), truth(file_id, win, present), bands(node, f_lo, f_hi). Coarse nodes and those
    outside low to high Hz are left out, and so are nodes whose correlation is not defined.
    """
    # Nodes of a tree, read here: joined as rows, the optimiser would work out the bands anew for every energy.
    fit = [r.node for r in bands.where((F.col("f_lo") < high) & (F.col("f_hi") > low) & (F.col("node") >= COARSE)).select("node").distinct().collect()]
    both = energies.where(F.col("node").isin(fit)).join(truth, ["file_id", "win"])
    r = point_biserial(both, ["file_id", "node"], "energy", F.col("present") == 1).where("r is not null and not isnan(r)")
    best = Window.partitionBy("file_id").orderBy(F.desc("r"), "node")
    ranked = r.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= TRIED)
    listed = ranked.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "node"))), lambda p: p["node"]).alias("nodes"))
    ordered = F.pandas_udf(lambda lists: lists.map(lambda x: family_order([int(n) for n in x])), "array<int>")
    return listed.select("file_id", ordered("nodes").alias("nodes"))


def node_peaks(pages: DataFrame, nodes: DataFrame, truth: DataFrame, smoothing: list[float], filters: tuple[np.ndarray, np.ndarray], window: float = 1.0) -> DataFrame:
    """file_id, page, node, place, m, win, peak: how loud a rebuilt node is in each window, in deviations of its logarithms outside calls.

    One rebuilding of a node serves all smoothings m; place is the node's in its list. Recordings without nodes, and nodes that are silent or have no
    time outside calls, have no rows.
    """
    calls = truth.where("present = 1").groupBy("file_id").agg(F.collect_set("win").alias("calls"))
    both = pages.join(nodes, "file_id").join(calls, "file_id", "left").select("file_id", "page", "fs", "samples", "nodes", "calls")
    rows = spread(both, "file_id", "page")

    def peaks(r) -> Iterator[dict]:
        x, size = np.asarray(r.samples, float), ceil(window * r.fs)
        n = ceil(len(x) / size)
        quiet = np.repeat(~np.isin(np.arange(n), [] if r.calls is None else r.calls), size)[: len(x)]
        starts = np.arange(n) * size
        ends = np.minimum(starts + size, len(x))
        places = [int(k) for k in r.nodes]
        for node, c in wavelets.packet(x, places, *filters).items():
            loud = np.abs(synthesis.only_band(synthesis.rebuilt(c, node, filters, len(x)), node))
            logs = np.log(np.maximum(loud[quiet], 1e-300))
            if not loud.any() or not len(logs) or logs.std() == 0:
                continue
            for m in smoothing:
                upto = np.concatenate([[0.0], np.cumsum(synthesis.energy_curve(loud, int(m * size)))])
                mean = (upto[ends] - upto[starts]) / (ends - starts)
                peak = (np.log(np.maximum(mean, 1e-300)) - logs.mean()) / logs.std()
                yield {"node": node, "place": places.index(node), "m": m, "win": np.arange(n), "peak": peak}

    def joined(found: list[tuple]) -> pd.DataFrame:
        sizes = [len(d["win"]) for _, _, d in found]
        wide = {"file_id": np.repeat(np.array([f for f, _, _ in found], dtype=object), sizes), "page": np.repeat([p for _, p, _ in found], sizes)}
        wide |= {c: np.repeat([d[c] for _, _, d in found], sizes) for c in ("node", "place", "m")}
        return pd.DataFrame({**wide, **{c: np.concatenate([d[c] for _, _, d in found]) for c in ("win", "peak")}})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, held = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                for d in peaks(r):
                    found.append((r.file_id, r.page, d))
                    held += len(d["win"])
                if held >= PEAKS:
                    yield joined(found)
                    found, held = [], 0
        if found:
            yield joined(found)

    return rows.mapInPandas(find, "file_id string, page int, node int, place int, m double, win int, peak double")


def f_beta(found: np.ndarray, real: np.ndarray) -> tuple[float, float]:
    """F-score that weighs recall twice, and recall; 0 where undefined."""
    tp = float((found & real).sum())
    return (5 * tp / (4 * real.sum() + found.sum()), tp / real.sum()) if tp else (0.0, 0.0)


def kept_nodes(places: np.ndarray, nodes: np.ndarray, wins: np.ndarray, peaks: np.ndarray, marked: np.ndarray, present: np.ndarray, thresholds: list[float]) -> Iterator[tuple[list[int], int, int, int, int]]:
    """For each threshold the nodes kept and tp, fp, tn, fn of one recording's windows that have both peaks and a truth."""
    both = np.intersect1d(wins, marked)
    inside = np.isin(wins, both)
    places, nodes, wins, peaks = places[inside], nodes[inside], wins[inside], peaks[inside]
    order = list(dict.fromkeys(nodes[np.lexsort((nodes, places))].tolist()))
    real = np.zeros(len(both), bool)
    real[np.searchsorted(both, marked[np.isin(marked, both) & (present > 0)])] = True
    wide = np.full((len(order), len(both)), np.nan)
    by_node = np.argsort(order)
    np.fmax.at(wide, (by_node[np.searchsorted(order, nodes, sorter=by_node)], np.searchsorted(both, wins)), peaks)
    for t in thresholds:
        hits = wide > t
        found, kept, best, recall = np.zeros(len(real), bool), [], 0.0, 0.0
        for k in np.argsort([f_beta(h, real)[0] for h in hits], kind="stable")[::-1]:
            together = found | hits[k]
            score, now = f_beta(together, real)
            if score > best:
                found, best, recall = together, score, now
                kept.append(order[k])
            if best == ENOUGH or recall == ENOUGH:
                break
        yield kept, int((found & real).sum()), int((found & ~real).sum()), int((~found & ~real).sum()), int((~found & real).sum())


def grid_search(peaks: DataFrame, truth: DataFrame, thresholds: list[float]) -> DataFrame:
    """m, threshold, nodes, tp, fp, tn, fn: for each setting the nodes that any recording kept, and the counts of windows.

    In each recording nodes are tried by their own F-score, the best first (of equal ones the later), and kept if they better
    the F-score together; a search ends at a score or recall of ENOUGH exactly. Recordings are spread over tasks, and a task
    adds up those it reads at once, so few rows are left for the sums over all.
    """
    lists = lambda *names: F.collect_list(F.struct(*names)).alias("rows")
    marks = truth.where("win is not null").groupBy("file_id").agg(lists("win", "present")).select("file_id", F.col("rows.win").alias("marked"), F.col("rows.present").alias("present"))
    heard = spread(peaks.where("win is not null and node is not null"), "file_id").groupBy("file_id", "m").agg(lists("place", "node", "win", "peak"))
    rows = heard.join(marks.hint("shuffle_merge"), "file_id").select("m", *[F.col(f"rows.{c}").alias(c) for c in ("place", "node", "win", "peak")], "marked", "present")
    grid = [float(t) for t in thresholds]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            sums: dict[tuple[float, float], list] = {}
            for m, *columns in x.itertuples(index=False, name=None):
                if not np.isin(columns[2], columns[4]).any():
                    continue
                whole = [np.asarray(c, kind) for c, kind in zip(columns, (int, int, int, float, int, float))]
                for t, (kept, *counts) in zip(grid, kept_nodes(*whole, grid)):
                    nodes, total = sums.setdefault((m, t), [set(), np.zeros(4, np.int64)])
                    nodes.update(kept)
                    total += counts
            yield pd.DataFrame([(m, t, sorted(nodes), *total.tolist()) for (m, t), (nodes, total) in sums.items()], columns=["m", "threshold", "kept", "tp", "fp", "tn", "fn"])

    each = rows.mapInPandas(search, "m double, threshold double, kept array<int>, tp long, fp long, tn long, fn long")
    return each.groupBy("m", "threshold").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("kept")))).alias("nodes"), *[F.sum(c).alias(c) for c in ("tp", "fp", "tn", "fn")])


def train(pages: DataFrame, truth: DataFrame, bands: DataFrame, low: float, high: float, thresholds: list[float], smoothing: list[float], filters: tuple[np.ndarray, np.ndarray], window: float = 1.0) -> DataFrame:
    """grid_search() of recordings(file_id, page, fs, samples) with truth(file_id, win, present), from the samples on: energies, candidates, peaks, grid."""
    heard = band_passed(spread(pages, "file_id", "page"), low, high)
    energies = wavelets.node_energies(heard, list(range(COARSE, 63)), window, filters)
    nodes = candidate_nodes(energies, truth, bands, low, high)
    return grid_search(node_peaks(pages, nodes, truth, smoothing, filters, window), truth, thresholds)


def recogniser_report(windows: DataFrame, truth: DataFrame, least: float, gap: float, window: float = 1.0) -> DataFrame:
    """stage, tp, fp, tn, fn, recall, precision, specificity of detected windows: as they are, and after gaps are closed and short calls deleted.

    windows(file_id, win, present) and truth(file_id, win, present). Windows that only one of them has count as absent in the other.
    """
    both = truth.select("file_id", "win", F.col("present").alias("real")).join(windows.select("file_id", "win", F.col("present").alias("raw")), ["file_id", "win"], "full").fillna(0)
    runs = intervals.run_lengths(both, ["file_id"], "win", "raw", window).withColumn("ord", F.col("s"))
    joined = intervals._islands(runs, ["file_id"], [F.col("s"), F.col("ord")], F.col("s") - F.col("reach") > gap).groupBy("file_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    kept = joined.where(F.col("e") - F.col("s") >= least)
    cells = kept.select("file_id", F.explode(F.sequence(F.floor(F.col("s") / window).cast("int"), (F.ceil(F.col("e") / window) - 1).cast("int"))).alias("win")).distinct().withColumn("clean", F.lit(1))
    marked = both.join(cells, ["file_id", "win"], "left").fillna(0)
    stages = marked.select("real", F.explode(F.array(F.struct(F.lit("windows").alias("stage"), F.col("raw").alias("hit")), F.struct(F.lit("calls").alias("stage"), F.col("clean").alias("hit")))).alias("x")).select("real", "x.*")
    n = lambda r, h: F.count_if((F.col("real") == r) & (F.col("hit") == h))
    counts = stages.groupBy("stage").agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(0, 0).alias("tn"), n(1, 0).alias("fn"))
    share = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col(a) / (F.col(a) + F.col(b)))
    return counts.select("*", share("tp", "fn").alias("recall"), share("tp", "fp").alias("precision"), share("tn", "fp").alias("specificity"))


def frame_spans(segments: DataFrame, frame: float, duration: Column) -> DataFrame:
    """Segments(s, e) of a frame's length or less made longer about their middle, within the recording: what a network is shown."""
    length = F.col("e") - F.col("s")
    more = (frame - length) / 2 + 0.005
    s, e = F.col("s") - more, F.col("e") + more
    start = F.when(s < 0, 0.0).when(e > duration, duration - frame - 0.01).otherwise(s)
    end = F.when(s < 0, frame + 0.01).when(e > duration, duration).otherwise(e)
    short = length <= frame
    return segments.select(*[c for c in segments.columns if c not in ("s", "e")], F.when(short, start).otherwise(F.col("s")).alias("s"), F.when(short, end).otherwise(F.col("e")).alias("e"))


def verified(segments: DataFrame, frames: DataFrame, by: list[str], order: str, low: Column, high: Column, least: float, hop: float) -> DataFrame:
    """Segments with certainty 90 or 50: their frames' probabilities stay over `high`, or over `low`, for `least` seconds; others go.

    frames(*by, order, probability) are the frames of each segment; segments without frames go too.
    """
    sure = intervals.longest_run(frames, by, [order], F.col("probability") >= high, hop).withColumnRenamed("active", "sure")
    some = intervals.longest_run(frames, by, [order], F.col("probability") >= low, hop).withColumnRenamed("active", "some")
    both = segments.drop("certainty").join(sure, by).join(some, by)
    return both.withColumn("certainty", F.when(F.col("sure") >= least, 90).when(F.col("some") >= least, 50)).where("certainty is not null").drop("sure", "some")

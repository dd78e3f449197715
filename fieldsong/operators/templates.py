"""Matches of templates in recordings: normalised cross-correlation of pictures, and time warping of series.

Templates are few and short and are broadcast; recordings come page by page. Matches near a page's end are looked for
with the next page's first frames behind it, and neighbouring matches give way to the best one over the pages' edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Templates may have so many cells in all: they are held by every task.
MOST_CELLS = 1 << 24


def correlation(picture: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Pearson's correlation of the template with the picture at each place in time where it fits, over all bins.

    Both are frames by bins with equal bins. One transform a bin takes all places at once; where the picture is
    flat the correlation is 0.
    """
    n, m = len(picture), len(template)
    if n < m or not m:
        return np.zeros(0)
    t = template - template.mean()
    size = 1 << int(np.ceil(np.log2(n + m)))
    products = np.fft.irfft((np.fft.rfft(picture, size, axis=0) * np.conj(np.fft.rfft(t, size, axis=0))).sum(axis=1), size)[: n - m + 1]
    sums = [np.concatenate([[0.0], np.cumsum(x.sum(axis=1))]) for x in (picture, picture**2)]
    total, squares = (s[m:] - s[: n - m + 1] for s in sums)
    spread = np.maximum(squares - total**2 / template.size, 0)
    scale = np.sqrt(spread * (t**2).sum())
    flat = scale <= 1e-9 * max(1.0, float(np.abs(picture).max())) * template.size
    return np.where(flat, 0.0, products / np.where(flat, 1.0, scale))


def _held(templates: DataFrame, column: str) -> dict:
    """The templates by name; an error if they are more than a broadcast should hold."""
    cells = templates.select(F.coalesce(F.sum(F.size(column)), F.lit(0))).first()[0]
    if cells > MOST_CELLS:
        raise ValueError(f"templates of {cells} values are too many to be held by every task, {MOST_CELLS} at most")
    return {r[0]: r[1] for r in templates.select("template", column).collect()}


def correlated(frames: DataFrame, templates: DataFrame) -> DataFrame:
    """template, file_id, page, frame, score: the correlation where the template begins at that frame of a page.

    frames(file_id, page, frame, mags); templates(template, mags): one array of frames' bins, frame by frame. A page's
    last frames are met with the first ones of the next page, as many as the longest template has, so each place is
    scored once.
    """
    held = {k: np.asarray(v, float) for k, v in _held(templates, "mags").items()}
    sent = frames.sparkSession.sparkContext.broadcast(held)
    bins = frames.select(F.size("mags")).first()
    longest = max((len(v) // bins[0] for v in held.values()), default=0) if bins else 0
    edge = frames.where(F.col("frame") < longest - 1).where("page > 0").select("file_id", (F.col("page") - 1).alias("page"), (F.col("frame") + (1 << 30)).alias("frame"), "mags")
    whole = frames.select("file_id", "page", "frame", "mags").unionByName(edge)

    def find(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("frame")
        picture = np.stack(x["mags"]).astype(float)
        own, parts = int((x["frame"] < 1 << 30).sum()), []
        for name, cells in sent.value.items():
            score = correlation(picture, cells.reshape(-1, picture.shape[1]))[:own]
            parts.append(pd.DataFrame({"template": name, "frame": x["frame"].to_numpy()[: len(score)], "score": score}))
        out = pd.concat(parts) if parts else pd.DataFrame({"template": [], "frame": [], "score": []})
        return out.assign(file_id=x["file_id"].iloc[0], page=x["page"].iloc[0])[["template", "file_id", "page", "frame", "score"]]

    return whole.groupBy("file_id", "page").applyInPandas(find, "template string, file_id string, page int, frame int, score double")


def best_apart(scores: DataFrame, by: list[str], at: str, threshold: float, apart: DataFrame) -> DataFrame:
    """Peaks of scores(*by, at, score) over a share of the highest of each group, those closer than `apart` to a higher one left out.

    apart(template, apart) says how far. A peak is higher than the place before and not lower than the one after. The
    highest peak stays and its neighbours go, then the highest of the rest, and so on; equal ones in the order of time.
    A chain of neighbours is one group, so what one task holds is bounded by how long calls overlap, not by the recording.
    """
    line = Window.partitionBy(*by).orderBy(at)
    top = F.max("score").over(Window.partitionBy(*by))
    peaks = scores.withColumns({"top": top, "before": F.lag("score").over(line), "after": F.lead("score").over(line)})
    peaks = peaks.where((F.col("score") >= threshold * F.col("top")) & (F.col("score") > F.coalesce("before", F.lit(float("-inf")))) & (F.col("score") >= F.coalesce("after", F.lit(float("-inf")))))
    peaks = peaks.join(F.broadcast(apart), "template").withColumn("new", F.coalesce((F.col(at) - F.lag(at).over(line) >= F.col("apart")).cast("int"), F.lit(1)))
    chains = peaks.withColumn("chain", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    def keep(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["score", at], ascending=[False, True])
        spots, kept = x[at].to_numpy(), []
        for k, s in enumerate(spots):
            if all(abs(s - spots[j]) >= x["apart"].iloc[k] for j in kept):
                kept.append(k)
        return x.iloc[kept][[*by, at, "score"]]

    kinds = dict(scores.dtypes)
    return chains.select(*by, at, "score", "apart", "chain").groupBy(*by, "chain").applyInPandas(keep, ", ".join(f"{c} {kinds[c]}" for c in [*by, at, "score"]))


def matches(frames: DataFrame, templates: DataFrame, hop_s: float, threshold: float, page_frames: int) -> DataFrame:
    """template, file_id, s, e, score: where templates are found, in seconds of the recording, half a template apart at least."""
    bins = frames.select(F.size("mags").alias("bins")).limit(1)
    lengths = templates.crossJoin(F.broadcast(bins)).select("template", (F.size("mags") / F.col("bins")).alias("frames"))  # one row
    scores = correlated(frames, templates).withColumn("at", F.col("page") * F.lit(page_frames) + F.col("frame"))
    found = best_apart(scores, ["template", "file_id"], "at", threshold, lengths.select("template", (F.col("frames") / 2).alias("apart")))
    met = found.join(F.broadcast(lengths), "template")
    return met.select("template", "file_id", (F.col("at") * hop_s).alias("s"), ((F.col("at") + F.col("frames")) * hop_s).alias("e"), "score")


def warping_matrix(a: np.ndarray, b: np.ndarray, anywhere: bool = False) -> np.ndarray:
    """Least sums of differences along paths; anywhere: a path may begin at any place of b. Values or vectors of values.

    One anti-diagonal at a time; the matrix has a row and a column more.
    """
    a, b = (np.asarray(x, float).reshape(len(x), -1) for x in (a, b))
    far = np.full((len(a) + 1, len(b) + 1), np.inf)
    far[0, : len(b) + 1 if anywhere else 1] = 0
    for d in range(2, len(a) + len(b) + 1):
        i = np.arange(max(1, d - len(b)), min(len(a), d - 1) + 1)
        j = d - i
        far[i, j] = np.abs(a[i - 1] - b[j - 1]).sum(axis=1) + np.minimum(np.minimum(far[i - 1, j], far[i, j - 1]), far[i - 1, j - 1])
    return far


def warping_path(far: np.ndarray, end: int | None = None, anywhere: bool = False) -> list[tuple[int, int]]:
    """Pairs of places from the start to (last, end) of a warping matrix; of equal steps back the diagonal one first, then the one in b."""
    i, j = len(far) - 2, far.shape[1] - 2 if end is None else end
    path = [(i, j)]
    while i > 0 or (j > 0 and not anywhere):
        step = int(np.argmin((far[i, j], far[i + 1, j], far[i, j + 1])))
        i, j = (i - 1, j - 1) if step == 0 else (i, j - 1) if step == 1 else (i - 1, j)
        path.append((i, j))
    return path[::-1]


def lower_bound(a: np.ndarray, b: np.ndarray) -> float:
    """No path costs less: each value of a meets one of b's, at best the nearest end of b's range or none."""
    if not len(a) or not len(b):
        return np.inf
    return float(np.maximum(np.maximum(b.min() - a, a - b.max()), 0).sum())


def warped_matches(series: DataFrame, templates: DataFrame, limit: float) -> DataFrame:
    """template, row columns, s, e, cost: of each series the place [s, e) that a template warps onto most cheaply, if for limit at most.

    series(key, x) and templates(template, x) with arrays of values. Series whose lower bound is over the limit are not
    warped; of equally cheap places the first. pruned counts are in warping_counts().
    """
    sent = series.sparkSession.sparkContext.broadcast({k: np.asarray(v, float) for k, v in _held(templates, "x").items()})

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for key, values in zip(x["key"], x["x"]):
                b = np.asarray(values, float)
                for name, a in sent.value.items():
                    if lower_bound(a, b) <= limit:
                        far = warping_matrix(a, b, anywhere=True)
                        end = int(np.argmin(far[-1, 1:]))
                        if far[-1, end + 1] <= limit:
                            rows.append((name, key, warping_path(far, end, True)[0][1], end + 1, float(far[-1, end + 1])))
            yield pd.DataFrame(rows, columns=["template", "key", "s", "e", "cost"])

    return series.select("key", "x").mapInPandas(find, f"template string, key {dict(series.dtypes)['key']}, s int, e int, cost double")


def warping_counts(series: DataFrame, templates: DataFrame, limit: float) -> DataFrame:
    """template, pairs, pruned: how many series each template meets, and how many of them the lower bound leaves out."""
    low, high = F.array_min("x"), F.array_max("x")
    each = series.select(low.cast("double").alias("low"), high.cast("double").alias("high")).crossJoin(F.broadcast(templates.select("template", F.col("x").alias("a"))))  # templates are few, see _held
    bound = F.aggregate("a", F.lit(0.0), lambda acc, v: acc + F.greatest(F.col("low") - v, v - F.col("high"), F.lit(0.0)))
    return each.groupBy("template").agg(F.count(F.lit(1)).alias("pairs"), F.count_if(bound > limit).alias("pruned"))

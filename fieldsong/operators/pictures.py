"""Pictures of time and frequency beyond the plain spectrogram: ridges through them, reassigned energy, constant-Q bands and chroma."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldsong.operators.prediction import let
from fieldsong.operators.signal import KEYS, per_page, spectrogram, window_of

#: Peaks of a frame that a ridge may go through, the largest ones.
PEAKS = 16


def ridge_candidates(frames: DataFrame, most: int = PEAKS) -> DataFrame:
    """file_id, page, frame, bin, w: the frames' largest local maxima over the bins, with the logarithm of their magnitude.

    A maximum is higher than the bin below and not lower than the one above; ends count too. Of equal ones the lower bin
    comes first. Frames that are 0 throughout have none.
    """
    n = F.size("mags")
    at = lambda i: F.when((i < 0) | (i >= n), F.lit(float("-inf"))).otherwise(F.get("mags", i).cast("double"))
    spots = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (at(i) > 0) & (at(i) > at(i - 1)) & (at(i) >= at(i + 1)))
    ranked = F.slice(F.array_sort(F.transform(spots, lambda i: F.struct((-at(i)).alias("m"), i.alias("bin")))), 1, most)
    each = frames.where(n > 0).select(*KEYS, "frame", F.explode(ranked).alias("p"))
    return each.select(*KEYS, "frame", F.col("p.bin").alias("bin"), F.ln(-F.col("p.m")).alias("w"))


def _steps(x: pd.DataFrame) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """frame, bins, weights of each frame that has candidates, in order of time."""
    x = x.sort_values(["frame", "bin"])
    frames, bins, w = x["frame"].to_numpy(), x["bin"].to_numpy(), x["w"].to_numpy()
    heads = np.flatnonzero(np.diff(frames, prepend=frames[0] - 1)) if len(frames) else []
    return [(int(frames[a]), bins[a:b], w[a:b]) for a, b in zip(heads, [*heads[1:], len(frames)])]


class Cost:
    """What a ridge loses: step for every bin that it moves off `drift` from one frame to the next, stay for every bin off `middle`; each over its spread."""

    def __init__(self, step: float, stay: float = 0.0, drift: float = 0.0, drift_spread: float = 1.0, middle: float = 0.0, middle_spread: float = 1.0):
        self.step, self.stay, self.drift, self.middle = step / drift_spread, stay / middle_spread, drift, middle

    def place(self, bins: np.ndarray) -> np.ndarray:
        return -self.stay * np.abs(bins - self.middle)

    def move(self, now: np.ndarray, before: np.ndarray) -> np.ndarray:
        return -self.step * np.abs(now[:, None] - before[None] - self.drift)


def _over(steps: list, cost: Cost, state: np.ndarray, before: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Best sums up to the last frame's candidates, from sums `state` (a column each start) at the candidates `before`; and where each came from."""
    came = []
    for _, bins, w in steps:
        gain = w + cost.place(bins)
        if before is None:
            state, back = np.where(np.eye(len(bins), dtype=bool), gain[:, None], -np.inf), np.arange(len(bins))[:, None].repeat(len(bins), axis=1)
        else:
            ways = cost.move(bins, before)[:, :, None] + state[None]
            back = ways.argmax(axis=1)
            state = np.take_along_axis(ways, back[:, None], axis=1)[:, 0] + gain[:, None]
        came.append(back)
        before = bins
    return state, came


def ridges(candidates: DataFrame, cost: Cost) -> DataFrame:
    """file_id, page, frame, bin: of each recording the path through one candidate a frame with the highest sum of weights less costs.

    Frames without candidates are stepped over. Every page first sums up, by itself, the best way from each of its first
    candidates to each of its last ones (at most PEAKS times PEAKS numbers); these tables are folded along a recording's
    pages, which says where the best path enters and leaves each page; then every page walks its own part. So no task
    holds more than a page, and what is folded is a small table a page.
    """
    sums = "file_id string, page int, first array<int>, last array<int>, best array<double>"

    def summed(x: pd.DataFrame) -> pd.DataFrame:
        steps = _steps(x)
        state, _ = _over(steps, cost, np.zeros(0), None)
        return pd.DataFrame({"file_id": [x["file_id"].iloc[0]], "page": [x["page"].iloc[0]], "first": [steps[0][1]], "last": [steps[-1][1]], "best": [state.ravel()]})

    def folded(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("page")
        firsts, lasts = ([np.asarray(v) for v in x[c]] for c in ("first", "last"))
        tables = [np.asarray(b).reshape(len(z), len(a)) for b, a, z in zip(x["best"], firsts, lasts)]
        total, entries, exits = None, [], []
        for a, z, t, before in zip(firsts, lasts, tables, [None, *lasts]):
            enter = np.zeros(len(a)) if total is None else (ways := cost.move(a, before) + total[None]).max(axis=1)
            entries.append(None if total is None else ways.argmax(axis=1))
            ways_out = t + enter[None]
            exits.append(ways_out.argmax(axis=1))
            total = ways_out.max(axis=1)
        spans, at = [], int(np.argmax(total))
        for k in range(len(x) - 1, -1, -1):
            start = int(exits[k][at])
            spans.append((x["file_id"].iloc[0], x["page"].iloc[k], start, at))
            at = int(entries[k][start]) if k else -1
        return pd.DataFrame(spans, columns=["file_id", "page", "enter", "leave"])

    spans = candidates.groupBy(*KEYS).applyInPandas(summed, sums).groupBy("file_id").applyInPandas(folded, "file_id string, page int, enter int, leave int")

    def walked(key: tuple, x: pd.DataFrame, span: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(span):
            return pd.DataFrame({"file_id": [], "page": [], "frame": [], "bin": []})
        steps, enter, at = _steps(x), int(span["enter"].iloc[0]), int(span["leave"].iloc[0])
        _, came = _over(steps, cost, np.zeros(0), None)
        path = []
        for (frame, bins, _), back in zip(reversed(steps), reversed(came)):
            path.append((key[0], key[1], frame, int(bins[at])))
            at = int(back[at, enter])
        return pd.DataFrame(path, columns=["file_id", "page", "frame", "bin"])

    return candidates.groupBy(*KEYS).cogroup(spans.groupBy(*KEYS)).applyInPandas(walked, "file_id string, page int, frame int, bin int")


def ridge_spread(path: DataFrame, page_frames: int) -> dict[str, float]:
    """Medians and spreads (half the middle half's width) of a ridge's bins and of its moves, over all recordings: what a second round's Cost takes."""
    line = Window.partitionBy("file_id").orderBy("at")
    moves = path.withColumn("at", F.col("page") * page_frames + F.col("frame")).withColumn("move", F.col("bin") - F.lag("bin").over(line))
    q = lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 10000)
    r = moves.agg(q("bin").alias("b"), q("move").alias("m")).first()
    half = lambda v: max(0.5, (v[2] - v[0]) / 2) if v else 1.0
    return {"drift": float(r.m[1]) if r.m else 0.0, "drift_spread": half(r.m), "middle": float(r.b[1]) if r.b else 0.0, "middle_spread": half(r.b)}


def reassigned(pages: DataFrame, width: int = 256, hop: int = 128, window: str = "Hann") -> DataFrame:
    """file_id, page, frame, bin, energy: magnitudes moved to where their phase says that they belong.

    Phases of a frame against those of the frame a sample earlier give a cell's frequency; phases against those one
    bin lower its delay. All cells' magnitudes are added up in a grid of as many frames and bins over the range of times and
    frequencies that there are, of which the lower half of frequencies is kept. Cells with nothing are left out. A page
    shorter than a frame has none.
    """

    def kernel(x: np.ndarray, fs: int) -> dict:
        starts = np.arange(0, len(x) - width, hop)
        if not len(starts):
            return {"frame": [], "bin": [], "energy": []}
        shape = window_of(window, width)
        frames = x[starts[:, None] + np.arange(width)]
        here, earlier = np.fft.fft(frames * shape, axis=1), np.fft.fft(np.roll(frames, 1, axis=1) * shape, axis=1)
        turn = lambda z: np.mod(np.angle(z) / (2 * np.pi), 1.0)
        frequency = turn(here * np.conj(earlier))
        delay = 0.5 - turn(here * np.conj(np.roll(here, 1, axis=1)))
        time = (starts[:, None] + width / 2 + delay * width) / fs
        seat = lambda v, n: np.minimum(((v - v.min()) / max(v.max() - v.min(), 1e-300) * n).astype(int), n - 1)
        place = seat(time, len(starts)) * width + seat(frequency, width)
        grid = np.bincount(place.ravel(), np.abs(here).ravel(), len(starts) * width).reshape(len(starts), width)[:, : width // 2]
        frame, bins = np.nonzero(grid)
        return {"frame": frame, "bin": bins, "energy": grid[frame, bins]}

    return per_page(pages, kernel, "frame int, bin int, energy double")


def constant_q_bands(fs: float, n: int, per_octave: int, lowest: float, highest: float | None = None, offset: float = 20.0) -> list[tuple[float, float]]:
    """Middle and width in Hz of the bands, per_octave to an octave: widths are a fixed share of the middle and an offset more.

    Bands that reach beyond half the rate, or below 0, are left out.
    """
    top = fs / 2 if highest is None else highest
    middles = lowest * 2 ** (np.arange(np.floor(per_octave * np.log2(top / lowest)) + 1) / per_octave)
    widths = (2 ** (1 / per_octave) - 2 ** (-1 / per_octave)) * middles + offset
    return [(float(m), float(w)) for m, w in zip(middles, widths) if m + w / 2 <= fs / 2 and m - w / 2 >= 0]


def constant_q(pages: DataFrame, per_octave: int = 48, lowest: float = 27.5, highest: float | None = None, offset: float = 20.0) -> DataFrame:
    """file_id, page, band, hz, step, seconds, mags: magnitudes of each band over time, seconds apart by `step`.

    One transform of the page; a Hann window in frequency, as wide as the band, cuts each band out, and one inverse
    transform of the bins that it spans gives the band's course at its own rate. A page's lowest bands may be narrower
    than its resolution: every band has four bins at least.
    """

    def kernel(x: np.ndarray, fs: int) -> dict:
        rows = []
        if len(x) > 1:
            wave, unit = np.fft.rfft(x), fs / len(x)
            for k, (middle, width) in enumerate(constant_q_bands(fs, len(x), per_octave, lowest, highest, offset)):
                at, m = int(round(middle / unit)), max(4, int(round(width / unit)))
                spots = at + np.arange(m) - m // 2
                inside = (spots >= 0) & (spots < len(wave))
                part = np.zeros(m, complex)
                part[inside] = wave[spots[inside]] * (0.5 + 0.5 * np.cos(2 * np.pi * (np.arange(m) - m // 2) / m))[inside]
                rows.append((k, middle, len(x) / fs / m, np.abs(np.fft.ifft(np.roll(part, -(m // 2)))) * 2 * m / len(x)))
        return dict(pd.DataFrame(rows, columns=["band", "hz", "step", "mags"]))

    return per_page(pages, kernel, "band int, hz double, step double, mags array<double>")


def chroma(frames: DataFrame, fs: int, width: int, reference: float = 261.6255653) -> DataFrame:
    """file_id, page, frame, chroma: energies of the twelve pitch classes from C on, over the largest of them.

    Each bin's energy goes to the class of the semitone nearest to its middle; the bin at 0 Hz takes no part. Silent frames
    are 0 throughout.
    """
    pitch = [-1] + [int(np.floor(12 * np.log2(k * fs / width / reference) + 0.5)) % 12 for k in range(1, width // 2 + 1)]
    of_bin = F.slice(F.lit(pitch).cast("array<int>"), 1, F.size("mags"))
    energy = lambda c: F.aggregate(F.zip_with("mags", of_bin, lambda m, k: F.when(k == c, m.cast("double") * m).otherwise(0.0)), F.lit(0.0), lambda acc, v: acc + v)
    classes = F.transform(F.sequence(F.lit(0), F.lit(11)), energy)
    found = frames.where(F.size("mags") > 1)
    over = let(classes, lambda c: let(F.array_max(c), lambda top: F.transform(c, lambda v: F.when(top > 0, v / top).otherwise(F.lit(0.0)))))
    return found.select(*KEYS, "frame", over.alias("chroma"))


#: Turns of a pitch class a semitone in the circles of fifths, of minor and of major thirds, and their radii.
TONAL_TURNS, TONAL_RADII = (7 / 6, 3 / 2, 2 / 3), (1.0, 1.0, 0.5)


def tonal_centroids(classes: DataFrame) -> DataFrame:
    """file_id, page, frame, tonal: where chroma(), as shares of its sum, lies in three circles: sine and cosine of each. Silent frames lie in the middle."""
    weights = [[r * wave(k * t * np.pi) for k in range(12)] for t, r in zip(TONAL_TURNS, TONAL_RADII) for wave in (np.sin, np.cos)]
    added = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    def axes(c: Column) -> Column:
        total = added(c)
        at = lambda w: added(F.zip_with(c, F.array(*[F.lit(float(x)) for x in w]), lambda v, x: v * x))
        return let(total, lambda t: F.transform(F.array(*map(at, weights)), lambda v: F.when(t > 0, v / t).otherwise(F.lit(0.0))))

    return classes.select(*KEYS, "frame", let(F.col("chroma"), axes).alias("tonal"))


def network_frames(frames: DataFrame, fs: int, hop: int, size_s: float, hop_s: float | None, columns: int, mask: tuple[float, float] | None = None) -> DataFrame:
    """file_id, page, image, pixels: pictures of so many columns, hop_s apart, for a network: bins from the highest down, column by column, over their largest.

    frames are a segment's spectrogram, file_id and page naming the segment. There are as many pictures as frames of
    size_s fit in it, hop_s (or their own length) apart; those that would reach beyond its end are left out, and silent
    ones are 0. Bins outside mask (Hz) are 0.
    """
    step = size_s if hop_s is None else hop_s
    bins = F.size("mags")
    if mask:
        unit = fs / 2 / bins
        frames = frames.withColumn("mags", F.transform("mags", lambda m, i: F.when((i < F.ceil(mask[0] / unit)) | (i >= F.floor(mask[1] / unit)), F.lit(0.0).cast("float")).otherwise(m.cast("float"))))
    own = frames.withColumn("n", F.max("frame").over(Window.partitionBy(*KEYS)) + 1)
    seconds = F.col("n") * (hop / fs)
    count = F.floor(seconds / size_s) if hop_s is None else F.floor((seconds - size_s) / hop_s) + 1
    # The pictures that a column is in: those that start at it or up to columns - 1 before.
    first = F.greatest(F.lit(0), F.floor((F.col("frame") - columns) * (hop / fs) / step).cast("int"))
    last = F.least(count.cast("int") - 1, F.ceil((F.col("frame") + 1) * (hop / fs) / step).cast("int"))
    each = own.where(last >= first).withColumn("image", F.explode(F.sequence(first, last))).withColumn("start", F.floor(F.col("image") * (step * fs / hop)).cast("int"))
    each = each.where((F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("start") + columns) & (F.col("start") + columns <= F.col("n")))
    packed = each.groupBy(*KEYS, "image").agg(F.array_sort(F.collect_list(F.struct("frame", "mags"))).alias("cols"))
    flat = packed.withColumn("pixels", F.flatten(F.transform("cols", lambda c: F.reverse(c["mags"]))))
    top = F.array_max("pixels")
    return flat.withColumn("top", top).select(*KEYS, "image", F.transform("pixels", lambda v: F.when(F.col("top") > 0, v / F.col("top")).otherwise(F.lit(0.0)).cast("float")).alias("pixels"))


#: The windows of a three-channel picture's spectrograms, in order.
CHANNELS = ("Hann", "Hamming", "Welch")


def channel_frames(pages: DataFrame, width: int, hop: int, fs: int, size_s: float, hop_s: float | None, columns: int) -> DataFrame:
    """file_id, page, image, channels: pictures for a network of three spectrograms each, one a window, each over its own largest; the last picture is left out."""
    parts = []
    for k, name in enumerate(CHANNELS):
        own = network_frames(spectrogram(pages, width, hop, name), fs, hop, size_s, hop_s, columns)
        parts.append(own.withColumn("k", F.lit(k)))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    packed = every.groupBy(*KEYS, "image").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "pixels"))), lambda p: p["pixels"]).alias("channels"))
    return packed.withColumn("last", F.max("image").over(Window.partitionBy(*KEYS))).where("image < last").drop("last")

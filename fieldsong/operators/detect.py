"""Batch detection as one plan: pages and recognisers in, merged and labelled segments out.

Recognisers of one sample rate share a wavelet tree: each page's tree is computed once for all nodes that any of
them wants, and a recogniser's detections are its nodes' windows above its threshold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsong.operators import cleaning, intervals, labels, signal, training, wavelets

#: Fixed value: how far any sound has to stand out of its frame's and its bin's median.
ANY_SOUND = 3.5


def window_detections(pages: DataFrame, filters: DataFrame, wanted: list[int], seconds: float = 1.0, bank: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """file_id, page, filter_id, calltype, win, present of pages at the recognisers' rate.

    filters(filter_id, calltype, thr, nodes) is a short table, see read_filters; wanted: all nodes in it.
    """
    energies = wavelets.node_energies(pages, wanted, seconds, bank or wavelets.daubechies(10))
    z = training.standardised(energies, 1)
    each = F.broadcast(filters.select("filter_id", "calltype", "thr", F.explode("nodes").alias("node")))  # nodes of recognisers
    hit = z.join(each, "node").groupBy("file_id", "page", "filter_id", "calltype", "win").agg(F.max((F.col("z") > F.col("thr")).cast("int")).alias("present"))
    return hit


def detected_segments(windows: DataFrame, filters: DataFrame, seconds: float, starts: DataFrame) -> DataFrame:
    """file_id, filter_id, species, calltype, s, e, certainty: runs of windows, joined over gaps, without short ones.

    Each recogniser's time range gives its least length and largest gap; longer segments than its longest are
    split. starts(file_id, page, page_start) says when a page begins; times count from the recording's start, and
    calls that go on over a page's edge are one.
    """
    runs = intervals.run_lengths(windows, ["file_id", "page", "filter_id", "calltype"], "win", "present", seconds)
    about = F.broadcast(filters.select("filter_id", "calltype", "species", "time_range"))  # a row a subfilter
    timed = runs.join(starts, ["file_id", "page"]).withColumns({c: F.col(c) + F.col("page_start") for c in ("s", "e")})
    rows = timed.join(about, ["filter_id", "calltype"]).withColumn("ord", F.col("s"))
    least, longest, gap = F.col("time_range")[0], F.col("time_range")[1], F.col("time_range")[3]
    by = ["file_id", "filter_id", "calltype", "species", "time_range"]
    apart = F.col("reach").isNull() | (F.col("s") - F.col("reach") > gap)
    joined = intervals._islands(rows, by, [F.col("s"), F.col("ord")], apart).groupBy(*by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    kept = joined.where(F.col("e") - F.col("s") >= least)
    n = F.greatest(F.lit(1), F.ceil((F.col("e") - F.col("s")) / longest)).cast("int")
    size = (F.col("e") - F.col("s")) / n
    pieces = kept.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("s") + F.col("piece") * size
    return pieces.select("file_id", "filter_id", "species", "calltype", start.alias("s"), (start + size).alias("e"), F.lit(50.0).alias("certainty"))


def cleaned(found: DataFrame, by: list[str], gap: float | None = None, least: float | None = None, longest: float | None = None) -> DataFrame:
    """by, s, e: detections after gaps are closed, short ones deleted and long ones split, in this order; None leaves a step out."""
    out = found.select(*by, "s", "e")
    if gap is not None:
        out = intervals.join_gaps(out.withColumn("ord", F.col("s")), by, gap).select(*by, "s", "e")
    if least is not None:
        out = out.where(F.col("e") - F.col("s") >= least)
    return intervals.split_long(out, longest).select(*by, "s", "e") if longest is not None else out


def any_sound(frames: DataFrame, hop_s: float, gap: float | None = None, least: float | None = None, longest: float | None = None, page_start: Column | None = None) -> DataFrame:
    """file_id, s, e, labels: whatever stands out of a page (median clipping at 3.5), cleaned up, with an unsure label.

    Times are the page's, or the recording's if page_start says when a page begins, by its columns file_id and page.
    """
    found = cleaned(signal.clipped_segments(frames, hop_s, ANY_SOUND), ["file_id", "page"], gap, least, longest)
    start = F.lit(0.0) if page_start is None else page_start
    return found.select("file_id", (F.col("s") + start).alias("s"), (F.col("e") + start).alias("e"), labels.no_label().alias("labels"))


def best_segments(frames: DataFrame, pages: DataFrame, hop_s: float, pitch_width: int, envelope: float = 0.7, clip: float = 3.0, voice: float = 0.9, lowest: float = 100.0) -> DataFrame:
    """file_id, page, s, e: the union of what the envelope, median clipping and the voice find, merged one after the other."""
    keys = ["file_id", "page"]
    loud = cleaning.envelope_segments(frames, hop_s, envelope)
    clear = signal.clipped_segments(frames, hop_s, clip)
    pages_rate = pages.select("fs").first()
    hop = (pitch_width // 2) / pages_rate.fs if pages_rate else 1.0
    voiced = signal.voiced_segments(signal.pitch(pages, pitch_width, voice), lowest, hop)
    return intervals.union_segments(intervals.union_segments(loud, clear, keys), voiced, keys)


def by_name(name: str, frames: DataFrame, pages: DataFrame, hop_s: float, **how) -> DataFrame:
    """file_id, page, s, e of the detector of that name: Envelope, Amplitude, Power, Clipping, Voice or Best; how: its own parameters."""
    detectors = {
        "Envelope": lambda: cleaning.envelope_segments(frames, hop_s, how.get("threshold", 0.7)),
        "Amplitude": lambda: signal.amplitude_segments(pages, how.get("share", 0.9)),
        "Power": lambda: signal.power_segments(frames, hop_s, how.get("threshold", 1.0)),
        "Clipping": lambda: signal.clipped_segments(frames, hop_s, how.get("threshold", 3.0), how.get("least_area", 70), how.get("least_axis", 5.0)),
        "Voice": lambda: signal.voiced_segments(signal.pitch(pages, how["width"], how.get("threshold", 0.5)), how.get("lowest", 100.0), how["width"] // 2 / how["fs"]),
        "Best": lambda: best_segments(frames, pages, hop_s, how["width"]),
    }
    if name not in detectors:
        raise ValueError(f"no detector is called {name}; there are {', '.join(detectors)}")
    return detectors[name]().select("file_id", "page", "s", "e")


def batch(pages: DataFrame, filters: DataFrame, seconds: float = 1.0) -> DataFrame:
    """Segments of all pages(file_id, page, fs, samples) for all recognisers: each rate is resampled to once.

    A page begins at its start_sample; without that column every recording is one page.
    """
    begin = F.col("start_sample") / F.col("fs") if "start_sample" in pages.columns else F.lit(0.0)
    starts = pages.select("file_id", "page", begin.alias("page_start"))
    listed = filters.select("sample_rate", "nodes").collect()  # a row a subfilter: recognisers are configuration
    parts = []
    for rate in sorted({r.sample_rate for r in listed}):
        own = filters.where(F.col("sample_rate") == rate)
        nodes = sorted({n for r in listed if r.sample_rate == rate for n in r.nodes})
        windows = window_detections(signal.resampled(pages, rate), own, nodes, seconds)
        parts.append(detected_segments(windows, own, seconds, starts))
    if not parts:
        return pages.sparkSession.createDataFrame([], "file_id string, filter_id string, species string, calltype string, s double, e double, certainty double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

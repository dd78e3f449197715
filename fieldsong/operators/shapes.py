"""Curves over time within segments: the middle line, and marks of the fundamental as they are drawn.

A shape is a struct: tstart, tend, tunit (seconds a value), y (values), yunit and ystart (what a value of 1 and of 0 stands for).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldsong.operators import intervals
from fieldsong.operators.signal import KEYS


def shape(start: Column, end: Column, unit: float, y: Column, y_unit: float, y_start: float = 0.0) -> Column:
    return F.struct(start.alias("tstart"), end.alias("tend"), F.lit(unit).alias("tunit"), y.alias("y"), F.lit(y_unit).alias("yunit"), F.lit(y_start).alias("ystart"))


def shape_text(of: Column) -> Column:
    """A shape as a JSON object, its start and end as the pair t."""
    return F.to_json(F.struct(F.array(of["tstart"], of["tend"]).alias("t"), of["tunit"].alias("tunit"), of["yunit"].alias("yunit"), of["ystart"].alias("ystart"), of["y"].alias("y")))


def middle_lines(segments: DataFrame, column_s: float, row_hz: float) -> DataFrame:
    """segments(s, e, f_lo, f_hi) with `shape`: a level line in the middle of the band, a value for each whole column of a picture."""
    n = F.greatest(F.lit(0), F.floor((F.col("e") - F.col("s")) / column_s)).cast("int")
    y = F.array_repeat((F.col("f_lo") + F.col("f_hi")) / 2 / row_hz, n)
    return segments.withColumn("shape", shape(F.col("s"), F.col("e"), column_s, y, row_hz))


def _line(rows: np.ndarray) -> tuple[int, np.ndarray]:
    """Where a mark's line starts, and its values: smoothed by a median, without the zeros that filled gaps leave at its ends."""
    n = len(rows)
    width = min((n - 1) // 2 * 2 + 1, 15)
    smooth = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(rows, width // 2), width), axis=1)
    first, last = 0, n - 1
    while first < width // 2 and smooth[first] == 0:
        first += 1
    while last > n - width // 2 and smooth[last] == 0:
        last -= 1
    return first, smooth[first:last]


def pitch_marks(pitches: DataFrame, fs: int, hop: int, width: int, rows: int, low: float, high: float) -> DataFrame:
    """file_id, page, mark, columns, rows: lines of the fundamental in a picture's columns and rows.

    pitches(file_id, page, win, f0) of windows of `width` samples, half of it apart. Windows whose pitch is from 50 Hz over `low` to
    `high` make marks: runs of two at least, joined over gaps of two, and then of four at least. In a joined gap the row is
    what the unvoiced window has, below the picture. Marks are numbered in the order of time.
    """
    seen = pitches.withColumn("on", F.coalesce((F.col("f0") > low + 50) & (F.col("f0") < high), F.lit(False)).cast("int"))
    runs = intervals.run_lengths(seen, KEYS, "win", "on").where("e - s >= 2").withColumn("ord", F.col("s"))
    long = intervals.join_gaps(runs, KEYS, 2.0).where("e - s >= 4").select(*KEYS, "s", "e")
    inside = seen.join(long, KEYS).where((F.col("win") >= F.col("s")) & (F.col("win") < F.col("e")))

    def draw(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("win")
        y = ((x["f0"].fillna(-1.0).to_numpy() - low) * (2 / fs * rows)).astype(int)
        first, line = _line(y)
        at = x["win"].to_numpy()[first : first + len(line)] * (width // 2) / hop
        return pd.DataFrame({"file_id": [x["file_id"].iloc[0]], "page": [x["page"].iloc[0]], "s": [x["s"].iloc[0]], "columns": [at], "rows": [line]})

    drawn = inside.select(*KEYS, "win", "f0", F.col("s").cast("double").alias("s"), "e").groupBy(*KEYS, "s", "e").applyInPandas(draw, "file_id string, page int, s double, columns array<double>, rows array<double>")
    return drawn.withColumn("mark", (F.row_number().over(Window.partitionBy(*KEYS).orderBy("s")) - 1)).select(*KEYS, "mark", "columns", "rows")

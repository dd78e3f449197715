"""Intervals of different recorders against each other: overlaps, clock shifts, matches, noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldsong.operators import grouping


def _overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.least(e1, e2) - F.greatest(s1, s2)


def bucketed(df: DataFrame, width: float, start: Column | None = None, end: Column | None = None, name: str = "bucket") -> DataFrame:
    """A row for each bucket of width that [start, end] touches: the key of a range join, so that rows far apart never meet."""
    s, e = F.col("s") if start is None else start, F.col("e") if end is None else end
    return df.withColumn(name, F.explode(F.sequence(F.floor(s / width).cast("long"), F.floor(F.greatest(s, e) / width).cast("long"))))


def overlap_pairs(a: DataFrame, b: DataFrame, on: list[str], width: float, inclusive: bool = False) -> DataFrame:
    """Pairs of intervals of a(s, e) and b(s2, e2) that overlap; a pair that shares several buckets is kept in the first."""
    left, right = bucketed(a, width), bucketed(b, width, F.col("s2"), F.col("e2"))
    touch = (F.col("s") <= F.col("e2")) & (F.col("e") >= F.col("s2")) if inclusive else (F.col("s") < F.col("e2")) & (F.col("e") > F.col("s2"))
    first = F.floor(F.greatest("s", "s2") / width).cast("long") == F.col("bucket")
    return left.join(right, [*on, "bucket"]).where(touch & first).drop("bucket")


def overlap_seconds(a: DataFrame, b: DataFrame, on: list[str], width: float, shift: float = 0.0) -> DataFrame:
    """on, overlap: seconds that a, moved by shift, and b have in common, pair by pair."""
    moved = a.withColumn("s", F.col("s") + shift).withColumn("e", F.col("e") + shift)
    pairs = overlap_pairs(moved, b, on, width)
    return pairs.groupBy(*on).agg(F.sum(_overlap(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"))).alias("overlap"))


def shift_overlaps(a: DataFrame, b: DataFrame, on: list[str], most: int, hop: float, width: float) -> DataFrame:
    """on, shift (-most to most), overlap: seconds in common for every shift of a by shift * hop, where there are any.

    Times are whole milliseconds. As a is moved along, what an interval of each side have in common rises, stays and falls:
    a sum of four ramps, which begin where one's end passes the other's start or end. Pairs within reach of each
    other meet once, by buckets, and leave four rows whatever the number of shifts; these are summed up by the first shift past
    each ramp's begin, and running sums over the shifts give all overlaps, exactly.
    """
    ms = lambda c: F.floor(F.col(c) * 1000).cast("long").alias(c)
    step, reach = int(hop * 1000), int(most * hop * 1000)
    wide = b.select(*on, ms("s2"), ms("e2")).withColumn("lo", F.col("s2") - reach).withColumn("hi", F.col("e2") + reach)
    cell = width * 1000
    left, right = bucketed(a.select(*on, ms("s"), ms("e")), cell), bucketed(wide, cell, F.col("lo"), F.col("hi"))
    near = (F.col("s") <= F.col("hi")) & (F.col("e") >= F.col("lo")) & (F.floor(F.greatest("s", "lo") / cell).cast("long") == F.col("bucket"))
    pairs = left.join(right, [*on, "bucket"]).where(near)
    ramp = lambda x, y, sign: F.struct((F.col(x) - F.col(y)).alias("begin"), F.lit(sign).alias("sign"))
    ramps = pairs.select(*on, F.explode(F.array(ramp("s2", "e", 1), ramp("s2", "s", -1), ramp("e2", "e", -1), ramp("e2", "s", 1))).alias("ramp")).select(*on, "ramp.*")
    first = F.greatest(F.lit(-most), (F.floor(F.col("begin") / step) + 1).cast("int"))
    begun = ramps.withColumn("shift", first).where(F.col("shift") <= most).groupBy(*on, "shift").agg(F.sum("sign").alias("slope"), F.sum(F.col("sign") * F.col("begin")).alias("base"))
    every = begun.select(*on).distinct().withColumn("shift", F.explode(F.sequence(F.lit(-most), F.lit(most))))
    so_far = Window.partitionBy(*on).orderBy("shift").rowsBetween(Window.unboundedPreceding, 0)
    known = every.join(begun, [*on, "shift"], "left")
    total = F.sum(F.coalesce("slope", F.lit(0))).over(so_far) * F.col("shift") * step - F.sum(F.coalesce("base", F.lit(0))).over(so_far)
    return known.select(*on, "shift", (total / 1000.0).alias("overlap")).where("overlap > 0")


def best_shift(overlaps: DataFrame, on: list[str]) -> DataFrame:
    """The shift of the largest overlap; of equal ones the smallest."""
    best = Window.partitionBy(*on).orderBy(F.desc(F.round("overlap", 6)), "shift")
    return overlaps.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def best_match(a: DataFrame, b: DataFrame, on: list[str], key: list[str], width: float, order: str = "ord2") -> DataFrame:
    """For each interval of a the interval of b that it overlaps most, the first of equal ones; none without overlap.

    An interval without length has no overlap, wherever it lies.
    """
    pairs = overlap_pairs(a, b, on, width).withColumn("overlap", _overlap(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"))).where("overlap > 0")
    best = Window.partitionBy(*key).orderBy(F.desc("overlap"), order)
    return pairs.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def not_touching(a: DataFrame, b: DataFrame, on: list[str], key: list[str], width: float) -> DataFrame:
    """Intervals of a that no interval of b touches, ends included."""
    hit = overlap_pairs(a, b, on, width, inclusive=True).select(*key).distinct()
    return a.join(hit, key, "left_anti")


def uncovered_seconds(spine: DataFrame, b: DataFrame, on: list[str], width: float) -> DataFrame:
    """Seconds t of spine(on, t) that no interval of b(s2, e2) touches, [t, t + 1] with its ends."""
    seconds = spine.withColumn("s", F.col("t").cast("double")).withColumn("e", F.col("t") + 1.0)
    return not_touching(seconds, b, on, [*on, "t"], width).select(*on, "t")


def recorder_groups(edges: DataFrame) -> DataFrame:
    """recorder, root, shift: recorders linked by edges(a, b, shift), with the shift to the smallest of their group.

    Rounds grow with the logarithm of the longest chain, see grouping.connected().
    """
    return grouping.connected(edges).select(F.col("id").alias("recorder"), "root", "shift")

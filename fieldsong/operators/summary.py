"""Summaries that users export: presence and certainty by file, by time bin, by survey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsong.operators.intervals import bins_of


def presence(files: DataFrame, species: DataFrame, detections: DataFrame, file: str = "rec") -> DataFrame:
    """Each file with each species: present and the largest certainty, 0 where there is none.

    species is a short list; files come once.
    """
    top = detections.groupBy(file, "species").agg(F.max("cert").alias("cert"))
    grid = files.select(file).distinct().join(F.broadcast(species.select("species").distinct()), F.lit(True))
    return grid.join(top, [file, "species"], "left").select(file, "species", F.when(F.col("cert").isNotNull(), "Yes").otherwise("No").alias("present"), F.coalesce("cert", F.lit(0)).alias("max_cert"))


def certainty_by_bin(detections: DataFrame, by: list[str], res: float, last: Column | None = None) -> DataFrame:
    """Largest certainty and number of intervals in each bin that any touches; reversed intervals are turned round."""
    turned = detections.withColumn("lo", F.least("s", "e")).withColumn("e", F.greatest("s", "e")).withColumn("s", F.col("lo")).drop("lo")
    return bins_of(turned, res, last).groupBy(*by, "bin").agg(F.round(F.max("cert"), 6).alias("max_cert"), F.count(F.lit(1)).alias("n"))


def discretised(recordings: DataFrame, detections: DataFrame, by: list[str], res: float, duration: str = "duration") -> DataFrame:
    """by, bin, present: 0 or 1 for every bin of each recording."""
    bins = F.ceil(F.col(duration) / res).cast("long")
    spine = recordings.where(F.col(duration) > 0).select(*by, F.explode(F.sequence(F.lit(0).cast("long"), bins - 1)).alias("bin"))
    known = detections.join(recordings.select(*by, duration), by)
    hit = bins_of(known, res, F.ceil(F.col(duration) / res).cast("long") - 1).select(*by, "bin").distinct().withColumn("hit", F.lit(1))
    return spine.join(hit, [*by, "bin"], "left").select(*by, "bin", F.coalesce("hit", F.lit(0)).alias("present"))


def overview(detections: DataFrame, by: list[str], width: float) -> DataFrame:
    """Labels of certainty 0, 100 and between in each bin from floor(start) to floor(end), and the worst one's colour."""
    first, last = F.floor(F.col("s") / width).cast("long"), F.floor(F.col("e") / width).cast("long")
    each = detections.withColumn("bin", F.explode(F.sequence(first, last)))
    n = lambda c: F.count_if(c)
    out = each.groupBy(*by, "bin").agg(n(F.col("cert") == 0).alias("unsure"), n(F.col("cert") == 100).alias("certain"), n((F.col("cert") > 0) & (F.col("cert") < 100)).alias("possible"))
    return out.withColumn("colour", F.when(F.col("unsure") > 0, "red").when(F.col("possible") > 0, "yellow").otherwise("green"))


def file_status(files: DataFrame, detections: DataFrame, file: str = "rec") -> DataFrame:
    """-1 without labels, 0 if any label is uncertain (certainty 0), 1 if any is below 100, else 2."""
    least = detections.groupBy(file).agg(F.min("cert").alias("least"))
    status = F.when(F.col("least").isNull(), -1).when(F.col("least") == 0, 0).when(F.col("least") < 100, 1).otherwise(2)
    return files.select(file).distinct().join(least, file, "left").select(file, status.alias("status"))


def frequency_range(df: DataFrame, by: list[str], low: str, high: str, rate: float) -> DataFrame:
    """f1, f2: least low and median high; f2 is cut to the rate, and is the mean high if it falls under f1."""
    got = df.groupBy(*by).agg(F.min(low).alias("f1"), F.median(high).alias("mid"), F.avg(high).alias("mean"))
    cut = F.when(F.lit(rate) < 2 * F.col("mid") + 50, F.lit(float(rate // 2 - 50))).otherwise(F.col("mid"))
    return got.withColumn("cut", cut).select(*by, "f1", F.when(F.col("cut") < F.col("f1"), F.col("mean")).otherwise(F.col("cut")).alias("f2"))

"""A collection of annotated recordings as tables: counts, code lists, training targets, nodes, cluster edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def segment_counts(files: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """by, n: how many segments each file has; files without any have 0 and are the ones whose annotations are empty."""
    n = segments.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return files.select(*by).distinct().join(n, by, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def typical_lengths(segments: DataFrame, by: list[str]) -> DataFrame:
    """by, n, median: how many segments of a call type there are and their median length."""
    return segments.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.median(F.col("e") - F.col("s")).alias("median"))


def new_segments(candidates: DataFrame, present: DataFrame, by: list[str]) -> DataFrame:
    """Candidates that are not there yet with the very same times."""
    return candidates.join(present.select(*by, "s", "e").distinct(), [*by, "s", "e"], "left_anti")


def protocol_marks(pages: DataFrame, size: float, interval: float, overlap: float) -> DataFrame:
    """pages(file_id, page, duration) with s, e: stretches to be checked; from the second page on they begin after the overlap."""
    first = F.when(F.col("page") > 0, F.lit(float(overlap))).otherwise(0.0)
    n = F.ceil((F.col("duration") - first) / interval).cast("int")
    marks = pages.withColumn("first", first).where(n > 0).withColumn("nth", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("first") + F.col("nth") * F.lit(float(interval))
    return marks.withColumn("s", start).withColumn("e", F.least(F.col("duration"), start + size)).drop("first", "nth")


def windows_over(values: DataFrame, by: list[str], index: str, value: str, width: int, step: int, threshold: float) -> DataFrame:
    """by, win, present: whether the mean over width values from every step-th on is above the threshold; windows are cut at the end."""
    win = F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col(index) - width + 1) / step)).cast("int"), F.floor(F.col(index) / step).cast("int")))
    inside = values.where(F.ceil((F.col(index) - width + 1) / step) <= F.floor(F.col(index) / step)).withColumn("win", win)
    return inside.groupBy(*by, "win").agg((F.avg(value) > threshold).cast("int").alias("present"))


def windows_to_seconds(windows: DataFrame, by: list[str], inc: float, duration: Column) -> DataFrame:
    """by, t: seconds that a present window which starts every inc seconds begins or ends in."""
    start = F.col("win") * F.lit(float(inc))
    last = F.least(F.ceil(start + 1), F.ceil(duration)).cast("long") - 1
    found = windows.where("present = 1").withColumn("a", F.floor(start).cast("long")).withColumn("b", last).where("a <= b")
    return found.select(*by, F.explode(F.sequence("a", "b")).alias("t")).distinct()


def best_nodes(correlations: DataFrame, by: list[str], bands: DataFrame, low: float, high: float, n: int = 10, skip: int = 14) -> DataFrame:
    """by, node, nth: the n nodes with the largest correlation r that are not among the first `skip` and whose band meets [low, high].

    correlations(by, node, r); bands(node, f_lo, f_hi) is a short table. Nodes deeper in the tree come first, so that no node
    stands before what it is made of.
    """
    about = F.broadcast(bands.where((F.col("f_lo") < high) & (F.col("f_hi") > low)))
    ranked = correlations.where(F.col("node") >= skip).join(about.select("node"), "node").withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("r"), "node")))
    level = F.floor(F.log2(F.col("node") + 2))
    return ranked.where(F.col("rank") <= n).withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(level), "rank"))).select(*by, "node", "nth")


def without_negative(nodes: Column, negative: Column) -> Column:
    """Nodes but the negative ones; all of them if none were left."""
    left = F.array_except(nodes, negative)
    return F.when(F.size(left) == 0, nodes).otherwise(left)


def renumbered(nodes: Column, up: bool) -> Column:
    """Node numbers of the same bands in a tree over twice the sample rate (up) or half of it, where upper halves fall out."""
    size = lambda n: F.pow(F.lit(2.0), F.floor(F.log2(n + 1)))  # noqa: E731  nodes in n's level
    place = lambda n: n + 1 - size(n)
    if up:
        return F.transform(nodes, lambda n: (2 * size(n) - 1 + place(n)).cast("int"))
    lower = F.filter(nodes, lambda n: (n > 0) & (place(n) * 2 < size(n)))
    return F.transform(lower, lambda n: (size(n) / 2 - 1 + place(n)).cast("int"))


def y_of(f: Column, least: float, most: float, rows: int) -> Column:
    """A frequency's row in a picture of so many rows; -100 above what is shown."""
    return F.when(f > most, -100.0).otherwise((f - least) * rows / (most - least))


def signal_to_noise(samples: DataFrame, by: list[str], index: str, value: str, signal: int, noise: int, length: int) -> DataFrame:
    """by, snr: decibels of the mean square from `signal` on over that from `noise` on."""
    power = lambda a: F.avg(F.when((F.col(index) >= a) & (F.col(index) < a + length), F.col(value) * F.col(value)))
    return samples.groupBy(*by).agg((10 * F.log10(power(signal) / power(noise))).alias("snr"))


def lagged_products(x: DataFrame, y: DataFrame, by: list[str], index: str, value: str, most: int) -> DataFrame:
    """by, lag (-most to most), cov: mean-free x at an index times y that many places on, over the number of values of x.

    With x for y this is the autocovariance. Values meet by blocks of the index, so that none is sent out once a lag.
    """
    whole = Window.partitionBy(*by)
    free = lambda df: df.select(*by, F.col(index).alias("i"), (F.col(value) - F.avg(value).over(whole)).alias("v"), F.count(F.lit(1)).over(whole).alias("n"))
    width = max(64, 2 * most)
    block = lambda i: F.floor(i / width).cast("long")
    a = free(x).withColumn("block", block(F.col("i")))
    b = free(y).select(*by, F.col("i").alias("j"), F.col("v").alias("w"))
    b = b.withColumn("block", F.explode(F.sequence(block(F.col("j") - most), block(F.col("j") + most))))
    lag = F.col("j") - F.col("i")
    met = a.join(b, [*by, "block"]).where(F.abs(lag) <= most).withColumn("lag", lag.cast("int"))
    return met.groupBy(*by, "lag").agg((F.sum(F.col("v") * F.col("w")) / F.max("n")).alias("cov"))


def best_lag(products: DataFrame, by: list[str]) -> DataFrame:
    """The lag of the largest product; of equal ones the nearest to 0, then the smallest."""
    best = Window.partitionBy(*by).orderBy(F.desc(F.round("cov", 9)), F.abs("lag"), "lag")
    return products.withColumn("nth", F.row_number().over(best)).where("nth = 1").select(*by, "lag")


def rolloff(spectra: DataFrame, by: list[str], index: str, value: str, share: float = 0.85) -> DataFrame:
    """by, bin: the first bin up to which a spectrum holds the share of all its magnitudes."""
    upto = Window.partitionBy(*by).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    sums = spectra.withColumn("upto", F.sum(value).over(upto)).withColumn("total", F.sum(value).over(Window.partitionBy(*by)))
    return sums.where(F.col("upto") >= share * F.col("total")).groupBy(*by).agg(F.min(index).alias("bin"))


def contrast(spectra: DataFrame, by: list[str], band: Column, index: str, value: str, share: float = 0.25) -> DataFrame:
    """by, band, contrast: decibels between the means of a band's largest and smallest values, a share of them each."""
    key = [*by, "band"]
    own = spectra.withColumn("band", band)
    ranked = own.withColumn("up", F.row_number().over(Window.partitionBy(*key).orderBy(value, index))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*key)))
    some = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    low, high = F.avg(F.when(F.col("up") <= some, F.col(value))), F.avg(F.when(F.col("up") > F.col("n") - some, F.col(value)))
    return ranked.groupBy(*key).agg((10 * F.log10((high + 1e-10) / (low + 1e-10))).alias("contrast"))


def with_noise(x: DataFrame, noise: DataFrame, key: list[str], index: str, value: str, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """x with a share of noise(index, noise) added, drawn between low and high for each key by a hash, the same each time."""
    spot = F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key]).cast("binary")), 1, 8), 16, 10).cast("long")
    level = low + (high - low) * (spot / F.lit(2.0**32))
    return x.join(F.broadcast(noise), index).withColumn(value, F.col(value) + level * F.col("noise")).drop("noise")  # noise is one frame


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("int"))


def applied_clusters(segments: DataFrame, clusters: DataFrame, key: str) -> DataFrame:
    """Segments of clusters(key, cluster) with the cluster's name as call type; those of a cluster named null were deleted and go, others stay as they are."""
    named = clusters.select(key, F.col("cluster").alias("new_type"), F.lit(1).alias("known"))
    both = segments.join(named, key, "left").where("known is null or new_type is not null")
    return both.withColumn("calltype", F.coalesce("new_type", "calltype")).drop("new_type", "known")


def moved_to(clusters: DataFrame, chosen: Column, target: Column) -> DataFrame:
    """clusters(.., cluster) after the chosen rows went to cluster target (null: deleted); ids are made compact again, from 0."""
    moved = clusters.withColumn("cluster", F.when(chosen, target).otherwise(F.col("cluster"))).where("cluster is not null")
    ids = moved.select("cluster").distinct().withColumn("id", (F.row_number().over(Window.orderBy("cluster")) - 1).cast("int"))  # a row a cluster
    return moved.join(F.broadcast(ids), "cluster").drop("cluster").withColumnRenamed("id", "cluster")


def free_name(names: DataFrame, prefix: str = "Cluster_") -> DataFrame:
    """name: the first of prefix0, prefix1, ... that names(name) has not."""
    taken = names.select(F.try_to_number(F.regexp_extract("name", f"^{prefix}([0-9]{{1,8}})$", 1), F.lit("99999999")).cast("long").alias("k")).where("k is not null").distinct()
    n = taken.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))).alias("k"))
    return n.join(taken, "k", "left_anti").agg(F.concat(F.lit(prefix), F.min("k").cast("string")).alias("name"))


def recogniser_summary(filters: DataFrame) -> DataFrame:
    """species, least_length, longest, least_frequency, most_frequency, calltypes over all subfilters(species, calltype, time_range, freq_range)."""
    return filters.groupBy("species").agg(
        F.min(F.col("time_range")[0]).alias("least_length"), F.max(F.col("time_range")[1]).alias("longest"), F.min(F.col("freq_range")[0]).alias("least_frequency"),
        F.max(F.col("freq_range")[1]).alias("most_frequency"), F.array_sort(F.collect_set("calltype")).alias("calltypes"),
    )


def predicted_class(scores: list[Column], thresholds: list[float]) -> Column:
    """The class with the largest score if that reaches its threshold, else -1; of equal ones the first."""
    most = F.greatest(*scores) if len(scores) > 1 else scores[0]
    first = F.array_position(F.array(*scores), most) - 1
    cut = F.element_at(F.array(*[F.lit(float(t)) for t in thresholds]), (first + 1).cast("int"))
    return F.when(most >= cut, first).otherwise(-1).cast("int")

"""Reports and reviews: what is exported for surveys, how detections fare in review, and data sets for training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldsong.operators import intervals, summary
from fieldsong.sources.scratch import written

#: A report's segments that one task groups, and the compressed bytes of its later shuffles that one task gets: what a task holds does not grow with the survey.
TASK_SEGMENTS, TASK_BYTES = 100_000, 4 << 20


def time_stamps(segments: DataFrame, started: Column, by: list[str], order: str = "ord") -> DataFrame:
    """by, order, start, end (clock times, seconds whole), overlaps: a report's sheet of time stamps.

    started: the recording's start. overlaps counts an interval's neighbours in time, see overlap_counts.
    """
    counted = intervals.overlap_counts(segments, by, order)
    clock = lambda s: F.date_format(F.timestamp_seconds(F.unix_seconds(started) + F.floor(s)), "HH:mm:ss")
    return counted.select(*by, order, clock(F.col("s")).alias("start"), clock(F.col("e")).alias("end"), "overlaps")


def joined_neighbours(df: DataFrame, by: list[str], order: list[str], gap: float = 3.0) -> DataFrame:
    """Rows in their order, chained while the next one starts less than gap after this one's end; a chain's end is its last row's."""
    w = Window.partitionBy(*by).orderBy(*order)
    starts = F.when(F.col("s") - F.lag("e").over(w) < gap, 0).otherwise(1)
    chained = df.withColumn("new", starts).withColumn("chain", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.struct(*order)
    return chained.groupBy(*by, "chain").agg(F.min_by("s", place).alias("s"), F.max_by("e", place).alias("e"), F.count(F.lit(1)).alias("pieces"))


def review_outcome(detected: DataFrame, reviewed: DataFrame, by: list[str], start: str = "s") -> DataFrame:
    """by, tp, fp, fn: detections matched with reviewed segments that start at the same time."""
    keys = [*by, start]
    a = detected.select(*keys).distinct().withColumn("found", F.lit(1))
    b = reviewed.select(*keys).distinct().withColumn("real", F.lit(1))
    both = a.join(b, keys, "full")
    count = lambda c: F.count_if(c)
    return both.groupBy(*by).agg(
        count(F.col("found").isNotNull() & F.col("real").isNotNull()).alias("tp"),
        count(F.col("real").isNull()).alias("fp"), count(F.col("found").isNull()).alias("fn"),
    )


def corpus_summary(truth: DataFrame, found: DataFrame, by: list[str], keys: list[str]) -> DataFrame:
    """Specificity, recall, precision and accuracy over bins (by, keys, present) of a whole corpus; null on 0/0."""
    both = truth.select(*by, *keys, F.col("present").alias("t")).join(found.select(*by, *keys, F.col("present").alias("f")), [*by, *keys])
    n = lambda t, f: F.count_if((F.col("t") == t) & (F.col("f") == f))
    c = both.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(0, 0).alias("tn"), n(1, 0).alias("fn"))
    share = lambda a, b: F.when(b > 0, a / b)
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(*by, "tp", "fp", "tn", "fn", share(tn, tn + fp).alias("specificity"), share(tp, tp + fn).alias("recall"), share(tp, tp + fp).alias("precision"), share(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def ground_truth(bins: DataFrame, hits: DataFrame, by: list[str]) -> DataFrame:
    """by, bin, present, calltype, quality of bins(by, bin) from hits(by, bin, calltype, quality).

    Of several hits in a bin the one of the largest quality digit is kept, the first call type of equal ones.
    """
    top = hits.groupBy(*by, "bin").agg(F.min_by(F.struct("calltype", "quality"), F.struct((-F.col("quality")).alias("q"), "calltype")).alias("top"))
    return bins.join(top, [*by, "bin"], "left").select(*by, "bin", F.col("top").isNotNull().cast("int").alias("present"), "top.calltype", "top.quality")


def slots(truth: DataFrame, by: list[str], length: int) -> DataFrame:
    """Bins counted anew within slots of so many."""
    return truth.withColumn("slot", F.expr(f"bin div {int(length)}")).withColumn("bin", F.col("bin") % length)


def matched_rows(sheet: DataFrame, recordings: DataFrame, on: list[str], longest: float, back: Column) -> DataFrame:
    """Rows of sheet(on, end_s) with the recording(on, start_s) that their end lies in; the segment begins back seconds before it.

    A row's end lies after the recording's start and at most longest seconds behind it. Buckets of that length
    key the join, so that rows of a day never meet all its recordings. Recordings are many and often made by a
    generator, whose rows Spark doesn't foresee: the join is by sorting, never by sending one side whole to all tasks.
    """
    own = F.floor(F.col("end_s") / longest).cast("long")
    left = sheet.withColumn("bucket", F.explode(F.array(own - 1, own)))
    right = recordings.withColumn("bucket", F.floor(F.col("start_s") / longest).cast("long")).hint("merge")
    inside = (F.col("start_s") < F.col("end_s")) & (F.col("end_s") <= F.col("start_s") + longest)
    return left.join(right, [*on, "bucket"]).where(inside).withColumn("s", F.col("end_s") - F.col("start_s") - back).withColumn("e", F.col("end_s") - F.col("start_s")).drop("bucket")


def clip_spans(df: DataFrame, length: float = 10.0) -> DataFrame:
    """Spans of so many seconds: around the middle of shorter intervals, at both ends of the others; `part` counts them."""
    mid = (F.col("s") + F.col("e")) / 2
    one = lambda s: F.struct(F.greatest(s, F.lit(0.0)).alias("cs"), (F.greatest(s, F.lit(0.0)) + length).alias("ce"))
    spans = F.when(F.col("e") - F.col("s") < length, F.array(one(mid - length / 2))).otherwise(F.array(one(F.col("s")), one(F.col("e") - length)))
    return df.select("*", F.posexplode(spans).alias("part", "span")).select(*df.columns, "part", "span.cs", "span.ce")


def image_counts(segments: DataFrame, by: list[str], length: float, hop: float) -> DataFrame:
    """by, images: frames of so many seconds that a class's segments give; a shorter segment gives one."""
    d = F.col("e") - F.col("s")
    return segments.groupBy(*by).agg(F.sum(F.when(d < length, 1).otherwise(F.ceil((d - length) / hop + 1))).cast("long").alias("images"))


def hop_for(images: Column, target: int, hop: float) -> Column:
    """A class's hop between frames: as it is if there are enough images, else shorter in proportion, a tenth at least."""
    return F.when(images >= target, F.lit(hop)).otherwise(F.greatest(F.lit(hop / 10), hop * images / target))


def class_list(scores: DataFrame, by: list[str], classes: list[str], top: int, least: float) -> DataFrame:
    """by, found: classes whose best `top` scores sum to more than least * top (fewer scores count as 0)."""
    best = [F.aggregate(F.slice(F.sort_array(F.collect_list(c), asc=False), 1, top), F.lit(0.0), lambda a, x: a + x.cast("double")) / top for c in classes]
    got = scores.groupBy(*by).agg(*[b.alias(c) for b, c in zip(best, classes)])
    return got.select(*by, F.array_join(F.filter(F.array(*[F.when(F.col(c) > least, F.lit(c)) for c in classes]), lambda x: x.isNotNull()), ",").alias("found"))


def bat_passes(files: DataFrame, night: Column, long: Column, short: Column) -> DataFrame:
    """Passes numbered from 0 within a night, with L, S or "L,S"."""
    kind = F.concat_ws(",", F.when(long, F.lit("L")), F.when(short, F.lit("S")))
    seen = files.withColumn("night", night).withColumn("kind", kind).where("kind != ''")
    return seen.withColumn("tally", F.row_number().over(Window.partitionBy("night").orderBy("ts", "file")) - 1).select("night", "tally", "file", "ts", "kind")


def survey_line(files: DataFrame, by: list[str], day: Column, categories: list[str]) -> DataFrame:
    """One row a survey: first and last night, nights, and files of each category."""
    return files.withColumn("day", day).groupBy(*by).agg(F.min("day").alias("first_night"), F.max("day").alias("last_night"), F.countDistinct("day").alias("nights"), *[F.count_if(F.col("category") == c).alias(f"n_{k}") for k, c in enumerate(categories)])


def pair_recordings(a: DataFrame, b: DataFrame, on: list[str], share: float, longest: float) -> DataFrame:
    """Each recording of a(on, file, s, e) with the first of b(on, file2, s2, e2) that overlaps more than a share of it."""
    bucket = lambda s, e: F.explode(F.sequence(F.floor(s / longest).cast("long"), F.floor(e / longest).cast("long")))
    left, right = a.withColumn("bucket", bucket(F.col("s"), F.col("e"))), b.withColumn("bucket", bucket(F.col("s2"), F.col("e2")))
    common = F.least("e", "e2") - F.greatest("s", "s2")
    pairs = left.join(right, [*on, "bucket"]).where((F.col("e") > F.col("s")) & (common > share * (F.col("e") - F.col("s"))))
    return pairs.groupBy(*on, "file").agg(F.min(F.struct("s2", "file2")).alias("first")).select(*on, "file", F.col("first.file2").alias("file2"))


def energy_crossings(df: DataFrame, by: list[str], order: str, value: str, reach: int, factor: float) -> DataFrame:
    """Runs of rows whose value, summed over reach rows on either side, lies above its mean by factor deviations, as [s, e)."""
    near, whole = Window.partitionBy(*by).orderBy(order).rowsBetween(-reach, reach), Window.partitionBy(*by)
    curve = df.withColumn("curve", F.sum(value).over(near))
    flagged = curve.withColumn("on", (F.col("curve") > F.avg("curve").over(whole) + factor * F.stddev_pop("curve").over(whole)).cast("int"))
    return intervals.run_lengths(flagged, by, order, "on")


def median_filtered(df: DataFrame, by: list[str], order: str, value: str, width: int) -> DataFrame:
    """df with `median` of the rows from width before to width - 1 after; fewer at the edges."""
    near = Window.partitionBy(*by).orderBy(order).rowsBetween(-width, width - 1)
    return df.withColumn("median", F.median(value).over(near)) if width == 0 else df.withColumn("near", F.array_sort(F.collect_list(value).over(near))).withColumn(
        "median", (F.element_at("near", F.floor((F.size("near") + 1) / 2).cast("int")) + F.element_at("near", F.ceil((F.size("near") + 1) / 2).cast("int"))) / 2
    ).drop("near")


def waveform_features(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Least, largest, peak and root mean square of a waveform, and where they are."""
    x, place = F.col(value), F.col(order)
    return df.groupBy(*by).agg(
        F.min(x).alias("least"), F.min_by(place, F.struct(x, place)).alias("at_least"), F.max(x).alias("largest"),
        F.min_by(place, F.struct((-x).alias("x"), place)).alias("at_largest"), F.max(F.abs(x)).alias("peak"), F.sqrt(F.avg(x * x)).alias("rms"),
    )


def training_split(df: DataFrame, key: str, share: float) -> DataFrame:
    """df with `held_out`: about a share of it, by hash, the same rows each time."""
    spot = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 6), 16, 10).cast("long")
    return df.withColumn("held_out", spot < int(share * 16**6))


def workbook(segments: DataFrame, files: DataFrame, res: float, any_sound: str = "Any sound") -> dict[str, DataFrame]:
    """A report's three sheets over a whole tree of annotations, for every species and for any sound, as tables.

    segments(file_id, seg_id, s, e, f_lo, f_hi, labels) and files(file_id, started, duration). stamps: file_id, species, start, end
    (clock times), f_lo, f_hi, certainty. presence: file_id, species, present, max_cert, for every file and species. bins: file_id,
    species, bin, max_cert, for bins of res seconds. A segment counts once for any sound, with its largest certainty.
    Segments are counted, and dealt by themselves to as many tasks as hold them.
    """
    spark = segments.sparkSession
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(TASK_BYTES))
    dealt = segments.select("file_id", "seg_id", "s", "e", "f_lo", "f_hi", "labels").repartition(segments.count() // TASK_SEGMENTS + 1, "file_id", "seg_id")
    each = dealt.select("file_id", "seg_id", "s", "e", "f_lo", "f_hi", F.explode("labels").alias("x"))
    named = each.groupBy("file_id", "seg_id", "s", "e", "f_lo", "f_hi", F.col("x.species").alias("species")).agg(F.max("x.certainty").alias("cert"))
    whole = named.groupBy("file_id", "seg_id", "s", "e", "f_lo", "f_hi").agg(F.max("cert").alias("cert")).withColumn("species", F.lit(any_sound))
    rows = written(named.unionByName(whole))
    clock = lambda c: F.date_format(F.timestamp_seconds(F.unix_seconds("started") + F.floor(c)), "HH:mm:ss")
    known = rows.join(files, "file_id")
    stamps = known.select("file_id", "species", "seg_id", clock("s").alias("start"), clock("e").alias("end"), "f_lo", "f_hi", F.col("cert").alias("certainty"))
    species = rows.select("species").distinct()
    top = summary.presence(files, species, rows, "file_id")
    last = F.ceil(F.col("duration") / res).cast("long") - 1
    return {"stamps": stamps, "presence": top, "bins": summary.certainty_by_bin(known, ["file_id", "species"], res, last)}

"""Queries on recordings read by ranges, rebuilt nodes, templates, prediction, wind, groups, ridges and pitch classes, and their SQL.

Vectors stand for frames too: 64 consecutive ones are a recording of four pages of sixteen frames.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldsong.functions.nodes import node_bands
from fieldsong.operators import contours as contour_operators
from fieldsong.operators import detect, distributions, evaluate, grouping, learning, pictures, prediction, recognise, shapes, signal, survey, synthesis, templates, wavelets, wind
from fieldsong.plans.adapters import DET, SPECTRA, detections, table
from fieldsong.plans.signal_queries import _PAIRS, _SIG, FS, _pairs, _signals
from fieldsong.sources import audio, chunks
from fieldsong.sources.scratch import new_folder

HAAR = wavelets.daubechies(1)
PAGE_FRAMES = 16
STEP = 0.25


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "label", x.alias("x"))


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_id, page, frame, mags: each vector's sizes as a frame."""
    page = F.expr("cast(vec_id div 16 % 4 as int)")
    return _vectors(spark, sf_dir).select(F.expr("cast(vec_id div 64 as string)").alias("file_id"), page.alias("page"), F.expr("cast(vec_id % 16 as int)").alias("frame"), F.transform("x", F.abs).alias("mags"))


def _templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two templates: the first three frames of all, and two further on."""
    v = _vectors(spark, sf_dir).where("vec_id < 3 or vec_id in (10, 11)").select(F.when(F.col("vec_id") < 3, "three").otherwise("two").alias("template"), "vec_id", F.transform("x", F.abs).alias("x"))
    return v.groupBy("template").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "x"))), lambda p: p["x"])).alias("mags"))


def wav_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recordings saved as stereo-free 24-bit files, and read page by page from their places in the files."""
    rows = _signals(spark, sf_dir, 100_000.0).select(F.concat("file_id", F.lit(".wav")).alias("name"), audio.wav_column(F.col("samples"), FS, 24).alias("content"))
    folder = new_folder(spark)
    audio.saved(rows, folder).count()
    found = audio.ranged_pages(audio.files(spark, folder), least_seconds=0.0, length=300)
    each = found.select(F.regexp_extract("file_id", r"([^/]+)\.wav$", 1).alias("file_id"), "page", "start_sample", "fs", F.explode("samples").alias("x"))
    return each.groupBy("file_id", "page", "start_sample", "fs").agg(F.count(F.lit(1)).alias("n"), F.sum("x").cast("long").alias("total"), F.min("x").cast("long").alias("low"), F.max("x").cast("long").alias("high"))


def node_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both halves of each recording by the shortest wavelet, a row a sample."""
    got = synthesis.node_signals(_signals(spark, sf_dir), [1, 2], HAAR)
    return got.select("file_id", "node", F.posexplode("samples").alias("i", "x")).withColumn("x", F.round("x", 6))


def band_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds in which the band of any of four nodes is loud, the recordings read at 64 Hz."""
    return synthesis.band_calls(_signals(spark, sf_dir).withColumn("fs", F.lit(64)), [8, 17, 22, 40], wavelets.daubechies(4), 0.3, 0.1, (3.2, 24.0))


def template_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.correlated(_pictures(spark, sf_dir), _templates(spark, sf_dir)).withColumn("score", F.round("score", 6))


def template_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.matches(_pictures(spark, sf_dir), _templates(spark, sf_dir), STEP, 0.4, PAGE_FRAMES)


def _series(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = _vectors(spark, sf_dir)
    return v.select(F.col("vec_id").alias("key"), "x"), v.where("vec_id < 2").select(F.col("vec_id").cast("string").alias("template"), F.slice("x", 1, 16).alias("x"))


def warped_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first sixteen elements of two vectors warp onto each vector most cheaply, and what it costs."""
    found = templates.warped_matches(*_series(spark, sf_dir), 0.9)
    return found.select("template", "key", F.round("cost", 6).alias("cost"))


def warping_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.warping_counts(*_series(spark, sf_dir), 0.05)


def prediction_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's prediction coefficients of order 4, a row a coefficient."""
    got = prediction.prediction_coefficients(_vectors(spark, sf_dir), ["vec_id"], "x", 4)
    return got.select("vec_id", F.posexplode("a").alias("k", "a"), "error").select("vec_id", "k", F.round("a", 6).alias("a"), F.round("error", 6).alias("error"))


def formants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prediction.formants(_signals(spark, sf_dir), 128)


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return wavelets.node_energies(_signals(spark, sf_dir), [0, 20, *range(31, 63)], 0.004, wavelets.daubechies(2)), node_bands(spark, 5, FS)


def wind_under_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wind under a node of the fourth and one of the fifth level, by squares, taken half as far again from the calm windows."""
    return wind.predicted(*_tree(spark, sf_dir), [20, 45], over=1.5)


def quantile_wind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the lower fifth of the nodes."""
    return wind.predicted(*_tree(spark, sf_dir), [20, 45], how="quantile", lift=0.4)


def spanning_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of single linkage within each recording, with each recording's sum of all."""
    links = grouping.spanning_forest(_pairs(spark, sf_dir)).withColumn("rec", F.expr("a div 16"))
    return links.groupBy("rec").agg(F.count(F.lit(1)).alias("links"), F.round(F.sum("d"), 4).alias("total"))


def agglomerated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a recording that links of at most 7.6 chain together."""
    forest = grouping.spanning_forest(_pairs(spark, sf_dir))
    return grouping.cut_tree(forest, _vectors(spark, sf_dir).select(F.col("vec_id").alias("id")), height=7.6)


def class_radii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each recording the distance that a tenth of its pairs do not exceed, and of each vector whether it is that near to the others."""
    p = _pairs(spark, sf_dir).withColumn("label", F.expr("a div 16"))
    both = p.select(F.col("a").alias("id"), "label", "d").unionByName(p.select(F.col("b").alias("id"), "label", "d"))
    radii = grouping.class_radius(p, "label")
    near = grouping.nearest_class(both, radii.withColumn("radius", F.col("radius") * 1.2))
    return near.withColumn("rec", F.expr("id div 16")).join(radii.withColumnRenamed("label", "rec"), "rec").select("id", F.col("label").alias("class"), F.round("radius", 8).alias("radius"))


def density_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean shift of the vectors' first two elements, spread over six places by the number."""
    x, y = F.get("x", F.lit(0)) + F.col("vec_id") % 3, F.get("x", F.lit(1)) - F.col("vec_id") % 2
    points = _vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), F.array(x, y).alias("x"))
    return grouping.mean_shift(points, 0.3, still=0.02)


def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors that stand for the others of their recording."""
    p = _pairs(spark, sf_dir).select(F.col("a").alias("i"), F.col("b").alias("k"), (-F.col("d")).alias("s"))
    own = _vectors(spark, sf_dir).select(F.col("vec_id").alias("i"), F.col("vec_id").alias("k"), F.lit(-9.0).alias("s"))
    return grouping.exemplars(p.unionByName(p.select(F.col("k").alias("i"), F.col("i").alias("k"), "s")).unionByName(own), rounds=30)


def ridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the best ridge of each recording weighs: the sum of its candidates' weights less its steps over the bins."""
    candidates = pictures.ridge_candidates(_pictures(spark, sf_dir), 6)
    path = pictures.ridges(candidates, pictures.Cost(0.05)).join(candidates, ["file_id", "page", "frame", "bin"])
    line = Window.partitionBy("file_id").orderBy("page", "frame")
    each = path.withColumn("loss", F.coalesce(0.05 * F.abs(F.col("bin") - F.lag("bin").over(line)), F.lit(0.0)))
    return each.groupBy("file_id").agg(F.count(F.lit(1)).alias("frames"), F.round(F.sum(F.col("w") - F.col("loss")), 5).alias("total"))


def steady_ridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ridges found once with a cost on steps, and again with costs that follow the first ones' medians and spreads."""
    candidates = pictures.ridge_candidates(_pictures(spark, sf_dir), 6)
    first = pictures.ridges(candidates, pictures.Cost(0.05))
    return pictures.ridges(candidates, pictures.Cost(0.5, 0.5, **pictures.ridge_spread(first, PAGE_FRAMES)))


def reassigned_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pictures.reassigned(_signals(spark, sf_dir), 64, 32)


def constant_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pictures.constant_q(_signals(spark, sf_dir), 12, 500.0)
    return got.select("file_id", "band", F.round("hz", 3).alias("hz"), F.posexplode("mags").alias("k", "m"), "step").select("file_id", "band", "hz", (F.col("k") * F.col("step")).alias("t"), "m")


def chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch classes of the frames, read as half a spectrum of 128 samples at 8 kHz."""
    got = pictures.chroma(_pictures(spark, sf_dir), 8000, 128)
    return got.select("file_id", "page", "frame", F.posexplode("chroma").alias("pitch", "share")).withColumn("share", F.round("share", 6))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second of each recording at 64 Hz is a vector; those of labels under 3 are calls."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.expr("cast(vec_id div 16 as string)").alias("file_id"), F.expr("cast(vec_id % 16 as int)").alias("win"), (F.col("label") < 3).cast("int").alias("present"))


def recogniser_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recogniser made from all recordings, from samples to the counts of each setting."""
    pages = _signals(spark, sf_dir).withColumn("fs", F.lit(64))
    got = recognise.train(pages, _calls(spark, sf_dir), node_bands(spark, 5, 64), 2.0, 30.0, [0.2, 0.5, 0.8], [0.05, 0.2], wavelets.daubechies(4))
    return got.withColumn("nodes", F.array_join(F.col("nodes").cast("array<string>"), ","))


def recogniser_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows with large first elements as a recogniser's, against the calls, as they are and as calls of two seconds at least."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 5 <> 4")
    hit = F.coalesce((F.get("embedding", F.lit(0)) > -0.03).cast("int"), F.lit(0))
    windows = e.select(F.expr("cast(vec_id div 16 as string)").alias("file_id"), F.expr("cast(vec_id % 16 as int)").alias("win"), hit.alias("present"))
    rates = ["recall", "precision", "specificity"]
    return recognise.recogniser_report(windows, _calls(spark, sf_dir), 2.0, 1.0).withColumns({c: F.round(c, 6) for c in rates})


def frame_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as segments of a recording of two minutes, made long enough for frames of five seconds."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(1190)).alias("at"), F.pmod("o_custkey", F.lit(100)).alias("n"))
    spans = o.select("o_orderkey", (F.col("at") / 10).alias("s"), F.least(F.lit(120.0), F.col("at") / 10 + F.col("n") / 10).alias("e"))
    return recognise.frame_spans(spans, 5.0, F.lit(120.0)).select("o_orderkey", F.round("s", 6).alias("s"), F.round("e", 6).alias("e"))


def verified_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as segments of 64 frames, half a second apart, whose sizes are a network's probabilities."""
    segments = _vectors(spark, sf_dir).select("vec_id", F.lit(50).alias("certainty"))
    frames = _vectors(spark, sf_dir).select("vec_id", F.posexplode(F.transform("x", lambda v: F.abs(v) * 4)).alias("frame", "probability"))
    return recognise.verified(segments, frames, ["vec_id"], "frame", F.lit(0.2), F.lit(0.35), 3.0, 0.5)


def adjusted_mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("found", F.floor("value").cast("int") % 5 + F.when(F.col("event_type") == "click", 2).otherwise(0))
    return evaluate.adjusted_mutual_information(ev, "event_type", "found").select(F.round("ami", 6).alias("ami"))


def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the pieces of ten minutes that orders, read as recordings named by their time, are split into."""
    at = F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.col("o_orderkey") * 977), "yyyyMMdd_HHmmss")
    name = F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("note"), F.col("o_orderkey"), F.lit(".wav"))).otherwise(F.concat(F.lit("REC_"), at, F.lit(".wav")))
    rec = table(spark, sf_dir, "orders").select(name.alias("name"), F.pmod("o_orderkey", F.lit(3000)).cast("double").alias("seconds"))
    return chunks.piece_names(rec, 600)


def contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many contour cells each frame has, with its entropy and mean frequency."""
    pages = _signals(spark, sf_dir)
    cells = contour_operators.contours(pages, 64, 32).groupBy("file_id", "page", "frame").agg(F.count(F.lit(1)).alias("cells"))
    return contour_operators.change_features(pages, 64, 32).join(cells, ["file_id", "page", "frame"], "left").fillna(0, ["cells"])


def pitch_goodness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contour_operators.pitch_goodness(_signals(spark, sf_dir), 64, 32)


def equal_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each recording as loud as people hear it."""
    got = contour_operators.equal_loudness(_signals(spark, sf_dir)).select("file_id", F.posexplode("samples").alias("i", "x"))
    return got.withColumn("x", F.round("x", 6) + 0.0)


def tonal_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pictures.tonal_centroids(pictures.chroma(_pictures(spark, sf_dir), 8000, 128))
    return got.select("file_id", "page", "frame", F.posexplode("tonal").alias("axis", "at")).withColumn("at", F.round("at", 6) + 0.0)


def network_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of five columns, three apart, of each page of sixteen frames: the sum of their pixels and the first one."""
    got = pictures.network_frames(_pictures(spark, sf_dir), 64, 16, 1.25, 0.75, 5, (3.0, 30.0))
    return got.select("file_id", "page", "image", F.round(F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v), 4).alias("total"), F.round(F.get("pixels", F.lit(40)).cast("double"), 5).alias("pixel"))


def best_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best level of each vector's elements, read as the coefficients of a tree of six levels."""
    c = _vectors(spark, sf_dir).select("vec_id", F.posexplode("x").alias("node", "c")).where("node < 63")
    return wavelets.best_level(wavelets.node_costs(c, ["vec_id", "node"], "entropy"), ["vec_id"])


def any_sound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands out of the recordings, each squared so that something does, a page four seconds long."""
    frames = _pictures(spark, sf_dir).withColumn("mags", F.transform("mags", lambda m: m * m * m))
    found = signal.clipped_segments(frames, STEP, 1.2, 6, 0.5)
    return detect.cleaned(found, ["file_id", "page"], 0.5, 0.5, 2.0)


def best_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _signals(spark, sf_dir).withColumn("fs", F.lit(1280))
    return detect.best_segments(signal.spectrogram(pages, 64, 32), pages, 32 / 1280, 128, 0.5, 1.5, 0.9, 4.0)


def detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each recording the detectors of four names find."""
    pages = _signals(spark, sf_dir).withColumn("fs", F.lit(1280))
    frames = signal.spectrogram(pages, 64, 32)
    how = {"Envelope": {"threshold": 0.4}, "Amplitude": {"share": 0.5}, "Power": {"threshold": 0.2}, "Voice": {"width": 128, "fs": 1280, "threshold": 0.9, "lowest": 4.0}}
    parts = [detect.by_name(k, frames, pages, 32 / 1280, **v).withColumn("detector", F.lit(k)) for k, v in how.items()]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("file_id", "detector").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("e") - F.col("s")), 6).alias("seconds"))


def workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three sheets over all recorders' days, one below the other: how many rows and what certainty each species has in them."""
    det = detections(spark, sf_dir).withColumn("file_id", F.concat_ws("_", "rec", F.floor(F.col("s") / 86400)))
    day = F.floor(F.col("s") / 86400) * 86400
    none = F.lit(None).cast("string")
    label = F.struct("species", F.col("cert").cast("double").alias("certainty"), none.alias("calltype"), none.alias("filter"))
    segments = det.select("file_id", F.col("ord").alias("seg_id"), (F.col("s") - day).alias("s"), (F.col("e") - day).alias("e"), F.lit(100).alias("f_lo"), F.lit(4000).alias("f_hi"), F.array(label).alias("labels"))
    files = det.select("file_id", F.timestamp_seconds(day).alias("started")).distinct().withColumn("duration", F.lit(86400.0))
    sheets = survey.workbook(segments, files, 3600.0)
    count = lambda name, cert, more: sheets[name].groupBy("species").agg(F.count(F.lit(1)).alias("rows"), F.sum(cert).cast("double").alias("certainty"), more.alias("first")).withColumn("sheet", F.lit(name))
    return count("stamps", "certainty", F.min("start")).unionByName(count("presence", "max_cert", F.max(F.when(F.col("present") == "Yes", F.col("file_id"))))).unionByName(count("bins", "max_cert", F.max("bin").cast("string")))


def pitch_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of the fundamental of the recordings, each vector's first half taken twice over so that there is one."""
    twice = _signals(spark, sf_dir).withColumn("samples", F.flatten(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.array_repeat(F.slice("samples", i * 64 + 1, 32), 2)).cast("array<array<array<double>>>"))))
    got = shapes.pitch_marks(signal.pitch(twice, 48), FS, 12, 48, 32, 0.0, 8000.0)
    return got.select("file_id", "mark", F.posexplode(F.arrays_zip("columns", "rows")).alias("k", "p")).select("file_id", "mark", "k", "p.columns", "p.rows")


BIRD = [35, 36, 39, 40, 43, 44, 45]


def _node_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of the elements as energies of as many nodes; sixteen vectors are a segment, four of them a recording."""
    e = _vectors(spark, sf_dir).select("vec_id", F.posexplode("x").alias("node", "x"))
    return e.select(F.expr("cast(vec_id div 64 as string)").alias("file_id"), F.expr("cast(vec_id div 16 % 4 as int)").alias("seg_id"), F.expr("cast(vec_id % 16 as int)").alias("win"), "node", (F.col("x") * F.col("x")).alias("energy"))


def learning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments' shares of the bird's nodes, whether its rule takes them, and whether a review that kept two in three did."""
    energies = _node_table(spark, sf_dir)
    segments = energies.select("file_id", "seg_id").distinct().withColumn("s", F.col("seg_id") * 20.0).withColumn("e", F.col("s") + 15)
    reviewed = segments.where("(cast(file_id as int) + seg_id) % 3 <> 0").select("file_id", "s", "e")
    rows = learning.learning_rows(learning.node_shares(energies, ["file_id", "seg_id"], BIRD), segments, reviewed, ["file_id", "seg_id"])
    return rows.select("file_id", "seg_id", F.array_join(F.transform("shares", lambda v: F.format_number(v, 6)), ",").alias("shares"), learning.rule(F.col("shares")).alias("taken"), "target")


def energies_with_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 32 nodes' energies of every window of the recordings' first segments, with its truth by its label."""
    energies = _node_table(spark, sf_dir).withColumn("win", F.col("seg_id") * 16 + F.col("win"))
    truth = table(spark, sf_dir, "embeddings").select(F.expr("cast(vec_id div 64 as string)").alias("file_id"), F.expr("vec_id % 64").alias("bin"), (F.col("label") < 3).cast("int").alias("present"))
    got = learning.energies_with_truth(energies, truth, 32)
    return got.select("file_id", "win", F.round(F.aggregate("energies", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.round(F.get("energies", F.lit(31)), 8).alias("last"), "present")


def block_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's elements shrunk and cut by the mean size of their block of eight, of every block but each fourth."""
    c = _vectors(spark, sf_dir).select("vec_id", F.posexplode("x").alias("i", "c"))
    t = c.groupBy("vec_id", F.floor(F.col("i") / 8).alias("block")).agg(F.avg(F.abs("c")).alias("t")).where("block % 4 <> 3")
    soft, hard = (learning.block_thresholded(c, t, ["vec_id"], 8, k).withColumnRenamed("c", k) for k in ("soft", "hard"))
    return soft.join(hard, ["vec_id", "i"]).select("vec_id", "i", F.round("soft", 6) + 0.0, F.round("hard", 6) + 0.0).toDF("vec_id", "i", "soft", "hard")


def windy_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wind of the recordings, read at 1024 Hz and made louder by their number, so that some are too noisy."""
    pages = _signals(spark, sf_dir, 100.0).withColumn("fs", F.lit(1024)).withColumn("samples", F.transform("samples", lambda v: v * (F.col("file_id").cast("double") % 5)))
    return learning.windy(pages)


def sound_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four distributions of each vector's elements, read as a piece of sound: the sum of each bin."""
    pages = _vectors(spark, sf_dir).select(F.col("vec_id").cast("string").alias("file_id"), F.lit(0).alias("page"), F.lit(FS).alias("fs"), F.col("x").alias("samples"))
    cells = distributions.totals(pages, list(distributions.KINDS)).select("file_id", "kind", F.posexplode("cells").alias("bin", "m"))
    return cells.select("file_id", "kind", "bin", F.round("m", 6).alias("total"))


def speed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three copies of each recording at other speeds: their rates and root mean squares."""
    got = learning.speed_changed(_signals(spark, sf_dir), 3, width=128)
    return got.select("file_id", "page", F.round("rate", 9).alias("rate"), F.size("samples").alias("n"), F.sqrt(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v) / F.size("samples")).alias("rms"))


_VEC = "v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS x FROM embeddings WHERE embedding IS NOT NULL)"
_PIC = f"""{SPECTRA}, pc AS (SELECT vec_id, vec_id // 64 AS rec, vec_id % 64 AS pos, k, abs(x) AS m FROM sp)"""
SQL = {
    "wav_ranges": f"""WITH {_SIG}, w AS (SELECT file_id, i, CAST(greatest(-8388608, least(8388607, trunc(x * 100000.0::DOUBLE))) AS BIGINT) AS x FROM sig)
SELECT file_id, CAST(i // 300 AS INT) AS page, i // 300 * 300 AS start_sample, 16000::INT AS fs, count(*) AS n, CAST(sum(x) AS BIGINT) AS total, min(x) AS low, max(x) AS high FROM w GROUP BY file_id, i // 300""",
    "node_signals": f"""WITH {_SIG}, e AS (SELECT file_id, i, lag(x, 1) OVER o AS a, lag(x, 2) OVER o AS b, lag(x, 3) OVER o AS c, first_value(x) OVER o AS x0, nth_value(x, 2) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS x1 FROM sig WINDOW o AS (PARTITION BY file_id ORDER BY i)),
m AS (SELECT file_id, i, coalesce(a, x0) AS a, CASE WHEN i = 0 THEN x1 ELSE coalesce(b, x0) END AS b, CASE WHEN i = 0 THEN NULL WHEN i = 1 THEN x1 ELSE coalesce(c, x0) END AS c FROM e)
SELECT file_id, 1::INT AS node, CAST(i AS INT) AS i, round((a + b + coalesce(b + c, 0)) / 2, 6) AS x FROM m
UNION ALL SELECT file_id, 2::INT, CAST(i AS INT), round((b - a - coalesce(c - b, 0)) / 2, 6) FROM m""",
    "template_scores": f"""WITH {_PIC}, t AS (SELECT 'three' AS template, vec_id AS r, k, m FROM pc WHERE vec_id < 3 UNION ALL SELECT 'two', vec_id - 10, k, m FROM pc WHERE vec_id IN (10, 11)),
n AS (SELECT template, max(r) + 1 AS rows FROM t GROUP BY template), ends AS (SELECT rec, max(pos) AS last FROM pc GROUP BY rec),
places AS (SELECT DISTINCT template, rows, pc.rec, pos FROM pc JOIN ends USING (rec), n WHERE pos + rows - 1 <= last),
c AS (SELECT p.template, p.rec, p.pos, corr(pc.m, t.m) AS score FROM places p JOIN pc ON pc.rec = p.rec AND pc.pos >= p.pos AND pc.pos < p.pos + p.rows JOIN t ON t.template = p.template AND t.r = pc.pos - p.pos AND t.k = pc.k GROUP BY ALL)
SELECT template, CAST(rec AS VARCHAR) AS file_id, CAST(pos // 16 AS INT) AS page, CAST(pos % 16 AS INT) AS frame, round(score, 6) AS score FROM c""",
    "warped_matches": f"""WITH RECURSIVE {_VEC}, t AS (SELECT CAST(vec_id AS VARCHAR) AS template, x[1:16] AS a FROM v WHERE vec_id < 2), p AS (SELECT template, vec_id AS key, a, x AS b FROM t, v),
w AS (SELECT template, key, a, b, 1 AS d, list_transform(range(17), lambda i: CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END) AS p1, list_transform(range(17), lambda i: CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END) AS p2, 'inf'::DOUBLE AS best FROM p
UNION ALL SELECT template, key, a, b, d, now, p1, least(best, CASE WHEN d > 16 THEN now[17] ELSE 'inf'::DOUBLE END) FROM (
SELECT template, key, a, b, d + 1 AS d, p1, best, list_transform(range(17), lambda i: CASE WHEN d + 1 - i > len(b) OR d + 1 - i < 0 THEN 'inf'::DOUBLE WHEN i = 0 THEN 0.0::DOUBLE WHEN d + 1 = i THEN 'inf'::DOUBLE
  ELSE abs(a[i] - b[d + 1 - i]) + least(p1[i], p1[i + 1], p2[i]) END) AS now FROM w WHERE d < len(b) + 16))
SELECT template, key, round(min(best), 6) AS cost FROM w GROUP BY template, key HAVING min(best) <= 0.9""",
    "warping_counts": f"""WITH {_VEC}, t AS (SELECT CAST(vec_id AS VARCHAR) AS template, unnest(x[1:16]) AS a FROM v WHERE vec_id < 2), l AS (SELECT vec_id, list_min(x) AS low, list_max(x) AS high FROM v),
b AS (SELECT template, vec_id, sum(greatest(low - a, a - high, 0)) AS bound FROM t, l GROUP BY template, vec_id) SELECT template, count(*) AS pairs, count(*) FILTER (bound > 0.05) AS pruned FROM b GROUP BY template""",
    "prediction_coefficients": f"""WITH {_VEC}, r AS (SELECT vec_id, list_transform(range(5), lambda k: list_sum(list_transform(range(len(x)), lambda i: x[i + 1] * x[(i + k) % len(x) + 1]))) AS r FROM v WHERE len(x) > 0),
s1 AS (SELECT vec_id, r, [1.0::DOUBLE] AS a0, r[1] AS e0, -r[2] / r[1] AS k1 FROM r),
s2 AS (SELECT vec_id, r, [1.0::DOUBLE, k1] AS a1, e0 * (1 - k1 * k1) AS e1 FROM s1),
s3 AS (SELECT *, -(r[3] + a1[2] * r[2]) / e1 AS k2 FROM s2),
s4 AS (SELECT vec_id, r, [1.0::DOUBLE, a1[2] + k2 * a1[2], k2] AS a2, e1 * (1 - k2 * k2) AS e2 FROM s3),
s5 AS (SELECT *, -(r[4] + a2[2] * r[3] + a2[3] * r[2]) / e2 AS k3 FROM s4),
s6 AS (SELECT vec_id, r, [1.0::DOUBLE, a2[2] + k3 * a2[3], a2[3] + k3 * a2[2], k3] AS a3, e2 * (1 - k3 * k3) AS e3 FROM s5),
s7 AS (SELECT *, -(r[5] + a3[2] * r[4] + a3[3] * r[3] + a3[4] * r[2]) / e3 AS k4 FROM s6),
s8 AS (SELECT vec_id, [1.0::DOUBLE, a3[2] + k4 * a3[4], a3[3] + k4 * a3[3], a3[4] + k4 * a3[2], k4] AS a, e3 * (1 - k4 * k4) AS error FROM s7)
SELECT vec_id, CAST(unnest(range(5)) AS INT) AS k, round(unnest(a), 6) AS a, round(error, 6) AS error FROM s8""",
    "agglomerated": f"""WITH RECURSIVE {SPECTRA}, {_PAIRS}, l AS (SELECT a, b FROM pr WHERE d <= 7.6 UNION SELECT b, a FROM pr WHERE d <= 7.6),
w AS (SELECT vec_id AS id, vec_id AS root FROM embeddings WHERE embedding IS NOT NULL UNION SELECT w.id, l.b FROM w JOIN l ON l.a = w.root) SELECT id, min(root) AS cluster FROM w GROUP BY id""",
    "class_radii": f"""WITH {SPECTRA}, {_PAIRS}, q AS (SELECT a // 16 AS rec, quantile_cont(d, 0.1) FILTER (d > 0) AS radius FROM pr GROUP BY a // 16),
e AS (SELECT id, avg(d) AS mean FROM (SELECT a AS id, d FROM pr UNION ALL SELECT b, d FROM pr) GROUP BY id)
SELECT id, CASE WHEN mean <= coalesce(radius, 0) * 1.2::DOUBLE THEN rec END AS class, round(coalesce(radius, 0), 8) AS radius FROM e JOIN q ON rec = id // 16""",
    "recogniser_report": """WITH w AS (SELECT CAST(vec_id // 16 AS VARCHAR) AS file_id, CAST(vec_id % 16 AS INT) AS win, CASE WHEN vec_id % 5 = 4 THEN 0 ELSE CAST(coalesce(embedding[1] > CAST(-0.03 AS DOUBLE), false) AS INT) END AS raw, CAST(label < 3 AS INT) AS real FROM embeddings),
r AS (SELECT file_id, win, win - row_number() OVER (PARTITION BY file_id ORDER BY win) AS run FROM w WHERE raw = 1), sg AS (SELECT file_id, min(win) AS s, max(win) + 1 AS e FROM r GROUP BY file_id, run),
i AS (SELECT *, sum(CASE WHEN s - le <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY s) AS island FROM (SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS le FROM sg)),
j AS (SELECT file_id, min(s) AS s, max(e) AS e FROM i GROUP BY file_id, island HAVING max(e) - min(s) >= 2),
x AS (SELECT 'windows' AS stage, real, raw AS hit FROM w UNION ALL SELECT 'calls', real, CASE WHEN EXISTS (SELECT 1 FROM j WHERE j.file_id = w.file_id AND w.win >= j.s AND w.win < j.e) THEN 1 ELSE 0 END FROM w),
c AS (SELECT stage, count(*) FILTER (real = 1 AND hit = 1) AS tp, count(*) FILTER (real = 0 AND hit = 1) AS fp, count(*) FILTER (real = 0 AND hit = 0) AS tn, count(*) FILTER (real = 1 AND hit = 0) AS fn FROM x GROUP BY stage)
SELECT *, round(tp / (tp + fn), 6) AS recall, round(tp / (tp + fp), 6) AS precision, round(tn / (tn + fp), 6) AS specificity FROM c""",
    "frame_spans": """WITH o AS (SELECT o_orderkey, o_orderkey % 1190 / 10.0::DOUBLE AS s, least(120.0::DOUBLE, o_orderkey % 1190 / 10.0::DOUBLE + o_custkey % 100 / 10.0::DOUBLE) AS e FROM orders),
m AS (SELECT *, (5 - (e - s)) / 2 + 0.005::DOUBLE AS more FROM o)
SELECT o_orderkey, round(CASE WHEN e - s > 5 THEN s WHEN s - more < 0 THEN 0 WHEN e + more > 120 THEN 114.99::DOUBLE ELSE s - more END, 6) AS s, round(CASE WHEN e - s > 5 THEN e WHEN s - more < 0 THEN 5.01::DOUBLE WHEN e + more > 120 THEN 120 ELSE e + more END, 6) AS e FROM m""",
    "verified_segments": f"""WITH {SPECTRA}, f AS (SELECT vec_id, k, abs(x) * 4 AS p FROM sp), t AS (SELECT vec_id, k, p, th FROM f CROSS JOIN (VALUES (0.2::DOUBLE), (0.35::DOUBLE)) h(th)),
r AS (SELECT vec_id, th, k - row_number() OVER (PARTITION BY vec_id, th ORDER BY k) AS run FROM t WHERE p >= th), n AS (SELECT vec_id, th, max(c) * 0.5::DOUBLE AS len FROM (SELECT vec_id, th, run, count(*) AS c FROM r GROUP BY ALL) GROUP BY vec_id, th)
SELECT vec_id, CAST(max(CASE WHEN th > 0.3 THEN 90 ELSE 50 END) AS INT) AS certainty FROM n WHERE len >= 3 GROUP BY vec_id""",
    "adjusted_mutual_information": """WITH x AS (SELECT event_type AS t, CAST(floor(value) AS INT) % 5 + CASE WHEN event_type = 'click' THEN 2 ELSE 0 END AS c, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
a AS (SELECT t, sum(n) AS a FROM x GROUP BY t), b AS (SELECT c, sum(n) AS b FROM x GROUP BY c), z AS (SELECT sum(n) AS z FROM x),
e AS (SELECT a, b, z, CAST(unnest(range(CAST(greatest(1, a + b - z) AS BIGINT), CAST(least(a, b) AS BIGINT) + 1)) AS DOUBLE) AS n FROM a, b, z),
m AS (SELECT sum(n / z * ln(z * n / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(z - a + 1) + lgamma(z - b + 1) - lgamma(z + 1) - lgamma(n + 1) - lgamma(a - n + 1) - lgamma(b - n + 1) - lgamma(z - a - b + n + 1))) AS emi FROM e),
i AS (SELECT sum(n / z * ln(z * n / (a * b))) AS mi FROM x JOIN a USING (t) JOIN b USING (c), z), h AS (SELECT (SELECT -sum(a / z * ln(a / z)) FROM a, z) AS ht, (SELECT -sum(b / z * ln(b / z)) FROM b, z) AS hc)
SELECT round((mi - emi) / ((ht + hc) / 2 - emi), 6) AS ami FROM m, i, h""",
    "split_names": """WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 3000 AS DOUBLE) AS seconds, make_timestamp((1600000000 + o_orderkey * 977) * 1000000) AS t FROM orders),
n AS (SELECT *, CASE WHEN o_orderkey % 5 = 0 THEN 'note' || o_orderkey || '.wav' ELSE 'REC_' || strftime(t, '%Y%m%d_%H%M%S') || '.wav' END AS name, unnest(range(CAST(ceil(seconds / 600) AS BIGINT))) AS piece FROM o)
SELECT name, CAST(piece AS INT) AS piece, CASE WHEN o_orderkey % 5 = 0 THEN 'note' || o_orderkey || '_' || piece || '.wav' ELSE 'REC_' || strftime(t + to_seconds(piece * 600), '%Y%m%d_%H%M%S') || '.wav' END AS piece_name FROM n""",
    "equal_loudness": f"""WITH RECURSIVE {_SIG}, v AS (SELECT file_id, max(n) AS n, list(x ORDER BY i) AS x FROM sig GROUP BY file_id),
w AS (SELECT file_id, n, x, 0 AS i, [0.0::DOUBLE, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0] AS u, [0.0::DOUBLE, 0, 0, 0, 0, 0, 0, 0, 0, 0] AS y, [0.0::DOUBLE, 0] AS z, 0.0::DOUBLE AS last FROM v
UNION ALL SELECT file_id, n, x, i + 1, u, list_prepend(now, y[1:9]), list_prepend(out, z[1:1]), out FROM (
SELECT *, 0.9592::DOUBLE * now - 1.9184::DOUBLE * y[1] + 0.9592::DOUBLE * y[2] + 1.9167::DOUBLE * z[1] - 0.9201::DOUBLE * z[2] AS out FROM (
SELECT file_id, n, x, i, list_prepend(x[i + 1], u[1:10]) AS u, y, z, 0.4492::DOUBLE * x[i + 1] - 0.1435::DOUBLE * u[1] - 0.2278::DOUBLE * u[2] - 0.0142::DOUBLE * u[3] + 0.0408::DOUBLE * u[4] - 0.1240::DOUBLE * u[5] + 0.0410::DOUBLE * u[6]
  + 0.1048::DOUBLE * u[7] - 0.0186::DOUBLE * u[8] - 0.0319::DOUBLE * u[9] + 0.0054::DOUBLE * u[10] + 0.6282::DOUBLE * y[1] - 0.2966::DOUBLE * y[2] + 0.3726::DOUBLE * y[3] - 0.0021::DOUBLE * y[4] + 0.4203::DOUBLE * y[5]
  - 0.2220::DOUBLE * y[6] - 0.0061::DOUBLE * y[7] - 0.0675::DOUBLE * y[8] - 0.0578::DOUBLE * y[9] - 0.0322::DOUBLE * y[10] AS now FROM w WHERE i < n)))
SELECT file_id, CAST(i - 1 AS INT) AS i, round(last, 6) + 0.0::DOUBLE AS x FROM w WHERE i > 0""",
    "tonal_centroids": f"""WITH {_PIC}, g AS (SELECT rec, pos, CAST(((floor(12 * log2(k * 8000.0::DOUBLE / 128 / 261.6255653::DOUBLE) + 0.5) % 12) + 12) % 12 AS INT) AS pitch, m FROM pc WHERE k > 0),
e AS (SELECT rec, pos, pitch, sum(m * m) AS e FROM g GROUP BY ALL), s AS (SELECT rec, pos, pitch, e / sum(e) OVER (PARTITION BY rec, pos) AS s FROM e), t(axis, turn, radius) AS (VALUES (0, 7 / 6, 1), (2, 3 / 2, 1), (4, 2 / 3, 0.5))
SELECT CAST(rec AS VARCHAR) AS file_id, CAST(pos // 16 AS INT) AS page, CAST(pos % 16 AS INT) AS frame, CAST(axis AS INT) AS axis, round(sum(s * radius * sin(pitch * (turn * pi()))), 6) + 0.0::DOUBLE AS "at" FROM s, t GROUP BY rec, pos, axis
UNION ALL SELECT CAST(rec AS VARCHAR), CAST(pos // 16 AS INT), CAST(pos % 16 AS INT), CAST(axis + 1 AS INT), round(sum(s * radius * cos(pitch * (turn * pi()))), 6) + 0.0::DOUBLE FROM s, t GROUP BY rec, pos, axis""",
    "network_frames": f"""WITH {_PIC}, f AS (SELECT rec, pos // 16 AS page, pos % 16 AS frame, k, CAST(CASE WHEN k < 6 OR k >= 60 THEN 0 ELSE m END AS FLOAT) AS m FROM pc), n AS (SELECT rec, page, max(frame) + 1 AS n FROM f GROUP BY rec, page),
i AS (SELECT rec, page, n, unnest(range(CAST(floor((n * 0.25 - 1.25) / 0.75) + 1 AS BIGINT))) AS image FROM n), w AS (SELECT *, image * 3 AS start FROM i WHERE image * 3 + 5 <= n),
c AS (SELECT w.rec, w.page, w.image, f.frame - start AS c, k, m, max(m) OVER (PARTITION BY w.rec, w.page, w.image) AS top FROM w JOIN f ON f.rec = w.rec AND f.page = w.page AND f.frame >= start AND f.frame < start + 5)
SELECT CAST(rec AS VARCHAR) AS file_id, CAST(page AS INT) AS page, CAST(image AS INT) AS image, round(sum(CAST(CASE WHEN top > 0 THEN CAST(m AS DOUBLE) / top ELSE 0 END AS FLOAT)::DOUBLE), 4) AS total, round(max(CAST(CASE WHEN top > 0 THEN CAST(m AS DOUBLE) / top ELSE 0 END AS FLOAT)::DOUBLE) FILTER (c = 0 AND k = 23), 5) AS pixel FROM c GROUP BY rec, page, image""",
    "best_level": f"""WITH {SPECTRA}, c AS (SELECT vec_id, CAST(floor(log2(k + 1)) AS INT) AS level, min(CASE WHEN x <> 0 THEN -(x * x) * ln(x * x) ELSE 0 END) AS least FROM sp WHERE k < 63 GROUP BY ALL),
l AS (SELECT *, lag(least) OVER (PARTITION BY vec_id ORDER BY level) AS before FROM c) SELECT vec_id, coalesce(min(level) FILTER (least >= before), max(level)) AS level FROM l WHERE level > 0 GROUP BY vec_id""",
    "workbook": f"""WITH {DET}, d AS (SELECT *, CAST(floor(s / 86400) AS BIGINT) AS day, rec || '_' || CAST(floor(s / 86400) AS BIGINT) AS file_id FROM det), u AS (SELECT ord, file_id, day, s, e, species, cert FROM d UNION ALL SELECT ord, file_id, day, s, e, 'Any sound', cert FROM d),
b AS (SELECT species, file_id, unnest(range(CAST(floor((s - day * 86400) / 3600) AS BIGINT), CAST(least(23, greatest(ceil((e - day * 86400) / 3600) - 1, floor((s - day * 86400) / 3600))) AS BIGINT) + 1)) AS bin, cert FROM u),
bm AS (SELECT species, file_id, bin, max(cert) AS cert FROM b GROUP BY ALL), fm AS (SELECT species, file_id, max(cert) AS cert FROM u GROUP BY ALL), nf AS (SELECT count(DISTINCT file_id) AS n FROM d)
SELECT 'stamps' AS sheet, species, count(*) AS rows, CAST(sum(cert) AS DOUBLE) AS certainty, min(strftime(make_timestamp(CAST(floor(s) * 1000000 AS BIGINT)), '%H:%M:%S')) AS first FROM u GROUP BY species
UNION ALL SELECT 'presence', species, max(n), CAST(sum(cert) AS DOUBLE), max(file_id) FROM fm, nf GROUP BY species
UNION ALL SELECT 'bins', species, count(*), CAST(sum(cert) AS DOUBLE), CAST(max(bin) AS VARCHAR) FROM bm GROUP BY species""",
    "learning_rows": f"""WITH {SPECTRA}, m AS (SELECT vec_id // 64 AS f, vec_id // 16 % 4 AS seg_id, k, avg(x * x) AS e FROM sp WHERE k IN (35, 36, 39, 40, 43, 44, 45) GROUP BY ALL),
h AS (SELECT f, seg_id, k, e / sum(e) OVER (PARTITION BY f, seg_id) AS s FROM m), g AS (SELECT f, seg_id, string_agg(printf('%.6f', s), ',' ORDER BY k) AS shares, max(s) FILTER (k = 35) AS a, max(s) FILTER (k = 36) AS b, max(s) FILTER (k = 43) AS c, max(s) FILTER (k = 44) AS d FROM h GROUP BY f, seg_id)
SELECT CAST(f AS VARCHAR) AS file_id, CAST(seg_id AS INT) AS seg_id, shares, ((a > 0.2 OR b > 0.2) AND (c > 0.2 OR d > 0.2)) OR a > 0.4 OR c > 0.3 AS taken, CAST((f + seg_id) % 3 <> 0 AS INT) AS target FROM g""",
    "energies_with_truth": f"""WITH {SPECTRA} SELECT CAST(vec_id // 64 AS VARCHAR) AS file_id, CAST(vec_id % 64 AS INT) AS win, round(sum(x * x) FILTER (k BETWEEN 1 AND 32), 6) AS total, round(max(x * x) FILTER (k = 32), 8) AS "last", CAST(max(label) < 3 AS INT) AS present FROM sp GROUP BY vec_id""",
    "block_thresholds": f"""WITH {SPECTRA}, t AS (SELECT vec_id, k, x, CASE WHEN k // 8 % 4 = 3 THEN 0 ELSE avg(abs(x)) OVER (PARTITION BY vec_id, k // 8) END AS t FROM sp)
SELECT vec_id, CAST(k AS INT) AS i, round(sign(x) * greatest(abs(x) - t, 0), 6) + 0.0::DOUBLE AS soft, round(CASE WHEN abs(x) < t THEN 0 ELSE x END, 6) + 0.0::DOUBLE AS hard FROM t""",
    "ridges": f"""WITH RECURSIVE {_PIC}, u AS (SELECT *, lag(m) OVER o AS below, lead(m) OVER o AS above FROM pc WINDOW o AS (PARTITION BY vec_id ORDER BY k)),
c AS (SELECT rec, pos, k AS bin, ln(m) AS w FROM u WHERE m > 0 AND (below IS NULL OR m > below) AND (above IS NULL OR m >= above) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY m DESC, k) <= 6),
f AS (SELECT *, dense_rank() OVER (PARTITION BY rec ORDER BY pos) AS step FROM c),
p AS (SELECT rec, step, bin, w AS total FROM f WHERE step = 1 UNION ALL SELECT f.rec, f.step, f.bin, max(p.total + f.w - 0.05::DOUBLE * abs(f.bin - p.bin)) FROM p JOIN f ON f.rec = p.rec AND f.step = p.step + 1 GROUP BY f.rec, f.step, f.bin),
z AS (SELECT rec, max(step) AS last FROM f GROUP BY rec)
SELECT CAST(rec AS VARCHAR) AS file_id, max(last) AS frames, round(max(total), 5) AS total FROM p JOIN z USING (rec) WHERE step = last GROUP BY rec""",
    "chroma": f"""WITH {_PIC}, g AS (SELECT rec, pos, CAST(((floor(12 * log2(k * 8000.0::DOUBLE / 128 / 261.6255653::DOUBLE) + 0.5) % 12) + 12) % 12 AS INT) AS pitch, m FROM pc WHERE k > 0),
e AS (SELECT rec, pos, pitch, sum(m * m) AS e FROM g GROUP BY ALL), full_ AS (SELECT f.rec, f.pos, p.pitch, coalesce(e.e, 0) AS e FROM (SELECT DISTINCT rec, pos FROM pc) f CROSS JOIN (SELECT CAST(unnest(range(12)) AS INT) AS pitch) p LEFT JOIN e ON e.rec = f.rec AND e.pos = f.pos AND e.pitch = p.pitch)
SELECT CAST(rec AS VARCHAR) AS file_id, CAST(pos // 16 AS INT) AS page, CAST(pos % 16 AS INT) AS frame, pitch, round(CASE WHEN max(e) OVER w > 0 THEN e / max(e) OVER w ELSE 0 END, 6) AS share FROM full_ WINDOW w AS (PARTITION BY rec, pos)""",
}
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

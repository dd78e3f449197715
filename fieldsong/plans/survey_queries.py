"""Queries for reports, reviews and training sets over the driver's tables as detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsong.functions import units
from fieldsong.operators import detect, intervals, summary, survey
from fieldsong.plans.adapters import DET, LABELLED, SPECTRA, detections, labelled, spectra, table
from fieldsong.sources import annotations

DAY = 86400


def _day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of a recorder's day, in seconds from its midnight."""
    det = detections(spark, sf_dir).withColumn("day", F.floor(F.col("s") / DAY).cast("long"))
    return det.withColumn("length", F.col("e") - F.col("s")).withColumn("s", F.col("s") - F.col("day") * DAY).withColumn("e", F.col("s") + F.col("length"))


def report_time_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock times and overlaps of each recorder's detections; recordings start at midnight."""
    det = _day(spark, sf_dir).where("species = 'click'")
    return survey.time_stamps(det, F.timestamp_seconds(F.col("day") * DAY), ["rec", "day"]).select("rec", "day", "ord", "start", "end", "overlaps")


def neighbours_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = survey.joined_neighbours(_day(spark, sf_dir), ["rec", "day"], ["s", "ord"], 600.0)
    return got.select("rec", "day", F.round("s", 4).alias("s"), F.round("e", 4).alias("e"), "pieces")


def review_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections of certainty 50 and more, held against those that are not 50, as if reviewed."""
    det = detections(spark, sf_dir)
    return survey.review_outcome(det.where("cert >= 50"), det.where("cert != 50"), ["species"])


def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases found where views are, by hours of a day and recorder."""
    bins = lambda name: intervals.bins_of(_day(spark, sf_dir).where(F.col("species") == name), 3600.0, F.lit(23)).select("rec", "bin").distinct().withColumn("hit", F.lit(1))
    every = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec")).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))))
    flag = lambda name: every.join(bins(name), ["rec", "bin"], "left").select("rec", "bin", F.coalesce("hit", F.lit(0)).alias("present"))
    got = survey.corpus_summary(flag("view"), flag("purchase"), ["rec"], ["bin"])
    return got.select("rec", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in ("specificity", "recall", "precision", "accuracy")])


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call type and quality of each recorder's hours of the day, with slots of six hours."""
    det = _day(spark, sf_dir)
    hits = intervals.bins_of(det, 3600.0, F.lit(23)).select("rec", "bin", F.col("species").alias("calltype"), (F.col("ord") % 5).cast("int").alias("quality"))
    every = det.select("rec").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))))
    return survey.slots(survey.ground_truth(every, hits, ["rec"]), ["rec"], 6)


def _sheet_rows(det: DataFrame) -> DataFrame:
    sheet = det.select("rec", "day", "ord", F.col("s").alias("end_s"))
    starts = det.select("rec", "day").distinct().withColumn("start_s", F.explode(F.sequence(F.lit(0), F.lit(DAY - 900), F.lit(900)).cast("array<double>")))
    back = F.when(F.col("ord") % 2 == 0, 40.0).otherwise(20.0)
    got = survey.matched_rows(sheet, starts, ["rec", "day"], 900.0, back)
    return got.select("ord", "start_s", F.round("s", 4).alias("s"), F.round("e", 4).alias("e"))


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of a survey's sheet, matched with recordings that begin every quarter of an hour."""
    return _sheet_rows(_day(spark, sf_dir))


def clip_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of four hours of each detection."""
    got = survey.clip_spans(_day(spark, sf_dir).select("ord", "s", "e"), 14400.0)
    return got.select("ord", "part", F.round("cs", 4).alias("cs"), F.round("ce", 4).alias("ce"))


def image_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of an hour, ten minutes apart, and the hop that would bring a species to 200,000 of them."""
    got = survey.image_counts(detections(spark, sf_dir), ["species"], 3600.0, 600.0)
    return got.select("species", "images", F.round(survey.hop_for(F.col("images"), 200_000, 600.0), 6).alias("hop"))


def class_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of four frames each, by their best four scores."""
    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 8").alias("file"), *[F.abs(F.col("embedding")[k].cast("double")).alias(f"c{k}") for k in range(3)])
    return survey.class_list(e, ["file"], ["c0", "c1", "c2"], 4, 0.15)


def bat_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and purchases as passes of two kinds of bats; a night ends at noon."""
    ev = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("file"), "ts").agg(F.count_if(F.col("event_type") == "click").alias("l"), F.count_if(F.col("event_type") == "purchase").alias("s"))
    night = F.date_format(F.col("ts").cast("timestamp") - F.expr("INTERVAL 12 HOURS"), "yyyyMMdd")
    got = survey.bat_passes(ev, night, F.col("l") > 0, F.col("s") > 0)
    return got.select("night", F.col("tally").cast("long").alias("tally"), "file", "kind")


def survey_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").withColumn("category", F.col("event_type"))
    return survey.survey_line(ev, ["user_id"], F.date_format("ts", "yyyyMMdd"), ["click", "error", "purchase", "signup", "view"])


def paired_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each view with the first purchase of the same day's recorders (by tens) that covers over a fifth of it."""
    det = _day(spark, sf_dir).withColumn("site", F.expr("rec div 10"))
    a = det.where("species = 'view'").select("site", "day", F.col("ord").alias("file"), "s", "e")
    b = det.where("species = 'purchase'").select("site", "day", F.col("ord").alias("file2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return survey.pair_recordings(a, b, ["site", "day"], 0.2, 20000.0).select("file", "file2")


def energy_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spectra(spark, sf_dir).withColumn("energy", F.col("x") * F.col("x"))
    return survey.energy_crossings(e, ["vec_id"], "k", "energy", 2, 1.0).select("vec_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))


def median_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.median_filtered(spectra(spark, sf_dir), ["vec_id"], "k", "x", 3).select("vec_id", "k", F.round("median", 6).alias("median"))


def waveform_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = survey.waveform_features(spectra(spark, sf_dir), ["vec_id"], "k", "x")
    return got.select("vec_id", "at_least", "at_largest", *[F.round(c, 6).alias(c) for c in ("least", "largest", "peak", "rms")])


def training_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survey.training_split(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 0.1)


def recording_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, largest, mean, median and summed length of detections by species."""
    d = detections(spark, sf_dir).withColumn("d", F.col("e") - F.col("s"))
    return d.groupBy("species").agg(*[F.round(f("d"), 3).alias(n) for n, f in (("least", F.min), ("largest", F.max), ("mean", F.avg), ("median", F.median), ("total", F.sum))])


def excel_time_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest certainty of each recorder and species in each hour of the day."""
    return summary.certainty_by_bin(_day(spark, sf_dir), ["rec", "species"], 3600.0, F.lit(23)).select("rec", "species", "bin", "max_cert")


def label_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species of a recorder's day that are certain, and those that are not, as text."""
    lab = labelled(spark, sf_dir)
    names = lambda f: F.array_join(F.transform(F.filter("labels", f), lambda x: x["species"]), "; ")
    return lab.select("rec", "day", names(lambda x: x["certainty"] == 100).alias("certain"), names(lambda x: x["certainty"] < 100).alias("unsure"))


def species_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species detected, those asked for, and any sound."""
    asked = spark.createDataFrame([("Any sound",), ("view",), ("kiwi",)], "species string")
    return detections(spark, sf_dir).select("species").distinct().union(asked).distinct()


def done_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorders of both halves of the month, and those of the first half only, as resumed runs tell them apart."""
    det = _day(spark, sf_dir)
    early = det.where("day < 19737").select(F.col("rec").alias("path")).distinct()
    log = det.where("day >= 19737").select(F.col("rec").alias("path"), F.lit("Any sound").alias("species"), F.lit("wv").alias("settings")).distinct()
    done = annotations.not_done(early, log, "Any sound", "wv")
    again = early.join(done, "path", "left_anti")
    return again.withColumn("state", F.lit("again")).unionByName(done.withColumn("state", F.lit("done"))).withColumnRenamed("path", "rec")


def file_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times read back from file names of two styles, and the 12-hour clock of each."""
    ev = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    style = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyyMMdd_HHmmss")).otherwise(F.date_format("ts", "ddMMyy_HHmmss"))
    at = units.recorded_at(F.concat(F.lit("REC_"), style, F.lit(".wav")))
    return ev.select("event_id", F.unix_seconds(at).alias("at"), units.am_pm(at).alias("clock"), units.clock(F.unix_millis(at) % 7_200_000).alias("minutes"))


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", units.file_safe(F.col("p_brand")).alias("safe"), units.clean_species(F.col("p_name")).alias("clean"), units.round_half_away(F.col("p_retailprice") - 1000).cast("long").alias("rounded"))


def certainties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.abs(F.col("embedding")[0].cast("double")) * 4
    return table(spark, sf_dir, "embeddings").select("vec_id", units.certainty_of(p, 0.2, 0.6).alias("certainty"))


def batch_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recognisers of two rates over all signals, from samples to segments."""
    from fieldsong.plans.signal_queries import _signals

    filters = spark.createDataFrame(
        [("a", "one", 16000, "x", 0.3, [3, 5], [0.002, 0.02, 0.0, 0.004]), ("b", "two", 8000, "y", 0.8, [1, 6], [0.001, 0.05, 0.0, 0.002])],
        "filter_id string, species string, sample_rate int, calltype string, thr double, nodes array<int>, time_range array<double>",
    )
    return detect.batch(_signals(spark, sf_dir), filters, 0.002)


_DAY = f"""{DET}, dd AS (SELECT ord, rec, species, cert, day, s - day * 86400 AS s, s - day * 86400 + (e - s) AS e FROM (SELECT *, CAST(floor(s / 86400) AS BIGINT) AS day FROM det))"""
_HOURS = "unnest(range(greatest(0, CAST(floor(s / 3600) AS BIGINT)), least(24, CAST(ceil(e / 3600) AS BIGINT))))"
_CLOCK = "strftime(make_timestamp(CAST((day * 86400 + floor({0})) * 1000000 AS BIGINT)), '%H:%M:%S')"

SQL: dict[str, str] = {
    "report_time_stamps": f"""WITH {_DAY}, p AS (SELECT *, row_number() OVER (PARTITION BY rec, day ORDER BY s, ord) AS pos FROM dd WHERE species = 'click'),
b AS (SELECT a.rec, a.day, a.pos, a.pos - 1 - coalesce(max(CASE WHEN NOT (b.e > a.s) THEN b.pos END), 0) AS n FROM p a LEFT JOIN p b ON a.rec = b.rec AND a.day = b.day AND b.pos < a.pos GROUP BY a.rec, a.day, a.pos),
f AS (SELECT a.rec, a.day, a.pos, coalesce(min(CASE WHEN NOT (b.s < a.e) THEN b.pos END) - a.pos - 1, count(b.pos)) AS n FROM p a LEFT JOIN p b ON a.rec = b.rec AND a.day = b.day AND b.pos > a.pos GROUP BY a.rec, a.day, a.pos)
SELECT p.rec, p.day, ord, {_CLOCK.format('s')} AS start, {_CLOCK.format('e')} AS "end", b.n + f.n AS overlaps FROM p JOIN b USING (rec, day, pos) JOIN f USING (rec, day, pos)""",
    "neighbours_joined": f"""WITH {_DAY}, n AS (SELECT *, CASE WHEN s - lag(e) OVER w < 600 THEN 0 ELSE 1 END AS fresh FROM dd WINDOW w AS (PARTITION BY rec, day ORDER BY s, ord)),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY rec, day ORDER BY s, ord ROWS UNBOUNDED PRECEDING) AS chain FROM n)
SELECT rec, day, round(arg_min(s, {{'s': s, 'o': ord}}), 4) AS s, round(arg_max(e, {{'s': s, 'o': ord}}), 4) AS e, count(*) AS pieces FROM c GROUP BY rec, day, chain""",
    "review_outcome": f"""WITH {DET}, a AS (SELECT DISTINCT species, s FROM det WHERE cert >= 50), b AS (SELECT DISTINCT species, s FROM det WHERE cert <> 50)
SELECT species, count(*) FILTER (a.s IS NOT NULL AND b.s IS NOT NULL) AS tp, count(*) FILTER (b.s IS NULL) AS fp, count(*) FILTER (a.s IS NULL) AS fn FROM a FULL JOIN b USING (species, s) GROUP BY species""",
    "corpus_summary": f"""WITH {_DAY}, h AS (SELECT DISTINCT rec, species, {_HOURS} AS bin FROM dd WHERE species IN ('view', 'purchase')),
g AS (SELECT rec, bin FROM (SELECT DISTINCT rec FROM dd) CROSS JOIN (SELECT unnest(range(24)) AS bin)),
x AS (SELECT rec, bin, max(CASE WHEN species = 'view' THEN 1 ELSE 0 END) AS t, max(CASE WHEN species = 'purchase' THEN 1 ELSE 0 END) AS f FROM g LEFT JOIN h USING (rec, bin) GROUP BY ALL),
c AS (SELECT rec, count(*) FILTER (t = 1 AND f = 1) AS tp, count(*) FILTER (t = 0 AND f = 1) AS fp, count(*) FILTER (t = 0 AND f = 0) AS tn, count(*) FILTER (t = 1 AND f = 0) AS fn FROM x GROUP BY rec)
SELECT *, round(tn / nullif(CAST(tn + fp AS DOUBLE), 0), 6) AS specificity, round(tp / nullif(CAST(tp + fn AS DOUBLE), 0), 6) AS recall, round(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 6) AS precision,
  round((tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE), 6) AS accuracy FROM c""",
    "ground_truth": f"""WITH {_DAY}, h AS (SELECT rec, {_HOURS} AS bin, species AS calltype, CAST(ord % 5 AS INT) AS quality FROM dd),
t AS (SELECT rec, bin, calltype, quality FROM h QUALIFY row_number() OVER (PARTITION BY rec, bin ORDER BY quality DESC, calltype) = 1),
g AS (SELECT rec, bin FROM (SELECT DISTINCT rec FROM dd) CROSS JOIN (SELECT unnest(range(24)) AS bin))
SELECT rec, bin % 6 AS bin, CAST(calltype IS NOT NULL AS INT) AS present, calltype, quality, bin // 6 AS slot FROM g LEFT JOIN t USING (rec, bin)""",
    "sheet_rows": f"""WITH {_DAY}, r AS (SELECT *, (ceil(s / 900) - 1) * 900 AS start_s FROM dd WHERE s > 0)
SELECT ord, start_s, round(s - start_s - CASE WHEN ord % 2 = 0 THEN 40 ELSE 20 END, 4) AS s, round(s - start_s, 4) AS e FROM r""",
    "clip_spans": f"""WITH {_DAY}, c AS (SELECT ord, 0::INT AS part, CASE WHEN e - s < 14400 THEN greatest(0, (s + e) / 2 - 7200) ELSE greatest(s, 0) END AS cs FROM dd
UNION ALL SELECT ord, 1, greatest(0, e - 14400) FROM dd WHERE e - s >= 14400) SELECT ord, part, round(cs, 4) AS cs, round(cs + 14400, 4) AS ce FROM c""",
    "image_counts": f"""WITH {DET}, i AS (SELECT species, CAST(sum(CASE WHEN e - s < 3600 THEN 1 ELSE ceil((e - s - 3600) / 600 + 1) END) AS BIGINT) AS images FROM det GROUP BY species)
SELECT species, images, round(CASE WHEN images >= 200000 THEN 600.0::DOUBLE ELSE greatest(60.0::DOUBLE, 600.0::DOUBLE * images / 200000) END, 6) AS hop FROM i""",
    "class_list": f"""WITH {SPECTRA}, r AS (SELECT vec_id // 8 AS file, k, abs(x) AS v FROM sp WHERE k < 3 QUALIFY row_number() OVER (PARTITION BY vec_id // 8, k ORDER BY abs(x) DESC) <= 4),
t AS (SELECT file, k, sum(v) / 4 AS m FROM r GROUP BY file, k) SELECT file, coalesce(string_agg('c' || k, ',' ORDER BY k) FILTER (m > 0.15), '') AS found FROM t GROUP BY file""",
    "bat_passes": """WITH f AS (SELECT user_id AS file, ts, count(*) FILTER (event_type = 'click') AS l, count(*) FILTER (event_type = 'purchase') AS s FROM events GROUP BY user_id, ts),
k AS (SELECT *, strftime(ts - INTERVAL 12 HOUR, '%Y%m%d') AS night, concat_ws(',', CASE WHEN l > 0 THEN 'L' END, CASE WHEN s > 0 THEN 'S' END) AS kind FROM f WHERE l + s > 0)
SELECT night, row_number() OVER (PARTITION BY night ORDER BY ts, file) - 1 AS tally, file, kind FROM k""",
    "survey_line": """SELECT user_id, min(strftime(ts, '%Y%m%d')) AS first_night, max(strftime(ts, '%Y%m%d')) AS last_night, count(DISTINCT strftime(ts, '%Y%m%d')) AS nights,
count(*) FILTER (event_type = 'click') AS n_0, count(*) FILTER (event_type = 'error') AS n_1, count(*) FILTER (event_type = 'purchase') AS n_2, count(*) FILTER (event_type = 'signup') AS n_3, count(*) FILTER (event_type = 'view') AS n_4 FROM events GROUP BY user_id""",
    "paired_recordings": f"""WITH {_DAY} SELECT a.ord AS file, b.ord AS file2 FROM dd a JOIN dd b ON a.rec // 10 = b.rec // 10 AND a.day = b.day AND a.species = 'view' AND b.species = 'purchase'
WHERE a.e > a.s AND least(a.e, b.e) - greatest(a.s, b.s) > 0.2::DOUBLE * (a.e - a.s) QUALIFY row_number() OVER (PARTITION BY a.ord ORDER BY b.s, b.ord) = 1""",
    "energy_crossings": f"""WITH {SPECTRA}, c AS (SELECT vec_id, k, sum(x * x) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS curve FROM sp),
f AS (SELECT vec_id, k, curve > avg(curve) OVER w + stddev_pop(curve) OVER w AS flag FROM c WINDOW w AS (PARTITION BY vec_id)),
g AS (SELECT *, k - row_number() OVER (PARTITION BY vec_id ORDER BY k) AS run FROM f WHERE flag) SELECT vec_id, min(k) AS s, max(k) + 1 AS e FROM g GROUP BY vec_id, run""",
    "median_filtered": f"WITH {SPECTRA} SELECT vec_id, CAST(k AS INT) AS k, round(median(x) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING), 6) AS median FROM sp",
    "waveform_features": f"""WITH {SPECTRA} SELECT vec_id, CAST(arg_min(k, {{'x': x, 'k': k}}) AS INT) AS at_least, CAST(arg_min(k, {{'x': -x, 'k': k}}) AS INT) AS at_largest,
round(min(x), 6) AS least, round(max(x), 6) AS largest, round(max(abs(x)), 6) AS peak, round(sqrt(avg(x * x)), 6) AS rms FROM sp GROUP BY vec_id""",
    "training_split": "SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 6) AS BIGINT) < 1677721 AS held_out FROM labels",
    "recording_lengths": f"WITH {DET} SELECT species, round(min(e - s), 3) AS least, round(max(e - s), 3) AS largest, round(avg(e - s), 3) AS mean, round(median(e - s), 3) AS median, round(sum(e - s), 3) AS total FROM det GROUP BY species",
    "excel_time_periods": f"WITH {_DAY}, h AS (SELECT rec, species, cert, {_HOURS} AS bin FROM dd) SELECT rec, species, bin, max(cert) AS max_cert FROM h GROUP BY rec, species, bin",
    "label_info": f"""WITH {LABELLED} SELECT rec, day, array_to_string(list_transform(list_filter(labels, lambda x: x.certainty = 100), lambda x: x.species), '; ') AS certain,
array_to_string(list_transform(list_filter(labels, lambda x: x.certainty < 100), lambda x: x.species), '; ') AS unsure FROM lab""",
    "species_set": "SELECT event_type AS species FROM events UNION SELECT unnest(['Any sound', 'view', 'kiwi'])",
    "done_files": f"""WITH {_DAY} SELECT rec, CASE WHEN max(day) >= 19737 THEN 'again' ELSE 'done' END AS state FROM dd GROUP BY rec HAVING min(day) < 19737""",
    "file_times": """SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS at, ltrim(strftime(ts, '%I:%M:%S'), '0') || CASE WHEN hour(ts) < 12 THEN ' a.m.' ELSE ' p.m.' END AS clock,
lpad(CAST((CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) % 7200 // 60) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) % 60 AS VARCHAR), 2, '0') AS minutes FROM events""",
    "file_names": r"SELECT p_partkey, regexp_replace(p_brand, '\W', '_', 'g') AS safe, regexp_replace(p_name, '[^A-Za-z0-9()-]', '', 'g') AS clean, CAST(sign(p_retailprice - 1000) * floor(abs(p_retailprice - 1000) + 0.5::DOUBLE) AS BIGINT) AS rounded FROM part",
    "certainties": "SELECT vec_id, CAST(CASE WHEN abs(CAST(embedding[1] AS DOUBLE)) * 4 >= 0.6::DOUBLE THEN 90 WHEN abs(CAST(embedding[1] AS DOUBLE)) * 4 >= 0.2::DOUBLE THEN 50 ELSE 0 END AS INT) AS certainty FROM embeddings",
}
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

"""Queries that write the library's file formats below the shared folder and read them back, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsong.operators import clustering, shapes
from fieldsong.operators import labels as label_operators
from fieldsong.operators.labels import LABEL
from fieldsong.plans.adapters import DET, detections, table
from fieldsong.plans.signal_queries import _SIG, _signals
from fieldsong.plans.sound_queries import _pictures
from fieldsong.sources import annotations, audio, chunks, exports, folders, images, recognisers
from fieldsong.sources.scratch import new_folder


#: Seconds of a sheet that one annotation file has.
SHEET_SECONDS = 8192


def _saved(spark: SparkSession, rows: DataFrame, name: Column) -> str:
    """The folder that a text file for each row of rows(value) is in."""
    folder = new_folder(spark)
    audio.saved(rows.select(name.alias("name"), F.col("value").cast("binary").alias("content")), folder, folders.SPREAD).count()
    return folder


def _stem(column: str, ending: str) -> Column:
    return F.regexp_extract(column, rf"([^/]+){ending}$", 1)


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recorder's detections as segments of one file: seconds of its year, a band by the certainty, one label or two."""
    det = detections(spark, sf_dir)
    none = F.lit(None).cast("string")
    one = lambda s, c: F.struct(s.alias("species"), c.cast("double").alias("certainty"), none.alias("calltype"), none.alias("filter"))
    both = F.when(F.col("cert") == 90, F.array(one(F.col("species"), F.col("cert")), one(F.lit("Kiwi"), F.lit(50)))).otherwise(F.array(one(F.col("species"), F.col("cert"))))
    start = F.round(F.col("s") - 1_704_067_200, 3)
    return det.select(
        F.col("rec").cast("string").alias("file_id"), F.col("ord").alias("seg_id"), start.alias("s"), F.round(start + (F.col("e") - F.col("s")), 3).alias("e"),
        (F.col("cert") * 10 + 2).cast("int").alias("f_lo"), (F.col("cert") * 20 + 500).cast("int").alias("f_hi"), both.cast(f"array<{LABEL}>").alias("labels"),
    )


def annotation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections written as annotation files and read again, a row a label."""
    segments = _segments(spark, sf_dir)
    metadata = segments.select("file_id").distinct().select("file_id", F.lit("Auto").alias("operator"), F.lit("").alias("reviewer"), F.lit(60.0).alias("duration"), F.lit(None).cast("string").alias("noise_level"), F.array().cast("array<string>").alias("noise_types"))
    folder = _saved(spark, annotations.annotation_text(segments, metadata), F.concat("file_id", F.lit(".wav.data")))
    back = annotations.read_annotations(spark, folder)
    each = back.select(_stem("file_id", r"\.wav\.data").cast("long").alias("rec"), "seg_id", "s", "e", "f_lo", "f_hi", F.posexplode("labels").alias("k", "x"))
    return each.select("rec", "seg_id", "s", "e", "f_lo", "f_hi", "k", F.col("x.species").alias("species"), F.col("x.certainty").alias("certainty"))


def annotation_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of files whose operator and duration follow from their customer, read again."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("file_id"), F.concat(F.lit("op"), F.col("c_nationkey")).alias("operator"), F.lit("Rev").alias("reviewer"), F.col("c_acctbal").cast("double").alias("duration"), F.when(F.col("c_custkey") % 3 == 0, "High").alias("noise_level"), F.array(F.lit("Wind"), F.lit("Rain")).alias("noise_types"))
    folder = _saved(spark, annotations.annotation_text(_segments(spark, sf_dir).limit(0), c), F.concat("file_id", F.lit(".data")))
    back = annotations.read_metadata(spark, folder)
    return back.select(_stem("file_id", r"\.data").cast("long").alias("custkey"), "operator", "reviewer", "duration", "noise_level", F.array_join("noise_types", ";").alias("noise_types"))


def truth_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as ground truth of 64 seconds each, written and read again."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("bin", "x"))
    present = (F.col("x") > 0.05).cast("int")
    presence = e.select("vec_id", "bin", present.alias("present"), F.when(present == 1, F.concat(F.lit("sp"), F.col("label"))).alias("species"))
    lines = annotations.truth_lines(presence, ["vec_id"], 1.0).groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("bin", "value"))).alias("v"))
    rows = lines.select("vec_id", F.array_join(F.transform("v", lambda x: x["value"]), "\n").alias("value"))
    back = annotations.read_truth(spark, _saved(spark, rows, F.concat("vec_id", F.lit("-GT.txt"))))
    return back.select(_stem("file_id", r"-GT\.txt").cast("long").alias("vec_id"), "bin", "time", "present", "species")


def _filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as recognisers of one subfilter or two."""
    s = table(spark, sf_dir, "supplier").withColumn("k", F.explode(F.sequence(F.lit(0), F.pmod("s_suppkey", F.lit(2)).cast("int"))))
    key = F.col("s_suppkey")
    return s.select(
        F.concat(F.lit("F"), key).alias("filter_id"), F.concat(F.lit("Bird "), F.col("s_nationkey")).alias("species"), F.lit(16000).alias("sample_rate"), F.when(key % 3 == 0, "chp").otherwise("wv").alias("method"),
        F.concat(F.lit("call"), F.col("k")).alias("calltype"), F.array(F.lit(1.5), (key % 7 + 10).cast("double"), F.lit(0.5), F.lit(1.0)).alias("time_range"), F.array((key % 900).cast("int"), F.lit(4000)).alias("freq_range"),
        (F.col("s_acctbal").cast("double") / 1000).alias("thr"), F.lit(0.25).alias("m"), F.lit(1.0).alias("win"), F.array((key % 60).cast("int"), F.lit(61), F.col("k").cast("int")).alias("nodes"), (F.col("k") == 1).alias("f0"), F.array(F.lit(100.0), F.lit(900.0)).alias("f0_range"),
    )


def recogniser_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognisers written, and read again a row a subfilter; those of bats are left out."""
    filters = _filters(spark, sf_dir).withColumn("species", F.when(F.col("species") == "Bird 3", "Long-tailed Bat").otherwise(F.col("species")))
    folder = _saved(spark, recognisers.recogniser_text(filters), F.col("file_id"))
    back = annotations.read_filters(spark, folder, bats=False)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return back.select("filter_id", "species", "sample_rate", "method", "calltype", text("time_range"), text("freq_range"), F.round("thr", 6).alias("thr"), "m", "win", text("nodes"), "f0", text("f0_range"))


def network_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The network blocks of every third recogniser, read again from the recognisers' files."""
    key = F.col("s_suppkey")
    nets = table(spark, sf_dir, "supplier").where(key % 3 == 1).select(
        F.concat(F.lit("F"), key).alias("filter_id"), F.concat(F.lit("net"), key).alias("name"), F.lit(256).alias("window"), F.lit(128).alias("step"), F.lit(200).alias("width"), F.lit(48).alias("height"),
        F.transform(F.sequence(F.lit(0), (key % 4).cast("int")), lambda k: F.concat(F.lit("call"), k)).alias("outputs"), F.transform(F.sequence(F.lit(0), (key % 4).cast("int")), lambda k: F.array(F.lit(0.25), (k + 1) / 8)).alias("thresholds"),
        F.when(key % 2 == 0, (key % 500).cast("int")).alias("f_lo"), F.when(key % 2 == 0, F.lit(6000)).alias("f_hi"),
    )
    back = recognisers.read_networks(spark, _saved(spark, recognisers.recogniser_text(_filters(spark, sf_dir), nets), F.col("file_id")))
    return back.select("filter_id", "name", "window", "step", F.array_join("outputs", ",").alias("outputs"), F.array_join(F.transform("thresholds", lambda p: F.format_number(p[1], 3)), ",").alias("upper"), "f_lo", "f_hi")


def call_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call lists of each nation: its customers' segments."""
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("nation "), F.col("c_nationkey")).alias("species"), F.lower("c_mktsegment").alias("call"))
    lines = exports.call_lines(c.groupBy("species").agg(F.collect_set("call").alias("calls")))
    rows = lines.groupBy("species").agg(F.array_join(F.array_sort(F.collect_list("value")), "\n").alias("value"))
    folder = _saved(spark, rows, F.concat(F.translate("species", " ", "_"), F.lit(".txt")))
    return annotations.known_calls(spark, folder).select("species", F.array_join("calls", ",").alias("calls"))


def correction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of which a review took a label or all, as correction files; read again, with what is noise to the Kiwi."""
    before = _segments(spark, sf_dir)
    kept = F.when(F.col("seg_id") % 3 == 0, F.slice("labels", 1, 1)).when(F.col("seg_id") % 7 == 0, F.array().cast(f"array<{LABEL}>")).otherwise(F.col("labels"))
    after = before.where("seg_id % 5 <> 0").withColumn("labels", kept)
    changed = exports.corrected(before, after, ["file_id", "seg_id"]).join(before.drop("labels"), ["file_id", "seg_id"])
    rows = exports.correction_text(changed, F.lit('{"Operator": "Auto"}'))
    back = exports.read_corrections(spark, _saved(spark, rows, F.concat("file_id", F.lit(".corrections"))))
    noise = exports.rejected_as_noise(back, "Kiwi").select("file_id", "pos", F.lit(True).alias("noise"))
    names = lambda c: F.array_join(F.transform(c, lambda x: x["species"]), ",").alias(c)
    both = back.join(noise, ["file_id", "pos"], "left")
    return both.select(_stem("file_id", r"\.corrections").cast("long").alias("rec"), "pos", "s", "e", "f_lo", "f_hi", names("before"), names("after"), F.coalesce("noise", F.lit(False)).alias("noise"))


def gps_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorders' logs with a position in every third line; the last one counts."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.pmod("s_suppkey", F.lit(9)).cast("int"))).alias("line"))
    text = F.when(F.col("line") % 3 == 0, F.concat(F.lit("2024 GPS (lat,long): -"), F.col("line") + 36, F.lit(".25,"), F.col("s_suppkey") % 90 + 90, F.lit(".5"))).otherwise(F.concat(F.lit("battery "), F.col("line")))
    rows = s.groupBy("s_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", text.alias("t")))), lambda x: x["t"]), "\n").alias("value"))
    back = annotations.last_position(spark, _saved(spark, rows, F.concat("s_suppkey", F.lit(".log"))))
    return back.select(_stem("file_id", r"\.log").cast("long").alias("suppkey"), "lat", "long")


def bat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bat recordings of a day's folder: the importing program's XML, read again, and its table of categories."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select("o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("folder"), F.concat(F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), F.lpad(F.pmod("o_orderkey", F.lit(24)).cast("string"), 2, "0"), F.lit("3015.bmp")).alias("base"))
    files = o.select("folder", F.concat(F.col("o_orderkey"), F.lit("_"), "base").alias("name"), "o_orderkey")
    none = F.lit(None).cast("string")
    kind = F.when(F.col("o_orderkey") % 3 == 0, exports.LONG).otherwise(exports.SHORT)
    label = F.struct(kind.alias("species"), F.pmod("o_orderkey", F.lit(101)).cast("double").alias("certainty"), none.alias("calltype"), none.alias("filter"))
    labels = F.when(F.col("o_orderkey") % 4 == 0, F.array(label, label)).otherwise(F.array(label)).cast(f"array<{LABEL}>")
    segments = files.where("o_orderkey % 20 = 0 or o_orderkey % 50 = 10").select("folder", "name", F.lit(0).alias("seg_id"), labels.alias("labels"))
    found = exports.bat_recordings(files, segments)
    folder = new_folder(spark)
    exports.write_bat_xml(found, folder)
    back = spark.read.format("xml").option("rowTag", "BatRecording").schema("AssignedBatCategory int, RecTime string, RecordingFileName string, RecordingFolderName string").load(folder)
    csv = exports.bat_csv(found).select(F.col("Filename").alias("RecordingFileName"), "Date", "Time", "Category")
    return back.join(csv, "RecordingFileName").select(F.col("RecordingFileName").alias("name"), F.col("AssignedBatCategory").alias("code"), F.col("RecTime").alias("rec_time"), F.col("RecordingFolderName").alias("folder"), F.col("Date").alias("date"), F.col("Time").alias("time"), F.col("Category").alias("category"))


def bat_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as columns of bat recorders' images, written as BMP files and read again, a row a column: its sum and its loudest band."""
    frames = _pictures(spark, sf_dir).select("file_id", (F.col("page") * 16 + F.col("frame")).alias("frame"), "mags")
    folder = new_folder(spark)
    audio.saved(images.image_files(frames), folder).count()
    back = images.image_frames(audio.files(spark, folder, "*.bmp"))
    total = F.aggregate("mags", F.lit(0.0), lambda a, m: a + m)
    return back.select(_stem("file_id", r"\.bmp").cast("long").alias("rec"), "frame", F.round("t", 9).alias("t"), F.round(total, 4).alias("total"), (F.array_position("mags", F.array_max("mags")) - 1).cast("int").alias("band"))


def species_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the long list from nations and segments, taken apart again, and whether they are in the short list."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.min("c_custkey").alias("pos"))
    kind = F.when(F.col("c_nationkey") % 4 != 0, F.lower("c_mktsegment"))
    named = c.select("pos", recognisers.long_name(F.concat(F.lit("nation"), F.col("c_nationkey")), kind).alias("name"))
    old = F.when(F.col("pos") % 5 == 0, F.regexp_replace(F.regexp_replace("name", r" \(", ">"), r"\)", "")).otherwise(F.col("name"))
    group, part = recognisers.split_name(old)
    short = recognisers.short_list(named).select("name", F.lit(True).alias("short"))
    return named.withColumns({"group": group, "kind": part}).join(short, "name", "left").select("pos", "name", "group", "kind", F.coalesce("short", F.lit(False)).alias("short"))


def valid_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of four kinds, found by their endings; those that are long enough and begin as their kind does are valid."""
    key = F.col("s_suppkey")
    ending = F.element_at(F.array(*map(F.lit, (".wav", ".flac", ".bmp", ".txt"))), (key % 4).cast("int") + 1)
    magic = F.element_at(F.array(*map(F.lit, ("RIFF", "fLaC", "BM", "RIFX", "none"))), (key % 5).cast("int") + 1)
    # As recorders do that take a file's place on the card first: behind the head there are bytes 0.
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("rec"), key, ending).alias("name"), F.rpad(magic, 16, "x").cast("binary").alias("content"), (key * 3 + 900).alias("length"))
    folder = new_folder(spark)
    audio.saved(rows, folder, folders.SPREAD).count()
    found = folders.heads(spark, folder, "*.{wav,flac,bmp}")
    return found.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", audio.is_valid().alias("valid"))


def folder_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Species of every tenth recorder's folder, with their least certainty and how often they are labelled."""
    return exports.species_overview(_segments(spark, sf_dir), F.expr("cast(file_id as bigint) div 10"))


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks in the images of each recording, and the seconds from the first to the last."""
    frames = _pictures(spark, sf_dir).withColumn("frame", F.col("page") * 16 + F.col("frame")).withColumn("page", F.lit(0))
    found = images.clicks(frames, 0.5, 17)
    spans = images.click_spans(found).withColumnRenamed("seconds", "span")
    return found.join(spans, "file_id").select("file_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), F.round("span", 9).alias("span"))


def common_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long the common part of each vector and the next one is, their elements in steps of a tenth, and whether the part itself is that long."""
    steps = F.transform("embedding", lambda v: F.floor(v.cast("double") * 10).cast("int"))
    v = table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", steps.alias("a"))
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    return both.select("vec_id", F.size(clustering.common_part(F.col("a"), F.col("b"))).alias("length"))


def sheet_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rows of sheets, one a supplier's last digit and line number, written as annotations by hand and read again.

    A sheet's annotations are files of SHEET_SECONDS each, as recorders begin a new file, so that sheets grow by files.
    """
    li = table(spark, sf_dir, "lineitem")
    key = F.concat_ws("_", F.col("l_suppkey") % 10, "l_linenumber")
    start = F.when(F.col("l_quantity") != 7, (F.col("l_orderkey") / 8).cast("string"))
    rows = li.select(key.alias("file_id"), F.col("l_orderkey").alias("row"), start.alias("start"), (F.col("l_orderkey") / 8 + F.col("l_quantity").cast("double")).cast("string").alias("end"), F.lit("100").alias("low"), (F.col("l_linenumber") * 1000).cast("string").alias("high"), F.col("l_returnflag").alias("flag"))
    sheet = annotations.from_sheet(rows, F.lit("Kiwi"), F.when(F.col("flag") == "R", "duet").when(F.col("flag") == "A", ""))
    sheet = sheet.withColumn("file_id", F.concat_ws("-", "file_id", F.floor(F.col("s") / SHEET_SECONDS)))
    header = sheet.select("file_id").distinct().select("file_id", F.lit("").alias("operator"), F.lit("").alias("reviewer"), F.lit(60.0).alias("duration"), F.lit(None).cast("string").alias("noise_level"), F.array().cast("array<string>").alias("noise_types"))
    back = annotations.read_annotations(spark, _saved(spark, annotations.annotation_text(sheet, header), F.concat("file_id", F.lit(".data"))))
    one = F.get("labels", F.lit(0))
    each = back.select(_stem("file_id", r"-\d+\.data").alias("file_id"), "s", "e", "f_lo", "f_hi", one["species"].alias("species"), one["certainty"].alias("certainty"), one["calltype"].alias("calltype"), one["filter"].alias("source"))
    return each.groupBy("file_id", "f_lo", "f_hi", "species", "certainty", "calltype", "source").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("e") - F.col("s")), 4).alias("seconds"), F.max("s").alias("last"))


def middle_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as segments with a level line in the middle of their band: its text's length tells its values."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(100)).cast("double").alias("s"), (F.pmod("o_orderkey", F.lit(100)) + F.pmod("o_custkey", F.lit(40)) / 8).alias("e"), F.lit(500).alias("f_lo"), (F.pmod("o_custkey", F.lit(30)) * 100 + 600).alias("f_hi"))
    lines = shapes.middle_lines(o, 0.5, 62.5)
    back = F.from_json(shapes.shape_text(F.col("shape")), "t array<double>, tunit double, yunit double, y array<double>")
    return lines.select("o_orderkey", back.alias("b")).select("o_orderkey", F.get("b.t", F.lit(1)).alias("end"), F.size("b.y").alias("n"), F.round(F.get("b.y", F.lit(0)), 6).alias("y"), "b.yunit")


def target_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of purchases' call types, and of clicks, which have one type alone."""
    det = detections(spark, sf_dir)
    kind = F.when(F.col("cert") == 100, "song").when(F.col("cert") == 50, "call")
    label = F.struct("species", F.col("cert").cast("double").alias("certainty"), kind.alias("calltype"), F.lit(None).cast("string").alias("filter"))
    own = det.select("ord", F.array(label).cast(f"array<{LABEL}>").alias("labels"))
    song = label_operators.of_calltype(F.col("labels"), "purchase", ["song", "call"], "song")
    click = label_operators.of_calltype(F.col("labels"), "click", ["tick"], "tick")
    return own.select("ord", song.alias("song"), click.alias("click")).where("song or click")


def first_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first second of recordings saved at 300 Hz, saved again and read: how many samples, and their sum."""
    rows = _signals(spark, sf_dir, 100_000.0).select(F.concat("file_id", F.lit(".wav")).alias("name"), audio.wav_column(F.col("samples"), 300).alias("content"))
    whole, first = new_folder(spark), new_folder(spark)
    audio.saved(rows, whole).count()
    audio.saved(chunks.first_seconds(audio.files(spark, whole), 1), first).count()
    back = audio.ranged_pages(audio.files(spark, first), 0.0)
    return back.select(_stem("file_id", r"\.wav").alias("file_id"), "fs", F.size("samples").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, v: a + v).cast("long").alias("total"))


_SEG = f"""{DET}, sg AS (SELECT rec, ord, species, cert, round(s - 1704067200, 3) AS s, round(round(s - 1704067200, 3) + (e - s), 3) AS e, CAST(cert * 10 + 2 AS INT) AS f_lo, CAST(cert * 20 + 500 AS INT) AS f_hi FROM det)"""
SQL = {
    "annotation_files": f"""WITH {_SEG}, n AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY s, ord) AS seg_id FROM sg)
SELECT rec, seg_id, s, e, f_lo, f_hi, 0::INT AS k, species, CAST(cert AS DOUBLE) AS certainty FROM n UNION ALL SELECT rec, seg_id, s, e, f_lo, f_hi, 1::INT, 'Kiwi', 50.0::DOUBLE FROM n WHERE cert = 90""",
    "annotation_headers": "SELECT c_custkey AS custkey, 'op' || c_nationkey AS operator, 'Rev' AS reviewer, CAST(c_acctbal AS DOUBLE) AS duration, CASE WHEN c_custkey % 3 = 0 THEN 'High' END AS noise_level, 'Wind;Rain' AS noise_types FROM customer",
    "truth_files": """WITH x AS (SELECT vec_id, label, unnest(range(len(embedding))) AS bin, unnest(embedding) AS x FROM embeddings)
SELECT vec_id, CAST(bin AS INT) AS bin, CAST(bin + 1 AS DOUBLE) AS time, CAST(x > CAST(0.05 AS DOUBLE) AS INT) AS present, CASE WHEN x > CAST(0.05 AS DOUBLE) THEN 'sp' || label END AS species FROM x""",
    "recogniser_files": """WITH x AS (SELECT *, unnest(range(s_suppkey % 2 + 1)) AS k FROM supplier WHERE s_nationkey <> 3)
SELECT 'F' || s_suppkey AS filter_id, 'Bird ' || s_nationkey AS species, 16000::INT AS sample_rate, CASE WHEN s_suppkey % 3 = 0 THEN 'chp' ELSE 'wv' END AS method, 'call' || k AS calltype, '1.5,' || (s_suppkey % 7 + 10) || '.0,0.5,1.0' AS time_range,
  (s_suppkey % 900) || ',4000' AS freq_range, round(CAST(s_acctbal AS DOUBLE) / 1000, 6) AS thr, 0.25::DOUBLE AS m, 1.0::DOUBLE AS win, (s_suppkey % 60) || ',61,' || k AS nodes, k = 1 AS f0, '100.0,900.0' AS f0_range FROM x""",
    "network_blocks": """SELECT 'F' || s_suppkey AS filter_id, 'net' || s_suppkey AS name, 256::INT AS window, 128::INT AS step, array_to_string(list_transform(range(s_suppkey % 4 + 1), lambda k: 'call' || k), ',') AS outputs,
  array_to_string(list_transform(range(s_suppkey % 4 + 1), lambda k: printf('%.3f', (k + 1) / 8)), ',') AS upper, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 500 AS INT) END AS f_lo, CASE WHEN s_suppkey % 2 = 0 THEN 6000::INT END AS f_hi FROM supplier WHERE s_suppkey % 3 = 1""",
    "call_files": "SELECT 'nation ' || c_nationkey AS species, string_agg(DISTINCT lower(c_mktsegment), ',' ORDER BY lower(c_mktsegment)) AS calls FROM customer GROUP BY c_nationkey",
    "correction_files": f"""WITH {_SEG}, b AS (SELECT *, CASE WHEN cert = 90 THEN species || ',Kiwi' ELSE species END AS before FROM sg),
a AS (SELECT *, CASE WHEN ord % 5 = 0 THEN '' WHEN ord % 3 = 0 THEN species WHEN ord % 7 = 0 THEN '' ELSE before END AS after FROM b)
SELECT rec, CAST(row_number() OVER (PARTITION BY rec ORDER BY ord) AS INT) AS pos, s, e, f_lo, f_hi, before, after, (cert = 90 OR species = 'Kiwi') AND NOT contains(after, 'Kiwi') AS noise FROM a WHERE before <> after""",
    "gps_logs": "SELECT s_suppkey AS suppkey, -(s_suppkey % 9 // 3 * 3 + 36 + 0.25::DOUBLE) AS lat, s_suppkey % 90 + 90 + 0.5::DOUBLE AS long FROM supplier",
    "bat_files": """WITH o AS (SELECT o_orderkey AS k, strftime(o_orderdate, '%Y%m') AS folder, o_orderdate AS d, o_orderkey % 24 AS h, o_orderkey % 101 AS c, o_orderkey % 20 = 0 OR o_orderkey % 50 = 10 AS has FROM orders WHERE o_orderkey % 10 = 0),
g AS (SELECT *, CASE WHEN NOT has THEN 'Non-bat' WHEN k % 4 = 0 THEN 'Both' WHEN c >= 85 AND k % 3 = 0 THEN 'Long Tail' WHEN c >= 85 THEN 'Short Tail' WHEN c > 70 AND k % 3 = 0 THEN 'Possible LT' WHEN c > 70 THEN 'Possible ST' ELSE 'Non-bat' END AS category FROM o)
SELECT k || '_' || strftime(d, '%Y%m%d') || '_' || printf('%02d', h) || '3015.bmp' AS name, CAST(CASE category WHEN 'Non-bat' THEN 1 WHEN 'Long Tail' THEN 3 WHEN 'Short Tail' THEN 4 WHEN 'Possible LT' THEN 5 WHEN 'Possible ST' THEN 6 ELSE 7 END AS INT) AS code,
  strftime(d, '%Y-%m-%dT') || printf('%02d', h) || ':30:15' AS rec_time, '.\\' || folder AS folder, day(d) || strftime(d, '/%m/%Y') AS date, (CASE WHEN h % 12 = 0 THEN 12 ELSE h % 12 END) || ':30:15' || CASE WHEN h < 12 THEN ' a.m.' ELSE ' p.m.' END AS time, category FROM g""",
    "bat_images": """WITH p AS (SELECT vec_id // 64 AS rec, vec_id % 64 AS frame, unnest(range(len(embedding))) AS k, abs(CAST(unnest(embedding) AS DOUBLE)) AS m FROM embeddings),
q AS (SELECT rec, frame, k, CASE WHEN k = 0 THEN 1 ELSE floor(255 * (m / max(m) OVER (PARTITION BY rec))) END AS b FROM p), z AS (SELECT *, CAST(b / max(b) OVER (PARTITION BY rec) AS FLOAT) AS v, row_number() OVER (PARTITION BY rec ORDER BY frame, k) AS n, dense_rank() OVER (PARTITION BY rec ORDER BY frame) - 1 AS col FROM q)
SELECT rec, CAST(col AS INT) AS frame, round(col * 512 / 176000.0::DOUBLE, 9) AS t, round(sum(CAST(v AS DOUBLE)), 4) AS total, CAST(arg_min(k, {'v': -v, 'k': k}) AS INT) AS band FROM z GROUP BY rec, col""",
    "valid_files": """WITH f AS (SELECT s_suppkey AS k, s_suppkey * 3 + 900 AS length FROM supplier WHERE s_suppkey % 4 < 3)
SELECT 'rec' || k || CASE k % 4 WHEN 0 THEN '.wav' WHEN 1 THEN '.flac' ELSE '.bmp' END AS name, length, length >= 1000 AND k % 5 < 3 AS valid FROM f""",
    "folder_species": f"""WITH {_SEG}, x AS (SELECT rec // 10 AS folder, species, CAST(cert AS DOUBLE) AS c FROM sg UNION ALL SELECT rec // 10, 'Kiwi', 50 FROM sg WHERE cert = 90)
SELECT folder, species, min(c) AS least, count(*) AS n FROM x GROUP BY folder, species""",
    "clicks": """WITH p AS (SELECT vec_id // 64 AS rec, vec_id % 64 AS frame, list_sum(list_transform(embedding[19:39], lambda v: abs(CAST(v AS DOUBLE)))) / 21 AS level FROM embeddings),
o AS (SELECT *, level > avg(level) OVER w + 0.5::DOUBLE * stddev_pop(level) OVER w AS hit FROM p WINDOW w AS (PARTITION BY rec)), r AS (SELECT rec, frame, row_number() OVER (PARTITION BY rec ORDER BY frame) - row_number() OVER (PARTITION BY rec, hit ORDER BY frame) AS run, hit FROM o),
c AS (SELECT rec, min(frame) AS s, max(frame) + 1 AS e FROM r WHERE hit GROUP BY rec, run HAVING max(frame) + 1 - min(frame) <= 17)
SELECT CAST(rec AS VARCHAR) AS file_id, s, e, round((max(e) OVER (PARTITION BY rec) - min(s) OVER (PARTITION BY rec)) * 512 / 176000.0::DOUBLE, 9) AS span FROM c""",
    "common_parts": """WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 10) AS INT)) AS a FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT v.vec_id, v.a, w.a AS b FROM v JOIN v w ON w.vec_id = v.vec_id + 1),
r AS (SELECT vec_id, a, b, 0 AS i, list_transform(range(len(b) + 1), lambda j: 0) AS row_ FROM p UNION ALL SELECT vec_id, a, b, i + 1, list_transform(range(len(b) + 1), lambda j: list_max(raw[1:j + 1])) FROM (
  SELECT *, list_transform(range(len(b) + 1), lambda j: CASE WHEN j = 0 THEN 0 WHEN a[i + 1] = b[j] THEN greatest(row_[j] + 1, row_[j + 1]) ELSE row_[j + 1] END) AS raw FROM r WHERE i < len(a)))
SELECT vec_id, row_[len(b) + 1] AS length FROM r WHERE i = len(a)""",
    "sheet_annotations": """WITH r AS (SELECT l_suppkey % 10 || '_' || l_linenumber AS file_id, l_orderkey / 8 AS s, l_orderkey / 8 + CAST(l_quantity AS DOUBLE) AS e, CAST(l_linenumber * 1000 AS INT) AS f_hi, CASE WHEN l_returnflag = 'R' THEN 'duet' END AS calltype FROM lineitem WHERE l_quantity <> 7)
SELECT file_id, 100::INT AS f_lo, f_hi, 'Kiwi' AS species, 100.0::DOUBLE AS certainty, calltype, 'M' AS source, count(*) AS n, round(sum(e - s), 4) AS seconds, max(s) AS last FROM r GROUP BY file_id, f_hi, calltype""",
    "middle_lines": """WITH o AS (SELECT o_orderkey, CAST(o_orderkey % 100 AS DOUBLE) AS s, o_orderkey % 100 + o_custkey % 40 / 8 AS e, o_custkey % 30 * 100 + 600 AS f_hi FROM orders), n AS (SELECT *, CAST(floor((e - s) / 0.5) AS INT) AS n FROM o)
SELECT o_orderkey, e AS "end", n, CASE WHEN n > 0 THEN round((500 + f_hi) / 2 / 62.5::DOUBLE, 6) END AS y, 62.5::DOUBLE AS yunit FROM n""",
    "target_segments": f"""WITH {DET} SELECT ord, species = 'purchase' AND cert = 100 AS song, species = 'click' AS click FROM det WHERE (species = 'purchase' AND cert = 100) OR species = 'click'""",
    "first_seconds": f"""WITH {_SIG}, w AS (SELECT file_id, CAST(greatest(-32768, least(32767, trunc(x * 100000.0::DOUBLE))) AS BIGINT) AS x FROM sig WHERE i < 300) SELECT file_id, 300::INT AS fs, CAST(count(*) AS INT) AS n, CAST(sum(x) AS BIGINT) AS total FROM w GROUP BY file_id""",
    "species_lists": """WITH c AS (SELECT c_nationkey AS g, lower(c_mktsegment) AS m, min(c_custkey) AS pos FROM customer GROUP BY ALL),
n AS (SELECT pos, 'nation' || g AS grp, CASE WHEN g % 4 <> 0 THEN m END AS kind FROM c), l AS (SELECT pos, grp, kind, grp || CASE WHEN kind IS NULL THEN '' ELSE ' (' || kind || ')' END AS name FROM n),
s AS (SELECT name FROM (SELECT name, min(pos) AS pos FROM l GROUP BY name) ORDER BY pos, name LIMIT 29) SELECT pos, name, grp AS "group", kind, name IN (SELECT name FROM s) AS short FROM l""",
}
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

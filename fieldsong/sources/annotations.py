"""Annotation files and the small text formats beside them, read and written as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldsong.operators.labels import LABEL, label, or_unsure
from fieldsong.sources import folders

META = "Operator string, Reviewer string, Duration double, noiseLevel string, noiseTypes array<string>"
FILTER = """species string, SampleRate int, method string, Filters array<struct<calltype: string, TimeRange: array<double>, FreqRange: array<int>,
 WaveletParams: struct<thr: double, M: double, win: double, nodes: array<int>>, ClusterCentre: array<double>, F0: boolean, F0Range: array<double>>>"""


def _elements(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """file_id, pos, el: the elements of each file's JSON array, as JSON."""
    return folders.texts(spark, path, glob).select("file_id", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "el"))


def read_metadata(spark: SparkSession, path: str, glob: str = "*.data") -> DataFrame:
    """file_id, operator, reviewer, duration, noise_level, noise_types, of both kinds of header; nulls without one."""
    head = _elements(spark, path, glob).where("pos = 0")
    new = F.from_json("el", META)
    old = F.when(F.col("el").startswith("["), F.from_json("el", "array<string>"))
    is_old = F.get(old, F.lit(0)).cast("double") == -1
    noise = F.when(is_old, F.from_json(F.get(old, F.lit(4)), "array<string>"))
    pick = lambda name, k: F.when(is_old, F.get(old, F.lit(k))).otherwise(new[name])
    return head.select(
        "file_id", pick("Operator", 2).alias("operator"), pick("Reviewer", 3).alias("reviewer"),
        F.when(is_old, F.get(old, F.lit(1)).try_cast("double")).otherwise(new["Duration"]).alias("duration"),
        F.when(is_old, F.get(noise, F.lit(0))).otherwise(new["noiseLevel"]).alias("noise_level"),
        F.when(is_old, F.from_json(F.get(noise, F.lit(1)), "array<string>")).otherwise(new["noiseTypes"]).alias("noise_types"),
    )


def upgraded(text: Column) -> Column:
    """Labels of old files, which are names: Don't Know is 0, a name with a question mark 50, any other 100."""
    one = lambda x: F.when(x == "Don't Know", label(x, F.lit(0.0))).when(x.endswith("?"), label(F.regexp_replace(x, r"\?$", ""), F.lit(50.0), source=F.lit("M"))).otherwise(label(x, F.lit(100.0), source=F.lit("M")))
    names = F.when(text.startswith("["), F.from_json(text, "array<string>")).otherwise(F.array(text))
    return F.transform(names, one)


def read_annotations(spark: SparkSession, path: str, glob: str = "*.data") -> DataFrame:
    """file_id, seg_id, s, e, f_lo, f_hi, labels: the segments of annotation files of either format.

    Old files' labels are upgraded and their frequencies from 0 to 1 count as the full band (0, 0); a segment
    without labels has Don't Know.
    """
    rows = _elements(spark, path, glob).where(F.col("el").startswith("["))
    parts = F.from_json("el", "array<string>")
    rows = rows.withColumn("p", parts).where((F.size("p") == 5) & (F.get("p", F.lit(0)).try_cast("double") >= 0))
    text = F.get("p", F.lit(4))
    new = F.from_json(text, f"array<{LABEL}>")
    labels = F.when(text.rlike(r"^\[\s*\{"), new).when(text == "[]", F.array().cast(f"array<{LABEL}>")).otherwise(upgraded(text))
    low, high = F.get("p", F.lit(2)).cast("double"), F.get("p", F.lit(3)).cast("double")
    small = (high <= 1) & (high > 0)
    whole = lambda x: F.when(small, 0).otherwise(x.cast("int"))
    return rows.select("file_id", F.col("pos").cast("long").alias("seg_id"), F.get("p", F.lit(0)).cast("double").alias("s"), F.get("p", F.lit(1)).cast("double").alias("e"), whole(low).alias("f_lo"), whole(high).alias("f_hi"), or_unsure(labels).alias("labels"))


def annotation_text(segments: DataFrame, metadata: DataFrame) -> DataFrame:
    """file_id, value: the text of an annotation file, segments in order of time; files without segments keep their header."""
    fields = F.to_json("labels")
    seg = F.concat(F.lit("["), F.concat_ws(", ", F.col("s").cast("string"), F.col("e").cast("string"), F.col("f_lo").cast("string"), F.col("f_hi").cast("string"), fields), F.lit("]"))
    packed = segments.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("s", "seg_id", seg.alias("text")))).alias("segs"))
    meta = F.to_json(F.struct(F.col("operator").alias("Operator"), F.col("reviewer").alias("Reviewer"), F.col("duration").alias("Duration"), F.col("noise_level").alias("noiseLevel"), F.col("noise_types").alias("noiseTypes")), {"ignoreNullFields": "false"})
    body = F.coalesce(F.transform("segs", lambda x: x["text"]), F.array().cast("array<string>"))
    return metadata.join(packed, "file_id", "left").select("file_id", F.concat(F.lit("["), F.array_join(F.concat(F.array(meta), body), ", "), F.lit("]")).alias("value"))


def read_truth(spark: SparkSession, path: str, glob: str = "*-GT.txt") -> DataFrame:
    """file_id, bin, present, species of ground truth; the time in a row is the end of its bin."""
    rows = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").csv(path, sep="\t", schema="time double, present int, species string")
    order = Window.partitionBy("file_id").orderBy("time")
    named = rows.where("time is not null").withColumn("file_id", F.input_file_name())
    return named.select("file_id", (F.row_number().over(order) - 1).alias("bin"), "time", "present", F.when(F.col("species") != "None", F.col("species")).alias("species"))


def truth_lines(presence: DataFrame, by: list[str], res: float) -> DataFrame:
    """by, value: lines of a ground truth file for presence(by, bin, present, species)."""
    return presence.select(*by, "bin", F.concat_ws("\t", ((F.col("bin") + 1) * res).cast("string"), F.col("present").cast("string"), F.coalesce("species", F.lit("None"))).alias("value"))


def read_filters(spark: SparkSession, path: str, bats: bool = True) -> DataFrame:
    """Recognisers by file: one row a subfilter. Incomplete ones are left out; without a method they are wavelet ones."""
    text = folders.texts(spark, path, "*.txt").withColumn("filter_id", F.regexp_extract("file_id", r"([^/]+)\.txt$", 1))
    f = text.select("filter_id", F.from_json("value", FILTER).alias("f")).select("filter_id", "f.*").withColumn("method", F.coalesce("method", F.lit("wv")))
    ok = F.col("species").isNotNull() & F.col("SampleRate").isNotNull() & (F.size("Filters") > 0) & F.col("method").isin("wv", "chp")
    each = F.forall("Filters", lambda x: x["calltype"].isNotNull() & x["WaveletParams"]["thr"].isNotNull() & x["WaveletParams"]["nodes"].isNotNull() & (F.size(x["TimeRange"]) >= 4))
    kept = f.where(ok & each)
    kept = kept if bats else kept.where(~F.col("species").contains("Bat"))
    return kept.select("filter_id", "species", F.col("SampleRate").alias("sample_rate"), "method", F.explode("Filters").alias("x")).select(
        "filter_id", "species", "sample_rate", "method", "x.calltype", F.col("x.TimeRange").alias("time_range"), F.col("x.FreqRange").alias("freq_range"),
        F.col("x.WaveletParams.thr").alias("thr"), F.col("x.WaveletParams.M").alias("m"), F.col("x.WaveletParams.win").alias("win"), F.col("x.WaveletParams.nodes").alias("nodes"), F.col("x.F0").alias("f0"), F.col("x.F0Range").alias("f0_range"),
    )


def known_calls(spark: SparkSession, path: str) -> DataFrame:
    """species, calls of lines "species > call"."""
    parts = F.split("value", " > ")
    return spark.read.option("recursiveFileLookup", "true").text(path).where(F.size(parts) == 2).groupBy(F.trim(parts[0]).alias("species")).agg(F.array_sort(F.collect_set(F.trim(parts[1]))).alias("calls"))


def last_position(spark: SparkSession, path: str) -> DataFrame:
    """file_id, lat, long: the last GPS line of each recorder's log."""
    lines = folders.texts(spark, path, "*").select("file_id", F.posexplode(F.split("value", "\r?\n")).alias("at", "value"))
    number = r"(-?\d+\.?\d*)"
    found = lines.withColumn("lat", F.regexp_extract("value", rf"GPS[^:]*:\s*{number}", 1).try_cast("double")).withColumn("long", F.regexp_extract("value", rf"GPS[^:]*:\s*{number}[,\s]+{number}", 2).try_cast("double"))
    return found.where("lat is not null").groupBy("file_id").agg(F.max_by(F.struct("lat", "long"), "at").alias("p")).select("file_id", "p.lat", "p.long")


def not_done(files: DataFrame, log: DataFrame, species: str, settings: str) -> DataFrame:
    """Files that a log(species, settings, path) has not under these settings."""
    done = log.where((F.col("species") == species) & (F.col("settings") == settings)).select("path")
    return files.join(done, "path", "left_anti")


def from_sheet(rows: DataFrame, species: Column, calltype: Column | None = None) -> DataFrame:
    """file_id, seg_id, s, e, f_lo, f_hi, labels of a sheet's rows(file_id, row, start, end, low, high): certain labels, made by hand.

    Rows without a start or an end are left out; a call type that is null or empty is none. "Other" is no species and "Add" no
    call type: they raise.
    """
    kind = F.lit(None).cast("string") if calltype is None else F.when(calltype != "", calltype)
    bad = F.when(species == "Other", F.raise_error(F.lit("species cannot be 'Other'"))).when(kind == "Add", F.raise_error(F.lit("calltype cannot be 'Add'"))).otherwise(species)
    own = label(bad.cast("string"), F.lit(100.0), kind, F.lit("M"))
    number = lambda c: F.col(c).try_cast("double")
    good = rows.withColumns({"s": number("start"), "e": number("end")}).where("s is not null and e is not null")
    return good.select("file_id", F.col("row").alias("seg_id"), "s", "e", number("low").cast("int").alias("f_lo"), number("high").cast("int").alias("f_hi"), F.array(own).alias("labels"))

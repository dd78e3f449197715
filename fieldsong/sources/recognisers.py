"""Recogniser files written, with the network block that training adds, and the lists that settings name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsong.sources import folders

#: Fixed value: a short list of species holds so many.
SHORT_LIST = 29


def recogniser_text(filters: DataFrame, networks: DataFrame | None = None) -> DataFrame:
    """file_id (with .txt), value: a recogniser's file from its rows, a row a subfilter, as annotations.read_filters() gives them.

    networks(filter_id, name, window, step, width, height, outputs, thresholds, f_lo, f_hi) adds a network's block: outputs are call
    types in order, to which Noise is added last, and thresholds a pair a call type; without f_lo nothing is masked.
    Subfilters stand in the order of their call types. Recognisers without a network have no block.
    """
    params = F.struct("thr", F.col("m").alias("M"), "win", "nodes")
    sub = F.struct("calltype", F.col("time_range").alias("TimeRange"), F.col("freq_range").alias("FreqRange"), params.alias("WaveletParams"), F.col("f0").alias("F0"), F.col("f0_range").alias("F0Range"))
    head = ["species", F.col("sample_rate").alias("SampleRate"), "method"]
    packed = filters.groupBy("filter_id", "species", "sample_rate", "method").agg(F.array_sort(F.collect_list(F.struct("calltype", sub.alias("x")))).alias("subs"))
    packed = packed.select("filter_id", *head, F.transform("subs", lambda s: s["x"]).alias("Filters"))
    if networks is None:
        return packed.select(F.concat("filter_id", F.lit(".txt")).alias("file_id"), F.to_json(F.struct("species", "SampleRate", "method", "Filters")).alias("value"))
    numbers = F.transform(F.sequence(F.lit(0), F.size("outputs")), lambda k: k.cast("string"))
    named = F.map_from_arrays(numbers, F.concat("outputs", F.array(F.lit("Noise"))))
    block = F.struct(
        F.col("name").alias("NN_name"), F.array("window", "step").alias("windowInc"), F.array(F.col("width").cast("double"), F.col("width") / 5).alias("win"), F.array("height", "width").alias("inputdim"),
        F.when(F.col("f_lo").isNotNull(), F.array("f_lo", "f_hi")).alias("fRange"), named.alias("output"), F.col("thresholds").alias("thr"),
    )
    both = packed.join(networks.select("filter_id", block.alias("NN")), "filter_id", "left")
    return both.select(F.concat("filter_id", F.lit(".txt")).alias("file_id"), F.to_json(F.struct("species", "SampleRate", "method", "Filters", "NN")).alias("value"))


def read_networks(spark: SparkSession, path: str) -> DataFrame:
    """filter_id, name, window, step, outputs (call types without Noise), thresholds, f_lo, f_hi of recogniser files that have a network's block."""
    kind = "NN struct<NN_name: string, windowInc: array<int>, win: array<double>, inputdim: array<int>, fRange: array<int>, output: map<string, string>, thr: array<array<double>>>"
    text = folders.texts(spark, path, "*.txt").withColumn("filter_id", F.regexp_extract("file_id", r"([^/]+)\.txt$", 1))
    n = text.select("filter_id", F.from_json("value", kind)["NN"].alias("n")).where("n.NN_name is not null")
    listed = F.transform(F.array_sort(F.map_entries("n.output"), lambda a, b: a["key"].cast("int") - b["key"].cast("int")), lambda e: e["value"])
    at = lambda c, k: F.get(c, F.lit(k))
    return n.select(
        "filter_id", F.col("n.NN_name").alias("name"), at("n.windowInc", 0).alias("window"), at("n.windowInc", 1).alias("step"), F.filter(listed, lambda x: x != "Noise").alias("outputs"),
        F.col("n.thr").alias("thresholds"), at("n.fRange", 0).alias("f_lo"), at("n.fRange", 1).alias("f_hi"),
    )


def short_list(names: DataFrame, name: str = "name", order: str = "pos") -> DataFrame:
    """pos, name: the first SHORT_LIST different names in order; blanks around them and empty ones go."""
    clean = names.select(F.col(order).alias("pos"), F.trim(name).alias("name")).where("name <> ''")
    return clean.groupBy("name").agg(F.min("pos").alias("pos")).orderBy("pos", "name").limit(SHORT_LIST).select("pos", "name")


def long_name(species: Column, part: Column) -> Column:
    """A species' name in the long list: its group and, in round brackets, its kind; without a kind the group alone."""
    return F.when(part.isNull() | (part == ""), species).otherwise(F.concat(species, F.lit(" ("), part, F.lit(")")))


def split_name(name: Column) -> tuple[Column, Column]:
    """Group and kind of a long list's name, kind null without brackets. A greater-than sign in place of brackets is the old way."""
    old, new = F.split(name, ">"), F.regexp_extract(name, r"^(.*?) \(([^()]*)\)$", 2)
    kind = F.when(F.size(old) == 2, old[1]).when(F.length(new) > 0, new)
    return F.trim(F.when(F.size(old) == 2, old[0]).when(F.length(new) > 0, F.regexp_extract(name, r"^(.*?) \(([^()]*)\)$", 1)).otherwise(name)), F.trim(kind)

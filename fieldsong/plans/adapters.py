"""The driver's tables read as recordings, detections and labels, in Spark and (for the oracle) in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SECONDS = 600.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1000000.0)


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, rec, species, s, e, cert: an event is a detection by its user's recorder, value * 600 s long."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ev = table(spark, sf_dir, "events")
    kind = F.pmod(F.floor("value"), F.lit(4))
    cert = F.when(kind == 0, 0).when(kind == 1, 50).when(kind == 2, 90).otherwise(100)
    start = epoch(F.col("ts"))
    return ev.select(F.col("event_id").alias("ord"), F.col("user_id").alias("rec"), F.col("event_type").alias("species"), start.alias("s"), (start + F.col("value") * SECONDS).alias("e"), cert.alias("cert"))


#: The same in SQL, as the first of the oracle's common table expressions.
DET = """det AS (SELECT event_id AS ord, user_id AS rec, event_type AS species, s, s + value * 600.0 AS e,
  CASE CAST(floor(value) AS BIGINT) % 4 WHEN 0 THEN 0 WHEN 1 THEN 50 WHEN 2 THEN 90 ELSE 100 END AS cert
  FROM (SELECT *, epoch_us(ts) / 1000000.0 AS s FROM events))"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec, day, species sorted, certainties in that order: the labels of a recorder's day."""
    det = detections(spark, sf_dir)
    one = det.groupBy("rec", F.floor(F.col("s") / 86400).cast("long").alias("day"), "species").agg(F.max("cert").cast("double").alias("certainty"))
    none = F.lit(None).cast("string")
    packed = F.array_sort(F.collect_list(F.struct("species", "certainty", none.alias("calltype"), none.alias("filter"))))
    return one.groupBy("rec", "day").agg(packed.alias("labels"))


LABELLED = DET + """, lab1 AS (SELECT rec, CAST(floor(s / 86400) AS BIGINT) AS day, species, CAST(max(cert) AS DOUBLE) AS certainty FROM det GROUP BY ALL),
lab AS (SELECT rec, day, list({'species': species, 'certainty': certainty} ORDER BY species) AS labels FROM lab1 GROUP BY rec, day)"""


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, k, x: the elements of each embedding as the bins of a spectrum."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("k", "x")).withColumn("x", F.col("x").cast("double"))


SPECTRA = """sp AS (SELECT vec_id, label, unnest(range(len(embedding))) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""

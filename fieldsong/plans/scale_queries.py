"""Queries on scaled frames, multitaper spectra and annotation files, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsong.operators import scales
from fieldsong.plans.adapters import DET, SPECTRA, detections, table
from fieldsong.plans.signal_queries import HOP, WIDTH, _signals

HOP_S = 0.008


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen vectors are the frames of a page."""
    e = table(spark, sf_dir, "embeddings").where("embedding is not null")
    mags = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    return e.select(F.expr("vec_id div 16").alias("file_id"), F.lit(0).alias("page"), F.col("vec_id").alias("frame"), mags.alias("mags"))


def _bins(frames: DataFrame) -> DataFrame:
    return frames.select("frame", F.posexplode("mags").alias("k", "m")).withColumn("m", F.round("m", 6))


def decibel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(_pictures(spark, sf_dir).withColumn("mags", scales.decibels(F.col("mags"))))


def compressed_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(_pictures(spark, sf_dir).withColumn("mags", scales.compressed(F.col("mags"))))


def channel_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(_pictures(spark, sf_dir).withColumn("mags", scales.channel_normalised(F.col("mags"), HOP_S)))


def median_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(scales.median_image(_pictures(spark, sf_dir), 5))


def multitaper_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power of each frame, summed over three tapers and all bins."""
    frames = scales.multitaper(_signals(spark, sf_dir), WIDTH, HOP)
    total = F.aggregate("mags", F.lit(0.0), lambda a, m: a + m.cast("double"))
    return frames.select("file_id", "frame", F.round(total, 3).alias("power"))


def duplicates_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections on whole days, where refunds are spelled as purchases."""
    days = detections(spark, sf_dir).withColumn("s", F.floor(F.col("s") / 86400) * 86400.0).withColumn("e", F.ceil(F.col("e") / 86400) * 86400.0)
    spelled = F.when(F.col("species") == "refund", "purchase").otherwise(F.col("species"))
    return scales.without_duplicates(days, ["rec"], spelled).select("ord", "rec", "species", "s", "e")


def empty_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as files, urgent orders as their segments."""
    return scales.empty_files(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("rec")), table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("rec")), ["rec"])


def annotated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings named by customers; those with urgent orders have an annotation file."""
    sound = lambda c: F.concat(F.lit("rec"), c.cast("string"), F.lit(".wav"))
    sounds = table(spark, sf_dir, "customer").select(sound(F.col("c_custkey")).alias("path"))
    return scales.annotated(sounds, table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(sound(F.col("o_custkey")), F.lit(".data")).alias("path")))


def species_of_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' nations by a list of nations that lacks those of one region."""
    tags = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("code"))
    return scales.species_of_codes(tags, table(spark, sf_dir, "nation").where("n_regionkey <> 0").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("species")))


_P = f"{SPECTRA}, p AS (SELECT vec_id AS frame, vec_id // 16 AS file_id, CAST(k AS INT) AS k, abs(x) AS m FROM sp)"
SQL = {
    "decibel_frames": f"WITH {_P} SELECT frame, k, round(abs(10 * log10(m + 1e-7)), 6) AS m FROM p",
    "compressed_frames": f"WITH {_P} SELECT frame, k, round(pow(m, 1 / (1 + exp(1.2))), 6) AS m FROM p",
    "channel_normalised": f"""WITH {_P}, c AS (SELECT 1 - exp(-0.008 / 0.06) AS s),
a AS (SELECT p.frame, p.k, any_value(p.m) AS m, sum(s * pow(1 - s, p.k - q.k) * q.m) AS mean FROM p JOIN p q ON p.frame = q.frame AND q.k <= p.k, c GROUP BY p.frame, p.k)
SELECT frame, k, round(pow(m * pow(1e-6 + mean, -0.8) + 10, 0.25) - pow(10, 0.25), 6) AS m FROM a""",
    "median_image": f"""WITH {_P}, n AS (SELECT *, row_number() OVER (PARTITION BY file_id, k ORDER BY frame) AS i, count(*) OVER (PARTITION BY file_id, k) AS h, count(*) OVER (PARTITION BY frame) AS w FROM p)
SELECT a.frame, a.k, round(CASE WHEN any_value(a.i > 2 AND a.i <= a.h - 2 AND a.k >= 2 AND a.k < a.w - 2) THEN median(b.m) ELSE any_value(a.m) END, 6) AS m
FROM n a JOIN n b ON a.file_id = b.file_id AND abs(a.i - b.i) <= 2 AND abs(a.k - b.k) <= 2 GROUP BY a.frame, a.k""",
    "duplicates_removed": f"""WITH {DET}, m AS (SELECT ord, rec, CASE WHEN species = 'refund' THEN 'purchase' ELSE species END AS species, floor(s / 86400) * 86400.0 AS s, ceil(e / 86400) * 86400.0 AS e FROM det)
SELECT min(ord) AS ord, rec, species, CAST(s AS DOUBLE) AS s, CAST(e AS DOUBLE) AS e FROM m GROUP BY rec, species, s, e""",
    "empty_files": "SELECT c_custkey AS rec FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')",
    "annotated_files": "SELECT 'rec' || c_custkey || '.wav' AS path FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')",
    "species_of_codes": "SELECT c_custkey, c_nationkey AS code, coalesce(n_name, 'Don''t Know') AS species FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_regionkey <> 0",
}
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

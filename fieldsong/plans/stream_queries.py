"""Streams of detections: the events table as a file stream, worked off to its end into a table that is read back.

A window or session is out once the watermark has passed its end, an hour behind the latest event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsong.plans.adapters import DET, SECONDS
from fieldsong.sources.scratch import new_folder
from fieldsong.streaming import detections as streams


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ord, rec, species, ts, e_ts, cert as a stream."""
    path = f"{sf_dir}/events.parquet"
    # A pattern, as a stream takes only folders or patterns, and the table may be one file.
    ev = streams.read(spark, f"{sf_dir}/events.parque[t]", spark.read.parquet(path).schema)
    kind = F.pmod(F.floor("value"), F.lit(4))
    cert = F.when(kind == 0, 0).when(kind == 1, 50).when(kind == 2, 90).otherwise(100)
    ts = F.col("ts").cast("timestamp")
    end = F.timestamp_micros((F.unix_micros(ts) + F.floor(F.col("value") * SECONDS * 1_000_000)).cast("long"))
    return ev.select(F.col("event_id").alias("ord"), F.col("user_id").alias("rec"), F.col("event_type").alias("species"), ts.alias("ts"), end.alias("e_ts"), cert.alias("cert"))


def _worked_off(stream: DataFrame) -> DataFrame:
    spark, folder = stream.sparkSession, new_folder(stream.sparkSession)
    streams.append_to(stream, f"{folder}/out", f"{folder}/progress").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _at(name: str):
    return F.unix_micros(name).alias(name)


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _worked_off(streams.binned(_stream(spark, sf_dir), "1 day"))
    return out.select("rec", "species", _at("start"), _at("end"), "max_cert", "n")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _worked_off(streams.binned(_stream(spark, sf_dir), "12 hours", "6 hours"))
    return out.select("rec", "species", _at("start"), _at("end"), "max_cert", "n")


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections at most an hour apart as one."""
    out = _worked_off(streams.joined(_stream(spark, sf_dir), 3600.0))
    return out.select("rec", "species", _at("start"), _at("end"), F.round("cert", 6).alias("cert"), "pieces")


def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event once, though the stream has all of them twice."""
    one = _stream(spark, sf_dir)
    return _worked_off(streams.distinct(one.unionByName(one), ["ord"])).select("ord", "rec", "species")


def stream_intermittent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections that start in the first ten minutes of an hour."""
    return _worked_off(streams.intermittent(_stream(spark, sf_dir), 600, 3600)).select("ord", "rec", "species")


_WINDOWS = """WITH {det}, w AS (SELECT rec, species, cert, unnest(range(CAST(floor((s - {width} + {step}) / {step}) AS BIGINT), CAST(floor(s / {step}) AS BIGINT) + 1)) * {step} AS start FROM det),
last AS (SELECT max(s) - 3600 AS mark FROM det)
SELECT rec, species, start * 1000000 AS start, (start + {width}) * 1000000 AS "end", max(cert) AS max_cert, count(*) AS n FROM w CROSS JOIN last WHERE start + {width} <= mark GROUP BY rec, species, start"""

SQL: dict[str, str] = {
    "stream_tumbling": _WINDOWS.format(det=DET, width=86400, step=86400),
    "stream_sliding": _WINDOWS.format(det=DET, width=43200, step=21600),
    "stream_sessions": """WITH d AS (SELECT event_id AS ord, user_id AS rec, event_type AS species, epoch_us(ts) AS s, epoch_us(ts) + CAST(floor(value * 600.0::DOUBLE * 1000000) AS BIGINT) AS e,
  CASE CAST(floor(value) AS BIGINT) % 4 WHEN 0 THEN 0 WHEN 1 THEN 50 WHEN 2 THEN 90 ELSE 100 END AS cert FROM events),
p AS (SELECT *, max(e) OVER (PARTITION BY rec, species ORDER BY s, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM d),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY rec, species ORDER BY s, ord ROWS UNBOUNDED PRECEDING) AS island FROM p)
SELECT rec, species, min(s) AS start, max(e) AS "end", round(avg(cert), 6) AS cert, count(*) AS pieces FROM i GROUP BY rec, species, island HAVING max(e) + 3600000000 <= (SELECT max(s) - 3600000000 FROM d)""",
    "stream_distinct": "SELECT event_id AS ord, user_id AS rec, event_type AS species FROM events",
    "stream_intermittent": "SELECT event_id AS ord, user_id AS rec, event_type AS species FROM events WHERE CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) % 3600 < 600",
}
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}

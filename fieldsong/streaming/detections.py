"""Detections as a stream: bins, sessions and duplicates with watermarks, resumed from a checkpoint.

Input is a folder of Parquet files of detections (ord, rec, species, ts, e_ts, cert) that grows; availableNow
works off what is there and stops, which is what a resumed batch run does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LATE = "1 hour"


def read(spark: SparkSession, path: str, schema: StructType | str, files_at_once: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def binned(stream: DataFrame, width: str, slide: str | None = None, late: str = LATE) -> DataFrame:
    """rec, species, start, end, max_cert, n of tumbling windows, or of sliding ones."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    out = stream.withWatermark("ts", late).groupBy("rec", "species", window.alias("w")).agg(F.max("cert").alias("max_cert"), F.count(F.lit(1)).alias("n"))
    return out.select("rec", "species", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "max_cert", "n")


def joined(stream: DataFrame, gap_seconds: float, late: str = LATE) -> DataFrame:
    """Detections at most gap_seconds apart as one, with mean certainty: sessions whose gap is each row's length and the gap."""
    gap = F.concat((F.unix_micros("e_ts") - F.unix_micros("ts") + int(gap_seconds * 1e6)).cast("string"), F.lit(" microseconds"))
    session = F.session_window("ts", gap)
    out = stream.withWatermark("ts", late).groupBy("rec", "species", session.alias("w")).agg(F.min("ts").alias("start"), F.max("e_ts").alias("end"), F.avg("cert").alias("cert"), F.count(F.lit(1)).alias("pieces"))
    return out.drop("w")


def distinct(stream: DataFrame, key: list[str], late: str = LATE) -> DataFrame:
    """Each detection once, though files may repeat it, within the watermark."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def intermittent(stream: DataFrame, length: int, interval: int) -> DataFrame:
    """Detections that start in the first length seconds of every interval."""
    return stream.where(F.pmod(F.unix_seconds("ts"), F.lit(interval)) < length)


def append_to(stream: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Work off all files there are, exactly once, into a Parquet table."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()

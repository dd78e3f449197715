"""Recordings split into pieces of equal length, the clock in their names moved on."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsong.sources import audio

#: The pieces' lengths in seconds.
SHORTEST, LONGEST = 1, 36000


def piece_names(recordings: DataFrame, seconds: int) -> DataFrame:
    """name, piece, piece_name of recordings(name, seconds) cut every so many seconds.

    A name that ends with yyyymmdd_hhmmss before its ending gets the time of the piece's start, on a clock that knows no
    summer time; other names get the piece's number. Recordings without seconds have no pieces.
    """
    if not SHORTEST <= seconds <= LONGEST:
        raise ValueError(f"pieces are {SHORTEST} to {LONGEST} seconds long")
    n = F.ceil(F.col("seconds") / seconds).cast("int")
    each = recordings.where(n > 0).withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    stem, ending = F.regexp_extract("name", r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract("name", r"(\.[^.]*)$", 1)
    text = F.regexp_extract(stem, r"(\d{8}_\d{6})$", 1)
    # Whole seconds on a clock without zones: the time in the name, taken apart and put together again.
    part = lambda a, b: F.substring(text, a, b).try_cast("int")
    day = F.unix_date(F.try_to_date(F.substring(text, 1, 8), "yyyyMMdd"))
    at = day.cast("long") * 86400 + part(10, 2) * 3600 + part(12, 2) * 60 + part(14, 2) + F.col("piece") * seconds
    date = F.date_format(F.date_from_unix_date(F.floor(at / 86400).cast("int")), "yyyyMMdd")
    rest = F.pmod(at, F.lit(86400))
    two = lambda v: F.lpad(F.floor(v).cast("string"), 2, "0")
    clock = F.concat(date, F.lit("_"), two(rest / 3600), two(rest % 3600 / 60), two(rest % 60))
    named = F.when(at.isNotNull(), F.concat(F.expr("left(stem, length(stem) - 15)"), clock)).otherwise(F.concat("stem", F.lit("_"), F.col("piece")))
    return each.withColumn("stem", stem).select("name", "piece", F.concat(named, ending).alias("piece_name"))


def wav_piece(raw: bytes, channels: int, rate: int, bits: int) -> bytes:
    """A WAV file of frames as they are, all channels kept."""
    frame = channels * bits // 8
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * frame, frame, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(raw)) + raw


def _cut(placed: DataFrame) -> DataFrame:
    """name, content of rows(piece_name, file_id, at, n_bytes, channels, fs, bits)."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for r in x.itertuples(index=False):
                with audio.opened(r.file_id) as f:
                    raw = audio.reader(f)(int(r.at), int(r.n_bytes))
                yield pd.DataFrame({"name": [r.piece_name], "content": [wav_piece(raw, int(r.channels), int(r.fs), int(r.bits))]})

    return placed.mapInPandas(cut, "name string, content binary")


def first_seconds(found: DataFrame, seconds: int = 60) -> DataFrame:
    """name, content of the first minute, or so many seconds, of each WAV file, all of it if it is shorter; only that part is read."""
    first = audio.page_ranges(found.select("path"), 0.0, seconds_long=seconds).where("page = 0")
    return _cut(first.withColumn("piece_name", F.regexp_extract("file_id", r"([^/]+)$", 1)).select("piece_name", "file_id", "at", "n_bytes", "channels", "fs", "bits"))


def pieces(found: DataFrame, seconds: int) -> DataFrame:
    """name, content of the pieces of WAV files (audio.files()), cut by their places in the files; see piece_names() for the names.

    A last piece holds what is left. What is saved with audio.saved() is a folder of files that can be read as any other.
    """
    ranges = audio.page_ranges(found.select("path"), 0.0, seconds_long=seconds)
    base = F.regexp_extract("file_id", r"([^/]+)$", 1)
    names = piece_names(ranges.select(base.alias("name"), ((F.col("start_sample") + F.col("n_frames")) / F.col("fs")).alias("seconds")).groupBy("name").agg(F.max("seconds").alias("seconds")), seconds)
    placed = ranges.withColumn("name", base).join(names.withColumnRenamed("piece", "page"), ["name", "page"]).select("piece_name", "file_id", "at", "n_bytes", "channels", "fs", "bits")
    return _cut(placed)

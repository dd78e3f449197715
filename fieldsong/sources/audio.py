"""WAV files as rows: a table of recordings from their headers, and pages of samples as the unit of parallel work."""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

PAGE_SAMPLES, SLOW_PAGE_SECONDS, SLOW_RATE = 900 * 16000, 300, 4000
LEAST_BYTES = 1000
#: Bytes that follow a file's content are written so many at once.
BLOCK = 1 << 20
HEADER = "struct<channels: int, rate: int, bits: int, data_at: long, data_bytes: long>"


def files(spark: SparkSession, path: str, glob: str = "*.wav") -> DataFrame:
    """Files below a folder with their content; only names and sizes are read unless content is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def is_valid() -> Column:
    """Whether a file of files() or folders.heads() has 1000 bytes at least and begins as RIFF, FLAC or BMP files do."""
    head = F.substring("content", 1, 4)
    return (F.col("length") >= LEAST_BYTES) & (head.isin(bytearray(b"RIFF"), bytearray(b"fLaC")) | (F.substring("content", 1, 2) == F.lit(bytearray(b"BM"))))


def valid(found: DataFrame) -> DataFrame:
    """Files that is_valid() takes."""
    return found.where(is_valid())


def walk_header(size: int, read: Callable[[int, int], bytes]) -> tuple[int, int, int, int, int] | None:
    """channels, rate, bits, where the samples start and how many bytes of whole frames they have; null if it is no PCM WAV.

    read(at, n) gives n bytes of the file, fewer at its end. Only chunk heads are read. Recordings that stop early, whose
    data size was never filled in, or whose sizes go beyond 4 GB (RF64) have what is in the file; a chunk that is cut short
    ends the walk.
    """
    head = read(0, 12)
    if head[:4] not in (b"RIFF", b"RF64") or head[8:12] != b"WAVE":
        return None
    at, fmt, long_size = 12, None, None
    while len(chunk := read(at, 8)) == 8:
        name, n = chunk[:4], struct.unpack("<I", chunk[4:])[0]
        if name == b"fmt ":
            if n < 16 or len(body := read(at + 8, 16)) < 16:
                return None
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body)
            fmt = (channels, rate, bits) if kind in (1, 0xFFFE) and channels and rate and bits in (8, 16, 24, 32) else None
        elif name == b"ds64" and len(body := read(at + 8, 16)) == 16:
            long_size = struct.unpack("<Q", body[8:])[0]
        elif name == b"data":
            if fmt is None:
                return None
            there = max(0, size - at - 8)
            n = there if n == 0 else min(long_size if n == 0xFFFFFFFF and long_size is not None else n, there)
            frame = fmt[0] * fmt[2] // 8
            return (*fmt, at + 8, n // frame * frame)
        at += 8 + n + n % 2
    return None


def parse_header(content: bytes) -> tuple[int, int, int, int, int] | None:
    """walk_header() of a file in memory."""
    return walk_header(len(content), lambda at, n: content[at : at + n])


def decode(raw: bytes, bits: int, channels: int) -> np.ndarray:
    """The left channel as whole numbers, not scaled: 8 bits unsigned, 16, 24 and 32 signed. A frame that is cut short is left out."""
    width = bits // 8
    raw = raw[: len(raw) // (width * channels) * width * channels]
    if width == 3:
        three = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        flat = (three[:, 0] << 8 | three[:, 1] << 16 | three[:, 2] << 24) >> 8
    else:
        flat = np.frombuffer(raw, {1: "u1", 2: "<i2", 4: "<i4"}[width])
    return flat[::channels].astype(np.float64)


def encode(samples: np.ndarray, bits: int = 16) -> bytes:
    """Whole numbers, clipped to what bits hold."""
    low, high = (0, 255) if bits == 8 else (-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
    x = np.clip(np.trunc(np.asarray(samples)), low, high).astype(np.int64)
    if bits == 24:
        return x.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return x.astype({8: "u1", 16: "<i2", 32: "<i4"}[bits]).tobytes()


def wav_bytes(samples: np.ndarray, rate: int, bits: int = 16) -> bytes:
    raw = encode(samples, bits)
    fmt = struct.pack("<HHIIHH", 1, 1, rate, rate * bits // 8, bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(raw)) + raw


def recordings(found: DataFrame) -> DataFrame:
    """path, length, channels, rate, bits, duration of each WAV; other files have nulls."""

    def probe(contents: pd.Series) -> pd.DataFrame:
        rows = [parse_header(bytes(c)) or (None,) * 5 for c in contents]
        return pd.DataFrame(rows, columns=["channels", "rate", "bits", "data_at", "data_bytes"]).astype("Int64")

    seen = found.withColumn("head", F.pandas_udf(probe, HEADER)("content"))
    frame = F.col("head.channels") * F.col("head.bits") / 8
    return seen.select("path", "length", "head.channels", "head.rate", "head.bits", (F.col("head.data_bytes") / frame / F.col("head.rate")).alias("duration"))


def page_samples(rate: int) -> int:
    return SLOW_PAGE_SECONDS * rate if rate <= SLOW_RATE else PAGE_SAMPLES


def pages(found: DataFrame, least_seconds: float = 2.0, length: int | None = None) -> DataFrame:
    """file_id, page, start_sample, fs, samples: recordings cut in pages of 15 minutes at 16 kHz (or of so many samples).

    A last page under least_seconds is left out. One page is decoded at a time.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for path, content in zip(x["path"], x["content"]):
                head = parse_header(bytes(content))
                if head is None:
                    continue
                channels, rate, bits, at, size = head
                step = (length or page_samples(rate)) * channels * bits // 8
                for n, a in enumerate(range(0, size, step)):
                    samples = decode(bytes(content[at + a : at + min(a + step, size)]), bits, channels)
                    if len(samples) >= least_seconds * rate:
                        yield pd.DataFrame({"file_id": [path], "page": [n], "start_sample": [n * step // (channels * bits // 8)], "fs": [rate], "samples": [samples]})

    return found.select("path", "content").mapInPandas(cut, "file_id string, page int, start_sample long, fs int, samples array<double>")


def opened(path: str):
    """A file that can be read from any place: local, or in a store that pyarrow knows by the path's scheme (s3, gs, hdfs and others)."""
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return store.open_input_file(inner)


def reader(f) -> Callable[[int, int], bytes]:
    def read(at: int, n: int) -> bytes:
        f.seek(min(at, f.size()))
        return f.read(n)

    return read


def page_ranges(found: DataFrame, least_seconds: float = 2.0, length: int | None = None, seconds_long: int | None = None) -> DataFrame:
    """file_id, page, start_sample, fs, n_frames, at, n_bytes, channels, bits: where in its file each page lies.

    Only the heads of chunks are read, whatever the size of a file. Files that are no PCM WAV have no pages; what ends
    within a frame loses that frame. A last page under least_seconds is left out. Pages have `length` samples, or are
    seconds_long, or as page_samples() says.
    """

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for path in x["path"]:
                with opened(path) as f:
                    head = walk_header(f.size(), reader(f))
                if head:
                    rows.append((path, *head))
            yield pd.DataFrame(rows, columns=["file_id", "channels", "fs", "bits", "data_at", "data_bytes"])

    heads = found.select("path").mapInPandas(probe, "file_id string, channels int, fs int, bits int, data_at long, data_bytes long")
    step = F.lit(length).cast("long") if length else (F.col("fs") * seconds_long).cast("long") if seconds_long else F.when(F.col("fs") <= SLOW_RATE, SLOW_PAGE_SECONDS * F.col("fs")).otherwise(F.lit(PAGE_SAMPLES)).cast("long")
    frame = (F.col("channels") * F.col("bits") / 8).cast("long")
    sized = heads.withColumns({"step": step, "frame": frame}).withColumn("frames", F.expr("data_bytes div frame")).where("frames > 0")
    cut = sized.withColumn("page", F.explode(F.expr("sequence(0, cast((frames - 1) div step as int))"))).withColumn("start_sample", F.col("page") * F.col("step"))
    cut = cut.withColumn("n_frames", F.least("step", F.col("frames") - F.col("start_sample"))).where(F.col("n_frames") >= least_seconds * F.col("fs"))
    return cut.select("file_id", "page", "start_sample", "fs", "n_frames", (F.col("data_at") + F.col("start_sample") * F.col("frame")).alias("at"), (F.col("n_frames") * F.col("frame")).alias("n_bytes"), "channels", "bits")


def read_ranges(ranges: DataFrame) -> DataFrame:
    """file_id, page, start_sample, fs, samples of page_ranges(): each page's bytes are read by themselves, one page at a time."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for r in x.itertuples(index=False):
                with opened(r.file_id) as f:
                    samples = decode(reader(f)(int(r.at), int(r.n_bytes)), int(r.bits), int(r.channels))
                yield pd.DataFrame({"file_id": [r.file_id], "page": [r.page], "start_sample": [r.start_sample], "fs": [r.fs], "samples": [samples]})

    return ranges.mapInPandas(read, "file_id string, page int, start_sample long, fs int, samples array<double>")


def ranged_pages(found: DataFrame, least_seconds: float = 2.0, length: int | None = None, parts: int | None = None) -> DataFrame:
    """pages() of files of any size, where pages() has whole files in a row.

    found: files(), of which only paths are used. The pages, not the files, are dealt over partitions (as many as
    shuffles have, or `parts`), so that a long recording is read by many tasks; a lost executor costs the pages that it held.
    """
    ranges = page_ranges(found, least_seconds, length)
    return read_ranges(ranges.repartition(parts, "file_id", "page") if parts else ranges.repartition("file_id", "page"))


def wav_column(samples: Column, rate: int, bits: int = 16) -> Column:
    """A column of WAV files, for a Parquet table or a file sink."""

    def make(columns: pd.Series) -> pd.Series:
        return columns.map(lambda x: None if x is None else wav_bytes(x, rate, bits))

    return F.pandas_udf(make, BinaryType())(samples)


def saved(rows: DataFrame, folder: str, spread: int = 1) -> DataFrame:
    """path, length of files written below a folder that all executors share: rows(name, content).

    A file is written beside its place and moved there, so that a task that is run again leaves whole files. Names with
    a folder in them, or null, and null contents are left out. With `spread` over 1 so many tasks write, and the files
    lie in so many subfolders by a hash of their names. Where rows have a `length`, the file is that long if its content is shorter: bytes 0
    follow, which a local or mounted store keeps as a hole and other stores get a block at a time.
    """
    root = re.sub(r"^file:/+", "file:///", folder.rstrip("/"))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(root)
        made = set()
        for x in batches:
            out = []
            for name, content, least in zip(x["name"], x["content"], x["length"]):
                below = f"/{zlib.crc32(name.encode()) % spread:03d}" if spread > 1 else ""
                if below not in made:
                    store.create_dir(inner + below, recursive=True)
                    made.add(below)
                aside = f"{inner}{below}/.{name}.{uuid.uuid4().hex}"
                size = max(len(content), int(least))
                with store.open_output_stream(aside) as f:
                    f.write(bytes(content))
                    if not isinstance(store, fs.LocalFileSystem):
                        for at in range(len(content), size, BLOCK):
                            f.write(bytes(min(BLOCK, size - at)))
                if isinstance(store, fs.LocalFileSystem) and size > len(content):
                    os.truncate(aside, size)
                store.move(aside, f"{inner}{below}/{name}")
                out.append((f"{root}{below}/{name}", size))
            yield pd.DataFrame(out, columns=["path", "length"])

    good = rows.where("name is not null and content is not null and not contains(name, '/')")
    least = F.coalesce("length", F.lit(0)) if "length" in rows.columns else F.lit(0)
    whole = good.select("name", "content", least.cast("long").alias("length"))
    return (whole.repartition(spread, "name") if spread > 1 else whole).mapInPandas(put, "path string, length long")


def clips(paged: DataFrame, segments: DataFrame, margin: float = 0.0) -> DataFrame:
    """segments(file_id, page, s, e) with their samples, margin seconds more on either side."""
    both = paged.join(segments, ["file_id", "page"])
    first = F.greatest(F.lit(0), F.floor((F.col("s") - margin) * F.col("fs"))).cast("int")
    last = F.least(F.size("samples"), F.ceil((F.col("e") + margin) * F.col("fs")).cast("int"))
    return both.where(last > first).withColumn("clip", F.slice("samples", first + 1, last - first)).drop("samples")

"""Media columns: texts as WAV recordings, and fingerprints of their spectral peaks.

The wave module writes and reads the recordings. A short-time Fourier transform gives the strongest bin of each
band in each frame; bins that stand out from their frame and top the frames before and after are peaks. Each
peak is paired with the next few, and a pair (two bins and the frames between them) is stored with its time.
"""

from __future__ import annotations

import io
import wave
import zlib
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = 64
RATE = 8000
FRAME, HOP = 256, 128
#: First bins of the bands, which end at the highest bin.
BANDS = (1, 5, 13, 37)
#: A peak has this many times the mean magnitude of its frame.
STANDS_OUT = 2.0
FAN_OUT, FARTHEST = 4, 63
BLOCK_FRAMES = 4096

FEATURES = "struct<payload_bytes: long, payload_sha256: string, tail_crc32: long, frames: int, pair: array<int>, pair_frame: array<int>>"


def payload_of(text: str | None) -> bytes:
    """The text's UTF-8 bytes, filled up with zero bytes to a positive multiple of 64."""
    data = (text or "").encode()
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b"\0")


def to_wav(payload: bytes) -> bytes:
    """8-bit mono samples, one a byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def whole_frames(samples: np.ndarray) -> np.ndarray:
    """8-bit samples with silence after them, up to a whole number of hops, so that every sample is in a frame."""
    short = max(FRAME - len(samples), -(len(samples) - FRAME) % HOP)
    return np.concatenate([samples, np.full(short, 128, np.uint8)])


def band_peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Frames and bins of the peaks, in order of time, and the number of frames."""
    sound = samples.astype(np.float32) - 128
    if len(sound) < FRAME:
        sound = np.concatenate([sound, np.zeros(FRAME - len(sound), np.float32)])
    window = np.hanning(FRAME).astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(sound, FRAME)[::HOP]
    best = np.empty((len(frames), len(BANDS)), np.int16)
    level = np.empty((len(frames), len(BANDS)), np.float32)
    mean = np.empty(len(frames), np.float32)
    ends = [*BANDS[1:], FRAME // 2 + 1]
    for a in range(0, len(frames), BLOCK_FRAMES):
        size = np.abs(np.fft.rfft(frames[a : a + BLOCK_FRAMES] * window, axis=1))
        here = slice(a, a + len(size))
        mean[here] = size[:, BANDS[0] :].mean(axis=1)
        for k, (lo, hi) in enumerate(zip(BANDS, ends)):
            at = size[:, lo:hi].argmax(axis=1)
            best[here, k] = at + lo
            level[here, k] = size[np.arange(len(size)), at + lo]
    around = np.full((len(frames) + 2, len(BANDS)), -1, np.float32)
    around[1:-1] = level
    stands = (level > STANDS_OUT * mean[:, None]) & (level > around[:-2]) & (level >= around[2:])
    frame, band = np.nonzero(stands)
    return frame, best[frame, band].astype(np.int64), len(frames)


def peak_pairs(frame: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of pairs of peaks (bin, bin, frames between) and the frame of each pair's first peak, by time."""
    codes, times, firsts = [], [], []
    for k in range(1, FAN_OUT + 1):
        apart = frame[k:] - frame[:-k]
        near = np.flatnonzero((apart >= 1) & (apart <= FARTHEST))
        codes.append(bins[near] << 15 | bins[near + k] << 6 | apart[near])
        times.append(frame[near])
        firsts.append(near)
    order = np.argsort(np.concatenate(firsts), kind="stable")
    return np.concatenate(codes)[order].astype(np.int32), np.concatenate(times)[order].astype(np.int32)


def wav_column(text: Column) -> Column:
    """A text column as WAV files. Null texts are as empty ones; each text is stored whole."""

    def store(texts: pa.Array) -> pa.Array:
        return pa.array([to_wav(payload_of(t.as_py())) for t in texts], pa.binary())

    return F.arrow_udf(store, "binary")(text)


def wav_features(media: Column) -> Column:
    """What the stored WAV files say when read back: payload digests, and peak pairs as time-coded arrays.

    Null files give null.
    """

    def read(files: pa.Array) -> pa.Array:
        rows = []
        for f in files:
            if f.as_py() is None:
                rows.append(None)
                continue
            payload = from_wav(f.as_py())
            frame, bins, n = band_peaks(whole_frames(np.frombuffer(payload, np.uint8)))
            pair, at = peak_pairs(frame, bins)
            rows.append((len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), n, pair, at))
        kinds = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("frames", pa.int32())]
        flat = [pa.array([None if r is None else r[k] for r in rows], kind) for k, (_, kind) in enumerate(kinds)]
        for k, name in ((4, "pair"), (5, "pair_frame")):
            parts = [np.empty(0, np.int32) if r is None else r[k] for r in rows]
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            flat.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32))))
            kinds.append((name, flat[-1].type))
        return pa.StructArray.from_arrays(flat, names=[n for n, _ in kinds], mask=pa.array([r is None for r in rows], pa.bool_()))

    return F.arrow_udf(read, FEATURES)(media)


def add_media(docs: DataFrame, text: str = "text", media: str = "media", features: str = "media_features") -> DataFrame:
    """docs with the WAV file of each text and what is read back from it; columns of these names are replaced.

    Equal texts have equal files and features. An empty table stays empty.
    """
    stored = docs.withColumn(media, wav_column(F.col(text)))
    return stored.withColumn(features, wav_features(F.col(media)))


def media_digests(docs: DataFrame) -> DataFrame:
    """doc_id and the digests of each row's WAV file: feature names its frames, its pairs and their hash."""
    got = add_media(docs.select("doc_id", F.col("text")))
    text_of = lambda x: F.array_join(x.cast("array<string>"), ",")
    seen, pair, at = F.col("media_features"), F.col("media_features.pair"), F.col("media_features.pair_frame")
    coded = F.sha2(F.concat_ws(";", text_of(pair), text_of(at)).cast("binary"), 256)
    return got.select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        *[seen[c].alias(c) for c in ("payload_bytes", "payload_sha256", "tail_crc32")],
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", seen["frames"].cast("string"), F.size(pair).cast("string"), coded).alias("feature"),
    )

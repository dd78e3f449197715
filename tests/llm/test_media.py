import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from fieldsong.llm import media


def test_round_trip_of_odd_texts(odd, odd_rows):
    rows = media.media_digests(odd).collect()
    assert len(rows) == len(odd_rows)
    text_of = {}
    for i, t, *_ in odd_rows:
        text_of.setdefault(i, []).append((t or "").encode())
    for r in rows:
        ok = False
        for b in text_of[r.doc_id]:
            p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
            ok |= (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p) + 44)
        assert ok
    one = {r.feature for r in rows if r.doc_id in (1, 2)}
    assert len(one) == 1


def test_peaks_of_tones_are_found():
    t = np.arange(8000) / 8000
    sound = 128 + 60 * np.sin(2 * np.pi * 1000 * t) * (np.sin(2 * np.pi * 4 * t) > 0)
    frame, bins, n = media.band_peaks(sound.astype(np.uint8))
    assert n == (8000 - media.FRAME) // media.HOP + 1
    assert abs(np.median(bins) - 1000 * media.FRAME / 8000) <= 1
    pair, at = media.peak_pairs(frame, bins)
    assert len(pair) == len(at) and (np.diff(at) >= 0).all()


def test_blocks_do_not_change_features(monkeypatch):
    x = np.random.default_rng(0).integers(0, 256, 40_000).astype(np.uint8)
    whole = media.band_peaks(x)
    monkeypatch.setattr(media, "BLOCK_FRAMES", 7)
    parts = media.band_peaks(x)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))


def test_empty(none):
    assert media.media_digests(none).count() == 0


def test_every_byte_is_in_a_frame(spark):
    texts = ["x" * n for n in (1, 256, 257, 320, 321, 449, 4032)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", media.wav_features(media.wav_column(F.col("text"))).alias("f"))
    for r in df.collect():
        assert r.f.frames == 1 + max(0, -(-(r.f.payload_bytes - 256) // 128))
    loud = np.where(np.arange(320) >= 256, 128 + 100 * np.sin(2 * np.pi * np.arange(320) / 8), 128).astype(np.uint8)
    assert len(media.band_peaks(media.whole_frames(loud))[0]) > 0

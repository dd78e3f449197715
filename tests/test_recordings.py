"""Recordings that are long, cut short or damaged, and pages read from their places in files."""

import struct

import numpy as np

from fieldsong.operators import cleaning, signal, wavelets
from fieldsong.sources import audio


def header(data_bytes, rate=16000, bits=16, channels=1, name=b"RIFF", fmt_bytes=16, extra=b""):
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)[:fmt_bytes]
    return name + struct.pack("<I", 0) + b"WAVE" + extra + b"fmt " + struct.pack("<I", fmt_bytes) + fmt + b"data" + struct.pack("<I", data_bytes)


def test_damaged_headers():
    raw = np.arange(101, dtype="<i2").tobytes()
    assert audio.parse_header(header(202) + raw) == (1, 16000, 16, 44, 202)
    assert audio.parse_header(header(202) + raw[:-1])[4] == 200  # a frame that is cut short is left out
    assert audio.parse_header(header(0) + raw)[4] == 202  # the size was never filled in
    assert audio.parse_header(header(0xFFFFFFFF) + raw)[4] == 202
    assert audio.parse_header(header(202, fmt_bytes=8) + raw) is None  # a short format chunk
    assert audio.parse_header(header(202)[:30]) is None and audio.parse_header(header(202, bits=12) + raw) is None
    assert audio.parse_header(header(202, rate=0) + raw) is None and audio.parse_header(header(202, channels=0) + raw) is None
    assert audio.parse_header(header(9, channels=2) + raw) == (2, 16000, 16, 44, 8)
    long = b"ds64" + struct.pack("<IQQQI", 28, 0, 202, 101, 0)
    assert audio.parse_header(header(0xFFFFFFFF, name=b"RF64", extra=long) + raw)[4] == 202
    assert list(audio.decode(raw[:5], 16, 1)) == [0, 1] and len(audio.decode(b"", 24, 2)) == 0


def test_one_bad_file_leaves_the_others_rows(spark, tmp_path):
    x = (np.arange(5000) % 200).astype(float)
    good = audio.wav_bytes(x, 1000)
    for name, content in {"good.wav": good, "cut.wav": good[:-1], "head.wav": good[:40], "short.wav": b"RIFF", "empty.wav": b"", "none.wav": good[:44], "other.wav": b"x" * 3000}.items():
        (tmp_path / name).write_bytes(content)
    found = audio.files(spark, str(tmp_path))
    for pages in (audio.pages(found, 0.0, 2000), audio.ranged_pages(found, 0.0, 2000)):
        rows = sorted((r.file_id.rsplit("/", 1)[1], r.page, r.start_sample, len(r.samples), r.samples[0]) for r in pages.collect())
        assert rows == [("cut.wav", 0, 0, 2000, 0), ("cut.wav", 1, 2000, 2000, 0), ("cut.wav", 2, 4000, 999, 0), ("good.wav", 0, 0, 2000, 0), ("good.wav", 1, 2000, 2000, 0), ("good.wav", 2, 4000, 1000, 0)]
    assert {r.path.rsplit("/", 1)[1]: r.duration for r in audio.recordings(found).collect()}["cut.wav"] == 4.999
    assert audio.ranged_pages(found, 4.5).count() == 2 and audio.ranged_pages(found, 5.5).count() == 0


def test_a_recording_over_two_gigabytes(spark, tmp_path):
    """A sparse file with three samples near its end: pages are listed and read though no row could hold the file."""
    size = 2_300_000_000
    with open(tmp_path / "long.wav", "wb") as f:
        f.write(header(size))
        f.seek(44 + size - 2000)
        f.write(struct.pack("<hhh", 7, 8, 9))
        f.truncate(44 + size)
    found = audio.files(spark, str(tmp_path))
    ranges = audio.page_ranges(found)
    listed = {r.page: r for r in ranges.collect()}
    assert len(listed) == 80 and listed[79].start_sample == 79 * audio.PAGE_SAMPLES and sum(r.n_bytes for r in listed.values()) == size
    last = audio.read_ranges(ranges.where("page = 79")).first()
    assert len(last.samples) == size // 2 - 79 * audio.PAGE_SAMPLES and last.samples[-1000:-996] == [7, 8, 9, 0]
    assert audio.ranged_pages(found, parts=16).rdd.getNumPartitions() == 16


def test_files_are_saved_whole(spark, tmp_path):
    rows = spark.createDataFrame([("a.wav", bytearray(b"one")), ("b.wav", bytearray(b"")), (None, bytearray(b"x")), ("c.wav", None), ("../d.wav", bytearray(b"y"))], "name string, content binary")
    assert sorted((r.path.rsplit("/", 1)[1], r.length) for r in audio.saved(rows, f"file://{tmp_path}/out").collect()) == [("a.wav", 3), ("b.wav", 0)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.wav", "b.wav"] and (tmp_path / "out" / "a.wav").read_bytes() == b"one"


def test_kernels_on_empty_and_tiny_pages(spark):
    pages = spark.createDataFrame([("e", 0, 8000, []), ("t", 0, 8000, [1.0]), ("f", 0, 8000, [float(k % 5) for k in range(600)])], "file_id string, page int, fs int, samples array<double>")
    for made in (
        signal.spectrogram(pages), signal.band_passed(pages, 500, 2000), signal.resampled(pages, 4000), signal.wind_strength(pages), signal.pitch(pages, 64), signal.amplitude_segments(pages, 0.5),
        cleaning.butterworth_passed(pages, 500, 2000), cleaning.impulses_masked(pages), wavelets.denoised(pages, 2, wavelets.daubechies(2)), wavelets.node_energies(pages, [1, 2], 0.01, wavelets.daubechies(2)),
    ):
        got = made.collect()
        assert all(len(r["samples"]) == 0 for r in got if "samples" in r and r["file_id"] == "e")
        assert {r["file_id"] for r in got} <= {"e", "t", "f"}


def test_long_files_cost_their_heads(spark, tmp_path):
    """Files whose end is empty take no room for it, and of files that are found by tasks only the head is read."""
    from fieldsong.sources import folders

    rows = spark.createDataFrame([("a.wav", bytearray(b"RIFFx"), 50_000_000), ("b.bmp", bytearray(b"BMxxxx"), 3), ("c.txt", bytearray(b"RIFF"), 2000), ("d.flac", bytearray(b"none"), 1000)], "name string, content binary, length long")
    assert sorted(r.length for r in audio.saved(rows, f"file://{tmp_path}/out", 4).collect()) == [6, 1000, 2000, 50_000_000]
    (tmp_path / "out/_hidden.wav").write_bytes(b"RIFF")
    (tmp_path / "out/e.wav").write_bytes(b"RIFF" + b"x" * 1000)
    made = next((tmp_path / "out").rglob("a.wav"))
    assert made.stat().st_size == 50_000_000 and made.stat().st_blocks * 512 < 1_000_000
    found = folders.heads(spark, f"file://{tmp_path}/out", "*.{wav,flac,bmp}")
    assert found.inputFiles() == []
    got = {r.path.rsplit("/", 1)[1]: (r.length, bytes(r.content), r.valid) for r in found.withColumn("valid", audio.is_valid()).collect()}
    assert got == {"a.wav": (50_000_000, b"RIFF", True), "b.bmp": (6, b"BMxx", False), "d.flac": (1000, b"none", False), "e.wav": (1004, b"RIFF", True)}

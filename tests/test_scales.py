"""Tapers, multitaper spectra and scaled frames against their definitions."""

import numpy as np
import pytest

from fieldsong.operators import scales, signal


def test_tapers_are_orthonormal_and_concentrated():
    n, w = 64, 2.5
    v = scales.slepian(n, w, 3)
    assert np.allclose(v @ v.T, np.eye(3), atol=1e-9)
    d = np.subtract.outer(np.arange(n), np.arange(n))
    share = np.einsum("ki,ij,kj->k", v, np.sinc(2 * w / n * d) * 2 * w / n, v)
    assert share[0] > share[1] > share[2] > 0.95
    assert np.all(v[0] > 0) and np.allclose(v[0], v[0][::-1]) and np.allclose(v[1], -v[1][::-1])


def test_multitaper_finds_a_tone_and_takes_short_pages(spark):
    t = np.arange(1024) / 8000
    rows = [("tone", 0, 8000, [float(x) for x in np.sin(2 * np.pi * 1000 * t)]), ("short", 0, 8000, [1.0, 2.0]), ("none", 0, 8000, [])]
    got = scales.multitaper(spark.createDataFrame(rows, "file_id string, page int, fs int, samples array<double>"), 256, 128).collect()
    assert {r.file_id for r in got} == {"tone"} and len(got) == 6
    assert all(abs(int(np.argmax(r.mags)) - 32) <= 2 and len(r.mags) == 128 for r in got)


def test_spectrogram_of_empty_pages(spark):
    pages = spark.createDataFrame([("none", 0, 8000, []), ("one", 0, 8000, [1.0])], "file_id string, page int, fs int, samples array<double>")
    assert signal.spectrogram(pages).collect() == []


def test_median_image_keeps_edges_and_takes_specks(spark):
    image = np.zeros((7, 8))
    image[3, 4] = image[0, 0] = image[6, 7] = 9.0
    frames = spark.createDataFrame([("f", 0, i, [float(v) for v in row]) for i, row in enumerate(image)] + [("thin", 0, 0, [5.0])], "file_id string, page int, frame int, mags array<double>")
    got = {(r.file_id, r.frame): r.mags for r in scales.median_image(frames, 3).collect()}
    assert got["f", 3] == [0.0] * 8 and got["f", 0][0] == 9.0 and got["f", 6][7] == 9.0 and got["thin", 0] == [5.0]
    with pytest.raises(ValueError):
        scales.median_image(frames, 4)


def test_codes_that_repeat_or_lack_a_name(spark):
    tags = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, code string")
    codes = spark.createDataFrame([("a", "kiwi"), ("a", "morepork"), (None, "weka")], "code string, species string")
    assert sorted((r.id, r.species) for r in scales.species_of_codes(tags, codes).collect()) == [(1, "morepork"), (2, "Don't Know"), (3, "Don't Know")]

"""Band filters, impulses and loudness detectors against their definitions."""

import numpy as np

from fieldsong.operators import cleaning, detect

FS = 8000


def pages(spark, *samples):
    return spark.createDataFrame([(f"f{k}", 0, FS, [float(v) for v in x]) for k, x in enumerate(samples)], "file_id string, page int, fs int, samples array<double>")


def test_band_pass_gains(spark):
    t = np.arange(FS) / FS
    tones = [np.sin(2 * np.pi * f * t) for f in (1414.2, 1000.0, 2000.0, 300.0, 3500.0)]
    got = lambda both: {r.file_id: np.array(r.samples) for r in cleaning.butterworth_passed(pages(spark, *tones), 1000.0, 2000.0, 6, both).collect()}
    rms = lambda x: np.sqrt(2 * np.mean(x[2000:6000] ** 2))
    once, twice = got(False), got(True)
    for k, (a, b) in enumerate([(1, 1), (2**-0.5, 0.5), (2**-0.5, 0.5), (0, 0), (0, 0)]):
        assert abs(rms(once[f"f{k}"]) - a) < 0.01 and abs(rms(twice[f"f{k}"]) - b) < 0.01
    assert np.allclose(twice["f0"][2000:6000], tones[0][2000:6000], atol=0.01)  # both ways keep the phase


def test_butterworth_is_maximally_flat():
    """The squared gain is 1 / (1 + g^(2 n)) with the band's own frequency g, for odd and even orders."""
    for order in (1, 2, 5, 6):
        h = np.abs(cleaning._response(cleaning.butterworth(order, 900.0, 2100.0, FS), 4096))
        f = np.tan(np.pi * np.fft.rfftfreq(4096)[1:-1])
        low, high = np.tan(np.pi * 900 / FS), np.tan(np.pi * 2100 / FS)
        g = (f * f - low * high) / (f * (high - low))
        assert np.allclose(h[1:-1] ** 2, 1 / (1 + g ** (2 * order)), atol=1e-6)


def test_clicks_are_masked_and_long_calls_stay(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=FS) * 0.01
    x[3210] += 5.0
    x[4992:5632] += 3 * rng.normal(size=640)
    got = np.array(cleaning.impulses_masked(pages(spark, x)).first().samples)
    assert got[3210] == 0 and np.array_equal(got[4992:5632], x[4992:5632])
    off = got != x
    assert 16 <= off.sum() <= 3 * 64 and abs(np.flatnonzero(off).mean() - 3210) < 100


def _frames(spark, levels):
    return spark.createDataFrame([("f", 0, i, [float(v)] * 4) for i, v in enumerate(levels)], "file_id string, page int, frame int, mags array<float>")


def test_syllables_and_envelope(spark):
    db = np.full(200, 1.0)
    db[50:70], db[120:125] = 40.0, 30.0
    found = sorted((round(r.s), round(r.e)) for r in cleaning.syllable_segments(_frames(spark, 10 ** (db / 10)), 1.0, 10.0, 0.5, 2.0, 3).collect())
    assert found == [(49, 70), (119, 125)]


def test_envelope_equals_the_definition(spark):
    """Frames are 1/40 s apart: four taps, of which two look ahead, on a page with four silent frames before it."""
    rng = np.random.default_rng(5)
    level = rng.random(120) + 6 * (np.arange(120) // 10 % 5 == 2)
    taps = [np.interp(1 + 25 * k, np.arange(100), cleaning.ENVELOPE) for k in range(4)]
    assert len(cleaning.ENVELOPE) == 100 and np.allclose(cleaning.envelope_taps(0.025), taps) and len(cleaning.envelope_taps(1.0)) == 1
    padded = [0.0] * 4 + level.tolist() + [0.0] * 4
    curve = [sum(w * padded[i - k + 2] for k, w in enumerate(taps) if 0 <= i - k + 2 < len(padded)) for i in range(124)]
    loud = [v > np.median(curve) + 0.7 * np.std(curve) for v in curve]
    want = [(round(i * 0.025, 6), round((next(j for j in range(i, 125) if j == 124 or not loud[j])) * 0.025, 6)) for i in range(124) if loud[i] and (i == 0 or not loud[i - 1])]
    got = sorted((round(r.s, 6), round(r.e, 6)) for r in cleaning.envelope_segments(_frames(spark, level), 0.025, 0.7).collect())
    assert got == want and len(want) > 1


def test_pitch_range(spark):
    segments = spark.createDataFrame([("f", 0.0, 1.0), ("f", 1.0, 2.0), ("f", 2.0, 3.0)], "file_id string, s double, e double")
    pitches = spark.createDataFrame([("f", 0, 0.2, 440.0), ("f", 1, 0.7, 460.0), ("f", 2, 1.5, 3000.0), ("f", 3, 2.5, None)], "file_id string, win int, t double, f0 double")
    assert [r.s for r in cleaning.in_pitch_range(segments, pitches, 400.0, 500.0, 50.0).collect()] == [0.0]


def test_calls_over_a_page_edge_are_one(spark):
    windows = spark.createDataFrame([("f", p, "x", "a", w, int((p, w) in {(0, 8), (0, 9), (1, 0), (1, 1), (1, 6)})) for p in (0, 1) for w in range(10)], "file_id string, page int, filter_id string, calltype string, win int, present int")
    filters = spark.createDataFrame([("x", "a", "tui", [1.0, 100.0, 1.0, 2.0])], "filter_id string, calltype string, species string, time_range array<double>")
    starts = spark.createDataFrame([("f", 0, 0.0), ("f", 1, 10.0)], "file_id string, page int, page_start double")
    got = sorted((r.s, r.e) for r in detect.detected_segments(windows, filters, 1.0, starts).collect())
    assert got == [(8.0, 12.0), (16.0, 17.0)]

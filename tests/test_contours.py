"""Spectral derivatives and contours cell by cell, detectors put together, levels and limits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldsong.operators import contours, detect, pictures, wavelets
from fieldsong.operators.scales import slepian

PAGE = "file_id string, page int, fs int, samples array<double>"


def loops(x, fs, width, hop, threshold):
    """Contour cells by the definition, one cell at a time; bins from the highest frequency down until the end."""
    starts = range(0, len(x) - width, hop)
    one, two = slepian(width, 2.5, 2)
    a, b = (np.array([np.fft.fft(x[s : s + width] * t)[width // 2 :] for s in starts]) for t in (one, two))
    both, power = a * np.conj(b), np.abs(a) ** 2 + np.abs(b) ** 2
    power = power / power.max()
    time, freq = both.real, both.imag
    n, m = time.shape
    fm = [np.arctan((time[:, k] ** 2).max() / ((freq[:, k] ** 2).max() or 1)) for k in range(m)]
    slope = np.array([[-time[i, k] * np.sin(fm[k]) + freq[i, k] * np.cos(fm[k]) for k in range(m)] for i in range(n)])
    hz = [fs // 2 / m * (k + 1) for k in range(m)]
    out = set()
    for i in range(1, n - 1):
        weight = time[i] ** 2 + freq[i] ** 2
        mean = (hz * weight).sum() / weight.sum()
        entropy = np.log(power[i]).mean() - np.log(power[i].mean())
        for k in range(1, m - 1):
            if slope[i, k] >= 0:
                continue
            least = threshold * abs(entropy) / abs(hz[k] - mean)
            for (pi, pk), ends in (((1, 0), ((-1, 0), (1, 0))), ((0, 1), ((0, -1), (0, 1))), ((1, 1), ((-1, -1), (1, 1))), ((1, -1), ((-1, 1), (-1, 1)))):
                if slope[i, k] * slope[(i - pi) % n, (k - pk) % m] < 0 and all(power[i + u, k + v] > least for u, v in ends):
                    out.add((i, m - 1 - k))
    return out, slope, power, fm


def test_contours_equal_loops(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=700) + 3 * np.sin(2 * np.pi * np.arange(700) * (0.1 + 0.0001 * np.arange(700)))
    pages = spark.createDataFrame([("f", 0, 8000, x.tolist()), ("short", 0, 8000, [1.0] * 70), ("none", 0, 8000, []), ("silent", 0, 8000, [0.0] * 400)], PAGE)
    want, slope, power, fm = loops(x, 8000, 32, 16, 0.5)
    rows = contours.contours(pages, 32, 16).collect()
    assert {(r.frame, r.bin) for r in rows if r.file_id == "f"} == want and len(want) > 20 and {r.file_id for r in rows} <= {"f", "short"}
    good = {r.bin: (r.goodness, r.modulation) for r in contours.pitch_goodness(pages.where("file_id = 'f'"), 32, 16).collect()}
    assert all(np.isclose(good[k][0], np.abs(np.fft.fft(slope[:, k] / power[:, k])).max()) and np.isclose(good[k][1], fm[k]) for k in range(16))
    seen = contours.change_features(pages, 32, 16).where("file_id = 'f'").orderBy("frame").collect()
    assert np.allclose([r.entropy for r in seen], np.log(power).mean(axis=1) - np.log(power.mean(axis=1))) and all(0 < r.mean_hz <= 4000 for r in seen)
    assert contours.pitch_goodness(pages.where("file_id = 'none'"), 32, 16).count() == 0


def test_loudness_is_for_one_rate(spark):
    impulse = [1.0] + [0.0] * 40
    got = contours.equal_loudness(spark.createDataFrame([("f", 0, 16000, impulse), ("e", 0, 16000, [])], PAGE)).collect()
    x = np.array(impulse)
    for b, a in contours.LOUDNESS:
        y = np.zeros(41)
        for k in range(41):
            y[k] = sum(b[j] * x[k - j] for j in range(len(b)) if k >= j) - sum(a[j] * y[k - j] for j in range(1, len(a)) if k >= j)
        x = y
    rows = {r.file_id: r.samples for r in got}
    assert np.allclose(rows["f"], x, atol=1e-6) and rows["e"] == []
    with pytest.raises(Exception, match="16000"):
        contours.equal_loudness(spark.createDataFrame([("f", 0, 8000, impulse)], PAGE)).collect()


def test_any_sound_and_the_best_of_three(spark):
    rng = np.random.default_rng(3)
    mags = rng.random((80, 32)) * 0.1
    mags[20:40, 8:20] += 5.0
    frames = spark.createDataFrame([("f", 0, k, v.tolist()) for k, v in enumerate(mags)], "file_id string, page int, frame int, mags array<double>")
    rows = detect.any_sound(frames, 0.1, 0.5, 0.3, 1.5, F.lit(60.0)).collect()
    assert [(round(r.s, 6), round(r.e, 6)) for r in sorted(rows, key=lambda r: r.s)][0][0] >= 61.7 and all(r.e - r.s <= 1.5 + 1e-9 for r in rows) and len(rows) == 2
    assert all([(x.species, x.certainty) for x in r.labels] == [("Don't Know", 0.0)] for r in rows)
    found = spark.createDataFrame([("f", 0.0, 1.0), ("f", 1.2, 2.0), ("f", 5.0, 5.1), ("f", 8.0, 13.0)], "file_id string, s double, e double")
    got = sorted((round(r.s, 6), round(r.e, 6)) for r in detect.cleaned(found, ["file_id"], 0.3, 0.5, 2.0).collect())
    assert got == [(0.0, 2.0), (8.0, 9.666667), (9.666667, 11.333333), (11.333333, 13.0)] and detect.cleaned(found, ["file_id"]).count() == 4
    with pytest.raises(ValueError, match="Voice"):
        detect.by_name("Nothing", frames, frames, 0.1)
    assert detect.by_name("Clipping", frames, frames, 0.1).count() == 1


def test_levels_and_limits(spark):
    costs = [("a", 0, 5.0), ("a", 1, 4.0), ("a", 2, 9.0), ("a", 3, 3.0), ("a", 4, 7.0), ("a", 7, 3.0), ("b", 0, 1.0), ("b", 1, 2.0), ("b", 3, 0.5), ("c", 0, 9.0), ("c", 2, 8.0), ("c", 5, 7.0)]
    df = spark.createDataFrame(costs, "id string, node int, cost double")
    assert {r.id: r.level for r in wavelets.best_level(df, ["id"]).collect()} == {"a": 3, "b": 1, "c": 2}
    with pytest.raises(ValueError, match="too many"):
        wavelets.change_points(np.ones(wavelets.MOST_POINTS + 1), 5, 1.0)


def test_pictures_for_a_network(spark):
    frames = spark.createDataFrame([("f", 0, k, [float(k), 2.0, 0.0]) for k in range(9)] + [("z", 0, k, [0.0] * 3) for k in range(4)] + [("s", 0, 0, [1.0] * 3)], "file_id string, page int, frame int, mags array<double>")
    got = {(r.file_id, r.image): [round(v, 4) for v in r.pixels] for r in pictures.network_frames(frames, 8, 4, 2.0, 1.0, 4).collect()}
    want = {("f", i): [round(v / max(2, 2 * i + 3), 4) for k in range(2 * i, 2 * i + 4) for v in (0, 2, k)] for i in range(3)}
    assert got == want | {("z", 0): [0.0] * 12}
    whole = pictures.network_frames(frames, 8, 4, 2.0, None, 4).collect()
    assert {(r.file_id, r.image) for r in whole} == {("f", 0), ("f", 1), ("z", 0)}


def test_marks_of_the_fundamental(spark):
    """Two voiced stretches three windows apart are two marks; a short one alone is none; a gap of two is joined."""
    from fieldsong.operators import shapes

    f0 = [None, 500, 510, 520, None, None, 530, 540, 550, None, None, None, 900, 910, 905, 900, 40, None, 700, None]
    pitches = spark.createDataFrame([("f", 0, k, None if v is None else float(v)) for k, v in enumerate(f0)], "file_id string, page int, win int, f0 double")
    rows = sorted((r.mark, list(r.columns), list(r.rows)) for r in shapes.pitch_marks(pitches, 8000, 16, 64, 128, 0.0, 4000.0).collect())
    y = lambda v: int(v * 2 / 8000 * 128)
    line = [y(v) for v in (500, 510, 520, -1, -1, 530, 540, 550)]
    smooth = [float(np.median([0, 0, 0, *line, 0, 0, 0][k : k + 7])) for k in range(8)]
    first = next(k for k in range(4) if smooth[k] or k == 3)
    last = next(k for k in range(7, 3, -1) if smooth[k] or k <= 8 - 3)
    assert [r[0] for r in rows] == [0, 1] and rows[0][2] == smooth[first:last] and rows[0][1] == [float((1 + k) * 2) for k in range(first, last)]
    assert rows[1][1][0] == 24.0 and shapes.pitch_marks(pitches.where("win > 15"), 8000, 16, 64, 128, 0.0, 4000.0).count() == 0


def test_three_channels_and_labels_for_all(spark):
    from fieldsong.operators import labels, signal
    from fieldsong.sources import annotations

    pages = spark.createDataFrame([("f", 0, 800, np.random.default_rng(1).normal(size=800).tolist())], PAGE)
    got = {r.image: r.channels for r in pictures.channel_frames(pages, 32, 16, 800, 0.2, 0.1, 8).collect()}
    one = {r.image: r.pixels for r in pictures.network_frames(signal.spectrogram(pages, 32, 16, "Hamming"), 800, 16, 0.2, 0.1, 8).collect()}
    assert sorted(got) == sorted(one)[:-1] and all(len(v) == 3 and list(v[1]) == list(one[k]) and max(map(max, v)) == 1 for k, v in got.items())
    with pytest.raises(ValueError, match="band"):
        labels.basic(pages, "Kiwi", 50.0, -1, 5)
    rows = labels.basic(spark.createDataFrame([(1.0, 2.0)], "s double, e double"), "Kiwi", 50.0, 1, 5, "duet").first()
    assert (rows.f_lo, rows.f_hi, rows.labels[0].species, rows.labels[0].certainty, rows.labels[0].calltype) == (1, 5, "Kiwi", 50.0, "duet")
    sheet = spark.createDataFrame([("f", 1, "1", "2.5", "10", "20"), ("f", 2, "x", "3", "1", "2"), ("f", 3, None, "3", "1", "2")], "file_id string, row int, start string, end string, low string, high string")
    assert [(r.s, r.e, r.f_hi, r.labels[0].filter) for r in annotations.from_sheet(sheet, F.lit("Kiwi")).collect()] == [(1.0, 2.5, 20, "M")]
    with pytest.raises(Exception, match="Other"):
        annotations.from_sheet(sheet, F.lit("Other")).collect()

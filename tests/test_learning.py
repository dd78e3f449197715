"""Distributions by sums over lags, rows for learning, wind by the second, thresholds by blocks, stretched sounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldsong.operators import distributions as D
from fieldsong.operators import learning

PAGE = "file_id string, page int, fs int, samples array<double>"


def by_sums(x, window, smoothing):
    """Real part of the transform over lags of averaged products, term by term."""
    n = len(x)
    half = round(n / 2) - 1 if window is None else min(round(n / 2) - 1, len(window) // 2)
    out = np.zeros((n, n))
    for i in range(n):
        for tau in range(-half, half + 1):
            top = bottom = 0.0
            for p, g in zip(range(-(len(smoothing) // 2), len(smoothing) // 2 + 1), smoothing):
                at = i - p
                if 0 <= at - abs(tau) and at + abs(tau) < n:
                    top, bottom = top + g * x[at + tau] * x[at - tau], bottom + g
            if bottom:
                w = 1.0 if window is None else window[len(window) // 2 + tau]
                out[i] += w * top / bottom * np.cos(2 * np.pi * np.arange(n) * tau / n)
    return out


def test_distributions_equal_sums_over_lags(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=30)
    assert np.allclose(D.KINDS["wigner"](x), by_sums(x, None, [1.0]))
    assert np.allclose(D.KINDS["pseudo"](x), by_sums(x, D.taper(7, 0.5), [1.0]))
    assert np.allclose(D.KINDS["smoothed"](x), by_sums(x, D.taper(7, 0.54), D.taper(3, 0.54)))
    assert np.allclose(D.taper(5, 0.5), [0.25, 0.75, 1, 0.75, 0.25]) and D.odd(6) == D.odd(7.9) == 7
    assert np.allclose(D.wigner(x).sum(axis=1) / 30, x**2)  # bins add up to each sample's power
    tone = np.cos(2 * np.pi * 0.2 * np.arange(64))
    assert D.plain(tone)[20:44, :32].argmax(axis=1).tolist() == [13] * 24
    pages = spark.createDataFrame([("f", 0, 8000, x.tolist()), ("e", 0, 8000, []), ("s", 0, 8000, [1.0])], PAGE)
    rows = D.distribution(pages, "wigner").collect()
    assert {r.file_id for r in rows} == {"f"} and len(rows) == 30 and len(rows[0].cells) == 30
    with pytest.raises(Exception, match="too many"):
        D.distribution(spark.createDataFrame([("f", 0, 8000, [0.0] * (D.LONGEST + 1))], PAGE), "plain").collect()


def test_distribution_totals_are_sums_of_the_distributions(spark):
    """Pieces of several lengths, a recording of many pages, one without a name, and short, empty and missing pieces."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3, 2, 30))
    for kind, f in D.KINDS.items():
        assert np.array_equal(f(x), [[f(row) for row in rows] for rows in x]), kind
    sizes = {"a": [30] * 5, "b": [17], "c": [30, 17, 3, 0], "d": [3], "e": [], None: [9, 30], **{f"m{k}": [16] for k in range(50)}}
    rows = [(f, k, 8000, rng.normal(size=n).tolist()) for f, v in sizes.items() for k, n in enumerate(v)] + [("e", 0, 8000, None)]
    want = {}
    for f, _, _, v in rows:
        for kind in D.KINDS:
            if v is not None and len(v) > 3:
                got = D.KINDS[kind](np.array(v)).sum(axis=0)
                old = want.get((f, kind), np.zeros(0))
                n = max(len(got), len(old))
                want[f, kind] = np.pad(got, (0, n - len(got))) + np.pad(old, (0, n - len(old)))
    got = {(r.file_id, r.kind): r.cells for r in D.totals(spark.createDataFrame(rows, PAGE).repartition(3), list(D.KINDS)).collect()}
    assert got.keys() == want.keys() and len(want) == 4 * 54
    assert all(len(got[k]) == len(want[k]) and np.allclose(got[k], want[k]) for k in want)
    with pytest.raises(Exception, match="too many"):
        D.totals(spark.createDataFrame([("f", 0, 8000, [0.0] * (D.LONGEST + 1))], PAGE), ["plain"]).collect()


def test_shares_rule_and_target(spark):
    energies = spark.createDataFrame([("a", 0, n, w, float(n)) for n in (35, 36, 99) for w in range(3)] + [("a", 1, 35, 0, 0.0)], "file_id string, seg_id int, node int, win int, energy double")
    got = {r.seg_id: r.shares for r in learning.node_shares(energies, ["file_id", "seg_id"], [35, 36, 40]).collect()}
    assert np.allclose(got[0], [35 / 71, 36 / 71, 0]) and got[1] == [None] * 3
    shares = [[0.25, 0, 0, 0, 0.25, 0, 0.5], [0.0, 0.25, 0, 0, 0, 0.25, 0.5], [0.41] + [0.0] * 6, [0, 0, 0, 0, 0.31, 0, 0], [0.25, 0.25, 0, 0.5, 0, 0, 0], [None] * 7, [0, 0, 0, 0, 0.25, 0.25, 0]]
    df = spark.createDataFrame([(k, [None if v is None else float(v) for v in s]) for k, s in enumerate(shares)], "k int, shares array<double>")
    assert [r.t for r in df.orderBy("k").select(learning.rule(F.col("shares")).alias("t")).collect()] == [True, True, True, True, False, False, False]
    segments = spark.createDataFrame([("a", 0, 4.0), ("a", 1, 9.0), ("b", 0, 4.0), ("a", 2, 6.0)], "file_id string, seg_id int, s double")
    reviewed = spark.createDataFrame([("a", 4.0, 6.0)], "file_id string, s double, e double")
    rows = learning.learning_rows(segments.select("file_id", "seg_id", F.lit(1).alias("x")), segments, reviewed, ["file_id", "seg_id"]).collect()
    assert {(r.file_id, r.seg_id): r.target for r in rows} == {("a", 0): 1, ("a", 1): 0, ("b", 0): 0, ("a", 2): 1}


def test_wind_by_the_second(spark):
    fs = 2000
    rng = np.random.default_rng(4)
    x = rng.normal(size=int(2.5 * fs)) * 50
    window = 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(512) / 512)
    want = []
    for k in range(2):
        part = x[k * fs : (k + 1) * fs]
        frames = [part[a : a + 512] * window for a in range(0, fs - 511, 256)]
        p = np.mean([np.abs(np.fft.rfft(f)) ** 2 for f in frames], axis=0) / (fs * (window**2).sum())
        p[1:-1] *= 2
        p = np.log10(p)
        want.append(p[int(len(p) * 100 / fs) : int(len(p) * 1000 / fs)].mean())
    pages = spark.createDataFrame([("f", 0, fs, x.tolist()), ("loud", 0, fs, (x * 50).tolist()), ("short", 0, fs, [1.0] * 100)], PAGE)
    got = {r.file_id: r for r in learning.windy(pages).collect()}
    assert np.isclose(got["f"].level, np.mean(want)) and not got["f"].noisy and got["loud"].noisy and "short" not in got


def test_block_thresholds_and_kinds(spark):
    c = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate([3, -1, 0.5, -4, 2])], "id string, i int, c double")
    t = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 0.7)], "id string, block long, t double")
    soft = [r.c for r in learning.block_thresholded(c, t, ["id"], 2).orderBy("i").collect()]
    hard = [r.c for r in learning.block_thresholded(c, t, ["id"], 2, "hard").orderBy("i").collect()]
    assert np.allclose(soft, [1, 0, 0, -3.3, 2]) and np.allclose(hard, [3, 0, 0, -4, 2])
    with pytest.raises(ValueError, match="soft or hard"):
        learning.block_thresholded(c, t, ["id"], 2, "none")


def test_stretched_sounds_keep_their_pitch(spark):
    fs = 8000
    x = np.sin(2 * np.pi * 500 * np.arange(fs) / fs)
    for rate in (0.8, 1.25):
        y = learning.stretch(x, rate, 512)
        assert len(y) == fs and abs(np.fft.rfft(y[600:5600] * np.hanning(5000)).__abs__().argmax() * fs / 5000 - 500) < 3
        assert 0.4 < np.sqrt((y[1000:5000] ** 2).mean()) < 0.9
    assert np.abs(learning.stretch(x, 1.25, 512)[int(fs / 1.25) + 600 :]).max() < 1e-6 and len(learning.stretch(np.zeros(0), 1.1)) == 0
    click = np.zeros(fs)
    click[4000] = 1
    assert abs(np.abs(learning.stretch(click, 1.25, 512)).argmax() - 3200) < 200
    pages = spark.createDataFrame([("f", 0, fs, x[:2000].tolist())], PAGE)
    a, b = (sorted((r.file_id, r.rate, r.samples) for r in learning.speed_changed(pages, 3, width=256).collect()) for _ in range(2))
    assert a == b and [r[0] for r in a] == ["f_0", "f_1", "f_2"] and len({r[1] for r in a}) == 3 and all(0.7 < r[1] < 1.3 and len(r[2]) == 2000 for r in a)

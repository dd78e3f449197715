"""Rebuilt nodes, templates, prediction, wind, groups and pictures against definitions written out here."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldsong.functions.nodes import band_position
from fieldsong.operators import grouping, pictures, prediction, synthesis, templates, wavelets, wind

PAGE = "file_id string, page int, fs int, samples array<double>"


@pytest.mark.parametrize("order, level", list(itertools.product((1, 4, 10), (1, 2, 4))))
def test_all_nodes_of_a_level_add_up_to_twice_the_signal(order, level):
    filters = wavelets.daubechies(order)
    x = np.random.default_rng(order).normal(size=2048)
    nodes = list(range(2**level - 1, 2 ** (level + 1) - 1))
    parts = [synthesis.rebuilt(c, n, filters, 2048) for n, c in wavelets.packet(x, nodes, *filters).items()]
    total = sum(parts)
    late = min(range(200), key=lambda d: np.abs(total[600 + d : 1400 + d] - 2 * x[600:1400]).max())
    assert np.allclose(total[600 + late : 1400 + late], 2 * x[600:1400], atol=1e-8)


def test_a_tone_is_heard_in_its_own_band():
    fs, filters = 8000, wavelets.daubechies(10)
    x = np.sin(2 * np.pi * 1625 * np.arange(8000) / fs)
    nodes = list(range(15, 31))
    loud = {n: (synthesis.only_band(synthesis.rebuilt(c, n, filters, 8000), n) ** 2).mean() for n, c in wavelets.packet(x, nodes, *filters).items()}
    best = max(loud, key=loud.get)
    assert band_position(best) == 1625 // 250 and loud[best] > 0.8 * sum(loud.values()) and 1 < loud[best] < 2.1
    other = synthesis.only_band(np.ones(800) + np.sin(np.arange(800)), 15)
    assert abs(other.mean() - 1) < 0.01 and np.abs(other - 1).max() < 0.2


def calls_by_loops(c, fs, threshold, smoothing, window, step):
    size, hop = int(np.ceil(window * fs)), int(np.ceil(step * fs))
    reach, c = int(smoothing * size), np.abs(c)
    curve = [c[k - reach : k + reach + 1].mean() if reach <= k < len(c) - reach else 0.0 for k in range(len(c))]
    limit = np.exp(np.log(c).mean() + threshold * np.log(c).std())
    return [bool(np.mean(curve[k : k + size]) > limit) for k in range(0, len(c), hop)]


def test_window_calls_equal_the_definition(spark):
    rng = np.random.default_rng(3)
    c = rng.normal(size=700) * np.where(np.arange(700) // 100 % 3 == 1, 4, 1)
    for window, step in ((1.0, 1.0), (1.0, 0.5), (2.0, 0.7)):
        assert synthesis.window_calls(c, 64.0, 0.4, 0.2, window, step).tolist() == calls_by_loops(c, 64.0, 0.4, 0.2, window, step)
    assert not synthesis.window_calls(np.zeros(100), 10.0, 0.1, 0.2, 1.0, 1.0).any() and len(synthesis.window_calls(np.zeros(0), 10.0, 0.1, 0.2, 1.0, 1.0)) == 0
    assert synthesis.on_seconds(np.array([False, False, True, False]), 0.5, 3).tolist() == [False, True, False]
    tone = np.concatenate([rng.normal(size=4000) * 0.01, np.sin(2 * np.pi * 300 * np.arange(2000) / 2000), rng.normal(size=4000) * 0.01])
    pages = spark.createDataFrame([("f", 0, 2000, tone.tolist()), ("silent", 0, 2000, [0.0] * 5000), ("none", 0, 2000, []), ("short", 0, 2000, [1.0, 2.0])], PAGE)
    got = {}
    for r in synthesis.band_calls(pages, [17, 19], wavelets.daubechies(4), 0.5, 0.1).collect():
        got.setdefault(r.file_id, {})[r.win] = r.present
    assert got["f"] == {0: 0, 1: 0, 2: 1, 3: 0, 4: 0} and got["silent"] == {0: 0, 1: 0, 2: 0} and "none" not in got and got["short"] == {0: 0}


def test_correlation_over_page_edges(spark):
    rng = np.random.default_rng(1)
    picture, template = rng.random((40, 6)), rng.random((5, 6))
    want = [np.corrcoef(picture[k : k + 5].ravel(), template.ravel())[0, 1] for k in range(36)]
    assert np.allclose(templates.correlation(picture, template), want) and len(templates.correlation(picture[:3], template)) == 0
    assert (templates.correlation(np.ones((8, 6)), template) == 0).all()
    frames = spark.createDataFrame([("f", k // 16, k % 16, picture[k].tolist()) for k in range(40)], "file_id string, page int, frame int, mags array<double>")
    few = spark.createDataFrame([("t", template.ravel().tolist())], "template string, mags array<double>")
    got = {r.page * 16 + r.frame: r.score for r in templates.correlated(frames, few).collect()}
    assert sorted(got) == list(range(36)) and np.allclose([got[k] for k in range(36)], want)
    with pytest.raises(ValueError, match="too many"):
        templates._held(spark.createDataFrame([("t", [0.0] * 10)], "template string, x array<double>").withColumn("x", F.array_repeat(F.lit(0.0), templates.MOST_CELLS + 1)), "x")


def test_neighbours_of_a_better_match_give_way(spark):
    score = [0, 5, 1, 4, 1, 3, 1, 2.9, 1, 0.5, 2, 0, 5, 0]
    scores = spark.createDataFrame([("t", "f", k, float(s)) for k, s in enumerate(score)], "template string, file_id string, at int, score double")
    apart = spark.createDataFrame([("t", 3.0)], "template string, apart double")
    got = {r.at for r in templates.best_apart(scores, ["template", "file_id"], "at", 0.4, apart).collect()}
    peaks = [k for k in range(1, 13) if score[k] > score[k - 1] and score[k] >= score[k + 1] and score[k] >= 2]
    want = set()
    for k in sorted(peaks, key=lambda k: (-score[k], k)):
        if all(abs(k - j) >= 3 for j in want):
            want.add(k)
    assert got == want == {1, 5, 12} | ({10} & want)


def paths(n, m):
    """All warping paths over n x m places."""
    if n == m == 1:
        return [[(0, 0)]]
    steps = [(n - 1, m), (n, m - 1), (n - 1, m - 1)]
    return [p + [(n - 1, m - 1)] for a, b in steps if a >= 1 and b >= 1 for p in paths(a, b)]


def test_warping_equals_enumeration(spark):
    rng = random.Random(2)
    for _ in range(40):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(1, 5))] for _ in range(2))
        cost = lambda p, b=b, a=a: sum(abs(a[i] - b[j]) for i, j in p)
        far = templates.warping_matrix(a, b)
        assert far[-1, -1] == min(map(cost, paths(len(a), len(b)))) == cost(templates.warping_path(far))
        assert templates.warping_path(far)[0] == (0, 0) and templates.warping_path(far)[-1] == (len(a) - 1, len(b) - 1)
        free = templates.warping_matrix(a, b, anywhere=True)
        for end in range(len(b)):
            want = min(min(cost([(i, s + j) for i, j in p]) for p in paths(len(a), end + 1 - s)) for s in range(end + 1))
            path = templates.warping_path(free, end, True)
            assert free[-1, end + 1] == want == cost(path) and path[0][0] == 0 and path[-1] == (len(a) - 1, end)
        assert templates.lower_bound(np.array(a), np.array(b)) <= min(free[-1, 1:])
    series = spark.createDataFrame([(1, [9.0, 1.0, 2.0, 3.0, 9.0]), (2, [50.0, 60.0]), (3, [])], "key int, x array<double>")
    few = spark.createDataFrame([("t", [1.0, 3.0])], "template string, x array<double>")
    assert [tuple(r) for r in templates.warped_matches(series, few, 1.5).collect()] == [("t", 1, 1, 3, 1.0)]
    assert [tuple(r) for r in templates.warping_counts(series.where("key < 3"), few, 1.5).collect()] == [("t", 2, 1)]


def test_prediction_solves_the_normal_equations(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(6, 40))
    x[5] = 0
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(9, []), (10, None)], "id int, x array<double>")
    got = {r.id: r for r in prediction.prediction_coefficients(df, ["id"], "x", 5).collect()}
    for k in range(5):
        r = np.array([(x[k] * np.roll(x[k], -j)).sum() for j in range(6)])
        want = np.linalg.solve([[r[abs(i - j)] for j in range(5)] for i in range(5)], -r[1:])
        assert np.allclose(got[k].a, [1, *want]) and np.allclose(got[k].error, r[0] + want @ r[1:])
        kernel = prediction.levinson_kernel(r)
        assert np.allclose(kernel[0], got[k].a) and np.isclose(kernel[1], got[k].error)
    assert list(got[5].a) == [1, 0, 0, 0, 0, 0] and got[9].a is None and got[10].a is None


def test_formants_of_two_resonances(spark):
    fs, poles = 8000, [0.97 * np.exp(2j * np.pi * f / 8000) for f in (900, 2300)]
    taps = np.real(np.poly([*poles, *np.conj(poles)]))
    drive, y = np.random.default_rng(0).normal(size=4096), np.zeros(4096)
    for k in range(4096):
        y[k] = drive[k] - sum(taps[j] * y[k - j] for j in range(1, 5) if k >= j)
    pages = spark.createDataFrame([("f", 0, fs, y.tolist()), ("z", 0, fs, [0.0] * 4096)], PAGE)
    rows = prediction.formants(pages, 2048, 5).collect()
    assert {r.file_id for r in rows} == {"f"}
    heard = [r.hz for r in rows if r.frame == 0]
    assert min(abs(h - 900) for h in heard) < 60 and min(abs(h - 2300) for h in heard) < 60 and heard == sorted(heard)


def test_quantile_fit_leaves_its_share_below():
    rng = np.random.default_rng(8)
    f = np.linspace(300, 5800, 60)
    x = wind.polynomial(f)
    y = (0.3 * np.log(f) ** 2 - np.log(f))[:, None] + rng.gamma(2.0, size=(60, 20))
    for q in (0.2, 0.5, 0.8):
        beta = wind.quantile_fit(x, y, q, 400, 1e-6)
        share = (y < x @ beta - 1e-9).mean(axis=0)
        assert np.all(np.abs(share - q) <= 4.5 / 60), share
        loss = lambda b, q=q: np.where(y - x @ b > 0, q * (y - x @ b), (q - 1) * (y - x @ b)).sum(axis=0)
        assert np.all(loss(beta) <= loss(wind.least_squares(x, y)) + 1e-9)


def test_wind_under_nodes_equals_the_definition(spark):
    rng = np.random.default_rng(4)
    targets, windows = [20, 45], 30
    level = lambda n: (n + 1).bit_length() - 1
    band = {n: (band_position(n) * 8000 / 2 ** level(n), (band_position(n) + 1) * 8000 / 2 ** level(n)) for n in [*targets, *range(31, 63)]}
    energy = {(n, w): float(np.exp(rng.normal())) for n in [0, *targets, *range(31, 63)] for w in range(windows)}
    energies = spark.createDataFrame([("f", 0, n, w, e) for (n, w), e in energy.items()], "file_id string, page int, node int, win int, energy double")
    bands = spark.createDataFrame([(n, a, b) for n, (a, b) in band.items()], "node int, f_lo double, f_hi double")
    nodes = [n for n in range(31, 63) if n not in targets and (n - 1) // 2 not in targets and n not in (31, 47) and sum(band[n]) / 2 < 6000]
    calm = sorted(range(windows), key=lambda w: energy[0, w])[:3]
    for over in (1.0, 1.5):
        got = {(r.node, r.win): r.wind for r in wind.predicted(energies, bands, targets, over=over).collect()}
        assert len(got) == 60
        for n, w in got:
            line = np.polynomial.Polynomial.fit([np.log(sum(band[k]) / 2) for k in nodes], [np.log(energy[k, w]) for k in nodes], 3)
            ground = np.mean([np.log(energy[n, v]) for v in calm])
            middle, half = sum(band[n]) / 2, 16000 / 128
            at = [middle - half, middle + half] if n == 20 else [middle]
            assert np.isclose(got[n, w], np.mean([np.exp((line(np.log(f)) - ground) * over + ground) for f in at]), rtol=1e-6)
    lower = {(r.node, r.win): r.wind for r in wind.predicted(energies, bands, targets, how="quantile").collect()}
    assert np.mean([lower[k] < got[k] for k in lower]) > 0.8 and wind.predicted(energies.where("node < 40"), bands, targets).count() == 0


def test_chains_and_shifts(spark):
    rng = random.Random(6)
    place = {k: rng.uniform(-9, 9) for k in range(300)}
    links = [(k, k + 1, place[k] - place[k + 1]) for k in range(199)] + [(k, k - 50, place[k] - place[k - 50]) for k in range(250, 260)] + [(270, 270, 0.0), (None, 3, 1.0)]
    got = {r.id: (r.root, r["shift"]) for r in grouping.connected(spark.createDataFrame(links, "a int, b int, shift double")).collect()}
    assert all(got[k][0] == 0 and abs(got[k][1] - (place[k] - place[0])) < 1e-9 for k in range(200))
    assert all(got[k][0] == k - 50 for k in range(250, 260)) and got[270] == (270, 0.0) and len(got) == 221
    assert grouping.connected(spark.createDataFrame([], "a int, b int, shift double")).count() == 0


def test_single_linkage(spark):
    rng = random.Random(9)
    at = {k: (rng.random() * 4, rng.random() * 4) for k in range(60)}
    pairs = [(a, b, round(float(np.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1])), 1)) for a in at for b in at if a < b and np.hypot(at[a][0] - at[b][0], at[a][1] - at[b][1]) < 0.9]
    df = spark.createDataFrame(pairs + [(b, a, d) for a, b, d in pairs[:20]] + [(1, 1, 0.0), (2, 3, None)], "a int, b int, d double")
    forest = grouping.spanning_forest(df)
    rows = forest.collect()
    group = {k: k for k in at}
    total = 0.0
    for a, b, d in sorted(pairs, key=lambda p: (p[2], p[0], p[1])):
        if group[a] != group[b]:
            total += d
            low, high = sorted((group[a], group[b]))
            group = {k: low if g == high else g for k, g in group.items()}
    assert len(rows) == 60 - len(set(group.values())) and abs(sum(r.d for r in rows) - total) < 1e-9
    ids = spark.createDataFrame([(k,) for k in at], "id int")

    def by_hand(keep):
        g = {k: k for k in at}
        for r in keep:
            low, high = sorted((g[r.a], g[r.b]))
            g = {k: low if v == high else v for k, v in g.items()}
        return g

    assert {r.id: r.cluster for r in grouping.cut_tree(forest, ids, height=0.4).collect()} == by_hand([r for r in rows if r.d <= 0.4])
    many = len(set(group.values())) + 7
    found = {r.id: r.cluster for r in grouping.cut_tree(forest, ids, clusters=many).collect()}
    assert len(set(found.values())) == many and found == by_hand(sorted(rows, key=lambda r: (r.d, r.a, r.b))[:-7])
    assert {r.id: r.cluster for r in grouping.cut_tree(forest, ids, clusters=1).collect()} == group
    assert grouping.spanning_forest(df.limit(0)).count() == 0


def test_mean_shift_equals_loops(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.25, size=(40, 2)) for c in ((0, 0), (3, 0), (0, 3.2))])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [1.0]), (902, [float("nan"), 1.0])], "id int, x array<double>")
    got = {r.id: (r.cluster, r.centre) for r in grouping.mean_shift(df, 1.0).collect()}
    assert sorted(got) == list(range(120))
    for k in range(120):
        assert all(got[k][0] == got[j][0] for j in range(k // 40 * 40, k // 40 * 40 + 40))
        m = x[k]
        for _ in range(300):
            m = x[np.linalg.norm(x - m, axis=1) <= 1.0].mean(axis=0)
        assert np.linalg.norm(np.array(got[k][1]) - m) < 0.05
    assert len({c for c, _ in got.values()}) == 3 and grouping.mean_shift(df.limit(0), 1.0).count() == 0


def test_exemplars_equal_the_dense_messages(spark):
    rng = np.random.default_rng(11)
    x = np.concatenate([rng.normal(c, 0.4, size=(8, 2)) for c in ((0, 0), (4, 1), (1, 5))])
    n = len(x)
    s = -((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(s, -6.0)
    df = spark.createDataFrame([(i, k, float(s[i, k])) for i in range(n) for k in range(n)], "i int, k int, s double")
    got = {r.id: r.exemplar for r in grouping.exemplars(df, rounds=25, quiet=99).collect()}
    r, a = np.zeros((n, n)), np.zeros((n, n))
    for _ in range(25):
        new = np.array([[s[i, k] - max(a[i, j] + s[i, j] for j in range(n) if j != k) for k in range(n)] for i in range(n)])
        r = 0.5 * r + 0.5 * new
        plus = np.maximum(r, 0)
        new = np.array([[sum(plus[j, k] for j in range(n) if j != k) if i == k else min(0.0, r[k, k] + sum(plus[j, k] for j in range(n) if j not in (i, k))) for k in range(n)] for i in range(n)])
        a = 0.5 * a + 0.5 * new
    own = [k for k in range(n) if a[k, k] + r[k, k] > 0]
    assert len(own) == 3 and got == {i: i if i in own else max(own, key=lambda k: (s[i, k], k)) for i in range(n)}


def test_best_ridge_over_pages_equals_enumeration(spark):
    rng = np.random.default_rng(13)
    mags = rng.random((9, 7))
    mags[4] = 0
    frames = spark.createDataFrame([("f", k // 4, k % 4, mags[k].tolist()) for k in range(9)] + [("e", 0, 0, []), ("z", 0, 0, [0.0, 0.0])], "file_id string, page int, frame int, mags array<double>")
    candidates = pictures.ridge_candidates(frames, 3)
    rows = {}
    for r in candidates.collect():
        rows.setdefault(r.page * 4 + r.frame, []).append((r.bin, r.w))
    for k in range(9):
        peaks = [b for b in range(7) if mags[k, b] > 0 and (b == 0 or mags[k, b] > mags[k, b - 1]) and (b == 6 or mags[k, b] >= mags[k, b + 1])]
        assert sorted(b for b, _ in rows.get(k, [])) == sorted(sorted(peaks, key=lambda b: (-mags[k, b], b))[:3])
    for cost in (pictures.Cost(0.2), pictures.Cost(0.4, 0.3, 0.5, 2.0, 3.0, 1.5)):
        weigh = lambda path, cost=cost: sum(w + cost.place(np.array([b]))[0] for b, w in path) + sum(cost.move(np.array([b]), np.array([a]))[0, 0] for (a, _), (b, _) in zip(path, path[1:]))
        best = max(map(weigh, itertools.product(*[rows[k] for k in sorted(rows)])))
        got = sorted((r.page * 4 + r.frame, r.bin) for r in pictures.ridges(candidates, cost).collect())
        assert [k for k, _ in got] == sorted(rows) and np.isclose(weigh([(b, dict(rows[k])[b]) for k, b in got]), best)
    assert set(pictures.ridge_spread(pictures.ridges(candidates, pictures.Cost(0.2)), 4)) == {"drift", "drift_spread", "middle", "middle_spread"}


def test_reassigned_energy_gathers(spark):
    fs, t = 8000, np.arange(4000) / 8000
    pages = spark.createDataFrame([("f", 0, fs, np.sin(2 * np.pi * 1000 * t).tolist()), ("s", 0, fs, [1.0] * 50)], PAGE)
    rows = pictures.reassigned(pages, 256, 128).collect()
    total = sum(r.energy for r in rows)
    by_bin = {}
    for r in rows:
        by_bin[r.bin] = by_bin.get(r.bin, 0) + r.energy
    assert {r.file_id for r in rows} == {"f"} and max(by_bin.values()) / total > 0.8
    plain = np.abs(np.fft.rfft(np.sin(2 * np.pi * 1000 * t[:256]) * np.hanning(256)))[:128]
    assert max(by_bin.values()) / total > plain.max() / plain.sum()


def test_constant_q_of_a_tone_and_chroma(spark):
    fs = 8000
    pages = spark.createDataFrame([("f", 0, fs, (0.7 * np.sin(2 * np.pi * 880 * np.arange(8000) / fs)).tolist()), ("s", 0, fs, [1.0])], PAGE)
    rows = {r.band: r for r in pictures.constant_q(pages, 12, 110.0, 3500.0).collect()}
    best = max(rows, key=lambda k: np.mean(rows[k].mags))
    assert abs(rows[best].hz - 880) < 1 and abs(np.mean(rows[best].mags) - 0.7) < 0.02 and len(rows) == 60
    assert rows[59].hz / rows[0].hz == pytest.approx(2 ** (59 / 12)) and len(rows[best].mags) > len(rows[0].mags)
    assert np.isclose(rows[best]["step"] * len(rows[best].mags), 1.0)
    mags = np.zeros(128)
    mags[[14, 28, 56]] = 3.0, 2.0, 1.0  # 437.5 Hz and two octaves of it: all A
    frames = spark.createDataFrame([("f", 0, 0, mags.tolist()), ("f", 0, 1, [0.0] * 128), ("f", 0, 2, [])], "file_id string, page int, frame int, mags array<double>")
    got = {r.frame: r.chroma for r in pictures.chroma(frames, fs, 256).collect()}
    assert got[0] == [0] * 9 + [1] + [0] * 2 and got[1] == [0] * 12 and 2 not in got

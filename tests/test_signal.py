"""Kernels against definitions: sines of known frequency, silence, reconstruction, plain loops."""

from itertools import combinations

import numpy as np
import pytest

from fieldsong.operators import clustering, signal, training, wavelets

FS = 8000


def page(spark, x, fs=FS):
    return spark.createDataFrame([("f", 0, fs, [float(v) for v in x])], "file_id string, page int, fs int, samples array<double>")


def sine(f, n=4096, fs=FS):
    return np.sin(2 * np.pi * f * np.arange(n) / fs)


def test_a_sine_is_loudest_in_its_bin(spark):
    frames = signal.spectrogram(page(spark, sine(1000)), 256, 128)
    assert {r.bin for r in signal.loudest_bins(frames).collect()} == {32}


def test_magnitudes_are_those_of_a_direct_sum():
    x = np.random.default_rng(1).standard_normal(90)
    got = signal.magnitudes(x, 16, 8)
    y, w = x - x.mean(), signal.window_of("Hann", 16)
    for f in range(len(got)):
        part = y[f * 8 : f * 8 + 16] * w
        want = [abs((part * np.exp(-2j * np.pi * b * np.arange(16) / 16)).sum()) for b in range(8)]
        assert np.allclose(got[f], want)


@pytest.mark.parametrize("name", ["Hann", "Hamming", "Blackman", "BlackmanHarris", "Welch", "Parzen", "Ones"])
def test_windows_are_highest_in_the_middle(name):
    w = signal.window_of(name, 65)
    assert w.argmax() in (0, 32) and w.max() <= 1.0001 and w.min() > -0.001
    with pytest.raises(ValueError):
        signal.window_of("none", 4)


def test_a_filter_passes_its_band(spark):
    mixed = sine(500) + sine(3000)
    kept = np.array(signal.band_passed(page(spark, mixed), 2000.0, None).first().samples)[200:-200]
    assert np.abs(kept - sine(3000)[200:-200]).max() < 0.05


def test_resampling_keeps_a_sine(spark):
    got = signal.resampled(page(spark, sine(500)), 4000).first()
    assert got.fs == 4000 and np.abs(np.array(got.samples)[100:-100] - sine(500, 2048, 4000)[100:-100]).max() < 0.02


def test_the_pitch_of_a_sine(spark):
    got = [r.f0 for r in signal.pitch(page(spark, sine(440)), 512).collect()]
    assert got and all(abs(f - 440) < 4 for f in got)
    noise = np.random.default_rng(0).standard_normal(4096)
    assert sum(r.f0 is None for r in signal.pitch(page(spark, noise), 512, 0.1).collect()) > 5


def test_detectors_find_a_burst(spark):
    x = np.random.default_rng(0).standard_normal(16000) * 0.01
    x[6000:10000] += sine(1000, 4000)
    loud = signal.amplitude_segments(page(spark, x), 0.9).collect()
    assert loud and min(r.s for r in loud) > 0.74 and max(r.e for r in loud) < 1.26
    frames = signal.spectrogram(page(spark, x), 256, 128)
    power = signal.power_segments(frames, 128 / FS).collect()
    assert len(power) == 1 and abs(power[0].s - 0.75) < 0.05 and abs(power[0].e - 1.25) < 0.05
    clipped = signal.clipped_segments(frames, 128 / FS, 3.0, 30, 1.0).collect()
    assert len(clipped) == 1 and abs(clipped[0].s - 0.75) < 0.08 and abs(clipped[0].e - 1.25) < 0.08


def test_regions_join_over_corners():
    m = np.array([[1, 0, 0, 1], [0, 1, 0, 0], [0, 0, 0, 1]], bool)
    assert len(set(signal._regions(m)[m])) == 3


@pytest.mark.parametrize("n", [1, 2, 4, 8])
def test_wavelet_filters_are_orthonormal(n):
    low, high = wavelets.daubechies(n)
    assert abs(low.sum() - 2**0.5) < 1e-6 and abs(high.sum()) < 1e-4
    for k in range(n):
        want = 1.0 if k == 0 else 0.0
        assert abs((low[2 * k :] * low[: len(low) - 2 * k]).sum() - want) < 1e-4
        assert abs((low[2 * k :] * high[: len(low) - 2 * k]).sum()) < 1e-4


def test_energy_lies_in_a_sines_node(spark):
    energies = wavelets.node_energies(page(spark, sine(2500)), [3, 4, 5, 6], 0.1, wavelets.daubechies(8))
    per = {r.node: r.total for r in energies.groupBy("node").sum("energy").withColumnRenamed("sum(energy)", "total").collect()}
    assert max(per, key=per.get) in (5, 6) and max(per.values()) > 5 * sorted(per.values())[-2]


def test_nothing_shrunk_gives_the_signal_back(spark):
    x = np.random.default_rng(2).standard_normal(500)
    got = np.array(wavelets.denoised(page(spark, x), 3, wavelets.daubechies(2), 0.0).first().samples)
    assert np.abs(got - x).max() < 1e-6
    calm = np.array(wavelets.denoised(page(spark, sine(200, 2048) + 0.05 * np.random.default_rng(3).standard_normal(2048)), 4, wavelets.daubechies(4)).first().samples)
    assert np.abs(calm - sine(200, 2048))[100:-100].mean() < 0.1


def test_the_best_basis_is_the_cheapest_tree(spark):
    costs = [(1, 0, 10.0), (1, 1, 4.0), (1, 2, 5.0), (1, 3, 1.0), (1, 4, 1.0), (1, 5, 3.0), (1, 6, 3.0), (2, 0, 1.0), (2, 1, 1.0), (2, 2, 1.0)]
    got = wavelets.best_leaves(spark.createDataFrame(costs, "k int, node int, cost double"), ["k"]).collect()
    assert sorted((r.k, r.node) for r in got) == [(1, 2), (1, 3), (1, 4), (2, 0)]


def test_change_points_find_a_burst():
    rng = np.random.default_rng(5)
    x = rng.standard_normal(80)
    x[30:40] *= 8
    found = wavelets.change_points(x, 20, 2.0)
    assert [(s, e) for s, e, k in found if k == "s" and abs(s - 30) <= 2 and abs(e - 40) <= 2]
    assert wavelets.change_points(rng.standard_normal(60), 10, 5.0) == []


def test_greedy_search_and_subsets_agree_with_counting(spark):
    rng = np.random.default_rng(1)
    nodes, windows = [3, 5, 9], 30
    truth = rng.integers(0, 2, windows)
    hit = {n: rng.random(windows) < 0.3 + 0.4 * truth for n in nodes}
    z = spark.createDataFrame([("f", 0, n, w, 1.0 if hit[n][w] else -1.0) for n in nodes for w in range(windows)], "file_id string, page int, node int, win int, z double")
    real = spark.createDataFrame([("f", w, int(truth[w])) for w in range(windows)], "file_id string, win int, present int")

    def score(own):
        any_ = np.any([hit[n] for n in own], axis=0) if own else np.zeros(windows, bool)
        tp, fp, fn = (any_ & (truth == 1)).sum(), (any_ & (truth == 0)).sum(), (~any_ & (truth == 1)).sum()
        return 5 * tp / (5 * tp + 4 * fn + fp) if tp else 0.0

    kept, best = [], 0.0
    for n in nodes:
        if score([*kept, n]) > best:
            kept, best = [*kept, n], score([*kept, n])
    got = training.greedy_nodes(z, real, nodes, [0.0]).first()
    assert list(got.nodes) == kept and abs(got.fbeta - best) < 1e-9
    hits = real.selectExpr("0.0D AS threshold", "file_id", "win", "present").join(z.where("z > 0").select("file_id", "win", "node"), ["file_id", "win"], "left").select("threshold", "file_id", "win", "present", "node")
    top = training.best_subset(hits, nodes, 3).first()
    assert abs(top.score - max(score(c) - 0.01 * k for k in (1, 2, 3) for c in combinations(nodes, k))) < 1e-9


def test_warping_is_the_least_path():
    rng = np.random.default_rng(6)
    for _ in range(5):
        a, b = rng.standard_normal(rng.integers(1, 9)), rng.standard_normal(rng.integers(1, 9))
        d = np.full((len(a) + 1, len(b) + 1), np.inf)
        d[0, 0] = 0
        for i in range(len(a)):
            for j in range(len(b)):
                d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
        assert abs(clustering.warped(a, b) - d[-1, -1]) < 1e-9
    assert clustering.common_subsequence(np.array(list("abcbdab")), np.array(list("bdcaba"))) == 4


def test_clusters_of_blobs(spark):
    rng = np.random.default_rng(7)
    rows = [(k, [float(v) for v in rng.standard_normal(3) * 0.1 + 5 * (k % 3)]) for k in range(60)]
    df = spark.createDataFrame(rows, "id int, features array<double>")
    got = clustering.clustered(df, 3)
    assert got.select((got.id % 3).alias("t"), "cluster").distinct().count() == 3
    assert clustering.silhouette(got) > 0.9


def test_windows_that_are_all_alike_get_the_constant(spark):
    e = spark.createDataFrame([("a", 0, 1, 0, 2.0), ("b", 0, 1, 0, 2.0), ("b", 0, 1, 1, 3.0), ("b", 0, 1, 2, 9.0)], "file_id string, page int, node int, win int, energy double")
    z = lambda *how: {(r.file_id, r.win): r.z for r in training.standardised(e, 0, *how).collect()}
    assert z()["a", 0] == 0.0 and np.isnan(z(float("nan"))["a", 0])
    assert all(np.isfinite(v) for (f, _), v in z(float("nan")).items() if f == "b")


def test_best_subset_where_a_file_has_one_window(spark, sf_dir, tmp_path):
    import duckdb

    from fieldsong.plans import signal_queries

    spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id < 481").coalesce(1).write.parquet(f"file://{tmp_path}/embeddings.parquet")
    want = duckdb.sql(signal_queries.SQL["best_subset"].replace("embeddings", f"read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")).fetchall()
    assert sorted(tuple(r) for r in signal_queries.best_subset(spark, f"file://{tmp_path}").collect()) == sorted(want)


def test_lagged_products_over_blocks_of_the_index(spark):
    from fieldsong.operators import corpus

    x = np.random.default_rng(3).standard_normal(200)
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)], "rec string, k int, x double")
    got = corpus.lagged_products(df, df, ["rec"], "k", "x", 3)
    m = x - x.mean()
    want = {lag: (m[max(0, -lag) : 200 - max(0, lag)] * m[max(0, lag) : 200 + min(0, lag)]).sum() / 200 for lag in range(-3, 4)}
    assert {r.lag: round(r["cov"], 9) for r in got.collect()} == {k: round(float(v), 9) for k, v in want.items()}
    assert "[-3,-2,-1,0,1,2,3]" not in got._jdf.queryExecution().executedPlan().toString()  # no copy of a value for each lag

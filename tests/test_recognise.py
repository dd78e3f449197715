"""Making and testing recognisers, checks by frame probabilities, pieces of recordings, agreement of labellings."""

import math
import struct
from itertools import groupby

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldsong.functions import nodes as node_functions
from fieldsong.operators import evaluate, labels, recognise, wavelets
from fieldsong.sources import audio, chunks


def test_families_stand_together():
    assert recognise.family_order([15, 40, 32, 19, 31, 16]) == [32, 31, 15, 40, 19, 16]
    assert recognise.family_order([]) == [] and recognise._below(63, 15) and not recognise._below(15, 31)


def test_training_finds_the_band_of_the_calls(spark):
    """Calls are tones at 240 Hz in noise; the nodes of that band find them."""
    rng = np.random.default_rng(3)
    fs, seconds = 1024, 24
    rows, truth = [], []
    for k in range(3):
        x = rng.normal(size=fs * seconds) * 0.3
        for s in range(seconds):
            call = (s + k) % 6 in (2, 3)
            truth.append((f"f{k}", s, int(call)))
            if call:
                x[s * fs : (s + 1) * fs] += 2 * np.sin(2 * np.pi * 240 * np.arange(fs) / fs)
        rows.append((f"f{k}", 0, fs, x.tolist()))
    rows.append(("unmarked", 0, fs, rng.normal(size=fs * 5).tolist()))
    pages = spark.createDataFrame(rows, "file_id string, page int, fs int, samples array<double>")
    real = spark.createDataFrame(truth, "file_id string, win int, present int")
    bands = node_functions.node_bands(spark, 5, fs)
    got = {(r.m, r.threshold): r for r in recognise.train(pages, real, bands, 160.0, 400.0, [0.5, 2.0, 9.0], [0.05, 0.2], wavelets.daubechies(6)).collect()}
    assert len(got) == 6 and all(r.tp + r.fn == 24 and r.tp + r.fp + r.tn + r.fn == 72 for r in got.values())
    best = got[0.05, 2.0]
    assert best.tp >= 23 and best.fp <= 2 and got[0.05, 9.0].tp == 0
    band = {r.node: (r.f_lo, r.f_hi) for r in bands.collect()}
    assert any(band[n][0] <= 241 and band[n][1] >= 239 for n in best.nodes) and all(n >= recognise.COARSE for n in best.nodes)


def test_grid_search_equals_loops(spark):
    rng = np.random.default_rng(6)
    peak = {(f, n, w): float(rng.normal()) for f in "ab" for n in (20, 33, 41) for w in range(14)}
    real = {(f, w): int(rng.random() < 0.4) for f in "ab" for w in range(14)}
    peaks = spark.createDataFrame([(f, 0, n, (20, 33, 41).index(n), 0.1, w, v) for (f, n, w), v in peak.items()], "file_id string, page int, node int, place int, m double, win int, peak double")
    truth = spark.createDataFrame([(f, w, y) for (f, w), y in real.items()], "file_id string, win int, present int")
    got = {r.threshold: r for r in recognise.grid_search(peaks, truth, [0.0, 0.6]).collect()}
    for t in (0.0, 0.6):
        nodes, counts = set(), [0, 0, 0, 0]
        for f in "ab":
            y = np.array([real[f, w] for w in range(14)]) > 0
            hit = {n: np.array([peak[f, n, w] > t for w in range(14)]) for n in (20, 33, 41)}
            found, best = np.zeros(14, bool), 0.0
            for n in sorted((20, 33, 41), key=lambda n: (recognise.f_beta(hit[n], y)[0], n), reverse=True):
                score, _ = recognise.f_beta(found | hit[n], y)
                if score > best:
                    found, best = found | hit[n], score
                    nodes.add(n)
            for k, c in enumerate(((found & y), (found & ~y), (~found & ~y), (~found & y))):
                counts[k] += int(c.sum())
        assert [got[t].tp, got[t].fp, got[t].tn, got[t].fn] == counts and list(got[t].nodes) == sorted(nodes)


def test_report_before_and_after_cleaning(spark):
    windows = [1, 0, 1, 0, 0, 0, 1, 0, 0, 0]
    real = [1, 1, 1, 0, 0, 0, 0, 0, 1, 0]
    df = lambda v: spark.createDataFrame([("f", k, x) for k, x in enumerate(v)], "file_id string, win int, present int")
    got = {r.stage: r for r in recognise.recogniser_report(df(windows), df(real), 2.0, 1.0).collect()}
    assert (got["windows"].tp, got["windows"].fp, got["windows"].tn, got["windows"].fn) == (2, 1, 5, 2)
    assert (got["calls"].tp, got["calls"].fp, got["calls"].tn, got["calls"].fn) == (3, 0, 6, 1) and got["calls"].precision == 1 and got["calls"].recall == 0.75
    none = recognise.recogniser_report(df([0] * 10), df(real), 2.0, 1.0).collect()
    assert {(r.tp, r.precision) for r in none} == {(0, None)}


def test_segments_are_checked_by_their_frames(spark):
    segments = spark.createDataFrame([(k, 0) for k in range(5)], "id int, certainty int")
    probabilities = {0: [0.9, 0.9, 0.9, 0.1], 1: [0.6, 0.6, 0.9, 0.2], 2: [0.9, 0.1, 0.9, 0.9], 3: [0.1] * 4}
    frames = spark.createDataFrame([(k, i, p) for k, v in probabilities.items() for i, p in enumerate(v)], "id int, frame int, probability double")
    got = {r.id: r.certainty for r in recognise.verified(segments, frames, ["id"], "frame", F.lit(0.5), F.lit(0.8), 1.5, 0.5).collect()}
    longest = lambda v, t: max((sum(1 for _ in g) for k, g in groupby(p >= t for p in v) if k), default=0) * 0.5
    assert got == {k: 90 if longest(v, 0.8) >= 1.5 else 50 for k, v in probabilities.items() if longest(v, 0.5) >= 1.5} == {0: 90, 1: 50}
    spans = spark.createDataFrame([(0.0, 1.0), (4.0, 5.0), (9.5, 10.0), (2.0, 9.0)], "s double, e double")
    wide = [(round(r.s, 3), round(r.e, 3)) for r in recognise.frame_spans(spans, 3.0, F.lit(10.0)).collect()]
    assert wide == [(0.0, 3.01), (2.995, 6.005), (6.99, 10.0), (2.0, 9.0)]


def test_pieces_of_recordings(spark, tmp_path):
    two = np.arange(2 * 2500, dtype="<i2")
    (tmp_path / "REC_20191231_235959.wav").write_bytes(chunks.wav_piece(two.tobytes(), 2, 1000, 16))
    (tmp_path / "plain.wav").write_bytes(audio.wav_bytes(np.arange(900.0), 1000))
    out = f"file://{tmp_path}/out"
    audio.saved(chunks.pieces(audio.files(spark, str(tmp_path)), 1), out).count()
    sizes = {p.name: audio.parse_header(p.read_bytes()) for p in (tmp_path / "out").iterdir()}
    assert {k: (v[0], v[4]) for k, v in sizes.items()} == {"REC_20191231_235959.wav": (2, 4000), "REC_20200101_000000.wav": (2, 4000), "REC_20200101_000001.wav": (2, 2000), "plain_0.wav": (1, 1800)}
    whole = b"".join((tmp_path / "out" / f"REC_{t}.wav").read_bytes()[44:] for t in ("20191231_235959", "20200101_000000", "20200101_000001"))
    assert whole == two.tobytes() and struct.unpack("<I", (tmp_path / "out" / "plain_0.wav").read_bytes()[40:44]) == (1800,)
    names = spark.createDataFrame([("a_20240331_015930.wav", 120.0), ("x.y.wav", 61.0), ("bad_20241341_000000.wav", 10.0), ("none.wav", 0.0), ("noending", 5.0)], "name string, seconds double")
    got = sorted(r.piece_name for r in chunks.piece_names(names, 60).collect())
    assert got == ["a_20240331_015930.wav", "a_20240331_020030.wav", "bad_20241341_000000_0.wav", "noending_0", "x.y_0.wav", "x.y_1.wav"]
    with pytest.raises(ValueError, match="seconds long"):
        chunks.piece_names(names, 0)


def test_adjusted_mutual_information(spark):
    rows = [("a", 1)] * 6 + [("a", 2)] * 2 + [("b", 2)] * 5 + [("b", 3), (None, 3), (None, None)]
    df = spark.createDataFrame(rows, "t string, c int")
    n = len(rows)
    one, other = ({k: sum(x[i] == k for x in rows) for k in {x[i] for x in rows}} for i in (0, 1))
    choose = lambda v: -sum(c / n * math.log(c / n) for c in v.values())
    mutual = sum((m := rows.count((t, c))) / n * math.log(n * m / (one[t] * other[c])) for t in one for c in other if (t, c) in rows)
    expected = 0.0
    for a in one.values():
        for b in other.values():
            for k in range(max(1, a + b - n), min(a, b) + 1):
                expected += k / n * math.log(n * k / (a * b)) * math.comb(a, k) * math.comb(n - a, b - k) / math.comb(n, b)
    want = (mutual - expected) / ((choose(one) + choose(other)) / 2 - expected)
    assert abs(evaluate.adjusted_mutual_information(df, "t", "c").first().ami - want) < 1e-9
    same = spark.createDataFrame([("x", 1)] * 4, "t string, c int")
    assert evaluate.adjusted_mutual_information(same, "t", "c").first().ami == 1 and evaluate.adjusted_mutual_information(df.limit(0), "t", "c").first().ami is None


def test_category_of_a_bat(spark):
    kinds = {"Both": [("Long-tailed bat", 100.0), ("Short-tailed bat", 100.0)], "Long Tail": [("Long-tailed bat", 100.0), ("Short-tailed bat", 50.0)], "Short Tail": [("Short-tailed bat", 100.0)], "Possible": [("Long-tailed bat", 50.0)], "Non-bat": [("Kiwi", 100.0)]}
    df = spark.createDataFrame([(k, [(s, c) for s, c in v]) for k, v in [*kinds.items()]] + [("Non-bat", [])], "want string, labels array<struct<species: string, certainty: double>>")
    assert all(r.want == r.got for r in df.select("want", labels.bat_category(F.col("labels")).alias("got")).collect())


def test_common_subsequence_itself():
    import random
    from itertools import combinations

    from fieldsong.operators.clustering import common_subsequence, subsequence

    rng = random.Random(3)
    inside = lambda x, y: all(any(v == w for w in it) for it in [iter(y)] for v in x)
    for _ in range(60):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 7))] for _ in range(2))
        got = subsequence(a, b)
        longest = next(k for k in range(len(a), -1, -1) if any(inside(c, b) for c in combinations(a, k)))
        assert len(got) == longest == common_subsequence(np.array(a), np.array(b)) and inside(got, a) and inside(got, b)


def test_training_is_spread_and_bands_are_worked_out_once(spark):
    """Little data is much work here: tasks share it, what pages give is handed on together, and energies meet a list of nodes."""
    rng = np.random.default_rng(8)
    pages = spark.createDataFrame([(f"f{k}", 0, 64, rng.normal(size=64 * 6).tolist()) for k in range(40)], "file_id string, page int, fs int, samples array<double>").repartition("file_id")
    truth = spark.createDataFrame([(f"f{k}", w, int(w % 3 == 1)) for k in range(40) for w in range(6)], "file_id string, win int, present int")
    energies = wavelets.node_energies(pages, list(range(15, 63)), 1.0, wavelets.daubechies(4))
    nodes = recognise.candidate_nodes(energies, truth, node_functions.node_bands(spark, 5, 64), 2.0, 30.0)
    assert "POWER" not in nodes._jdf.queryExecution().optimizedPlan().toString().upper()
    peaks = recognise.node_peaks(pages, nodes, truth, [0.05], wavelets.daubechies(4))
    assert peaks.select(F.spark_partition_id().alias("p")).distinct().count() > 1

    class Pages:
        select = lambda self, *names: self
        mapInPandas = lambda self, run, schema: run

    run = wavelets.node_energies(Pages(), [15, 16], 1.0, wavelets.daubechies(4))
    batch = pd.DataFrame({"file_id": [f"f{k}" for k in range(40)], "page": 0, "fs": 64, "samples": [rng.normal(size=384) for _ in range(40)]})
    (got,) = run(iter([batch]))
    assert len(got) == 40 * 2 * 6 and got.groupby(["file_id", "node"])["win"].apply(list).map(lambda w: w == list(range(6))).all()

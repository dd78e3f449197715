"""Batch detection from samples to segments."""

import numpy as np

from fieldsong.operators import detect

FILTERS = "filter_id string, species string, sample_rate int, calltype string, thr double, nodes array<int>, time_range array<double>"


def test_a_call_is_found_where_it_is(spark):
    fs, rng = 8000, np.random.default_rng(0)
    x = rng.standard_normal(fs * 40) * 0.01
    for at in (10, 13, 30):  # the first two are joined over the gap
        x[at * fs : (at + 2) * fs] += np.sin(2 * np.pi * 2500 * np.arange(2 * fs) / fs)
    pages = spark.createDataFrame([("f", 1, 300 * fs, fs, [float(v) for v in x])], "file_id string, page int, start_sample long, fs int, samples array<double>")
    filters = spark.createDataFrame([("k", "kiwi", fs, "male", 0.8, [6], [1.0, 60.0, 0.0, 2.0]), ("n", "none", fs, "x", 50.0, [5], [1.0, 60.0, 0.0, 2.0])], FILTERS)
    got = sorted((r.filter_id, r.species, r.s - 300, r.e - 300) for r in detect.batch(pages, filters).collect())
    assert [g[:2] for g in got] == [("k", "kiwi")] * 2
    assert abs(got[0][2] - 10) <= 1.01 and abs(got[0][3] - 15) <= 1.01 and abs(got[1][2] - 30) <= 1.01 and abs(got[1][3] - 32) <= 1.01


def test_long_calls_are_split_and_short_ones_dropped(spark):
    windows = spark.createDataFrame([("f", 0, "k", "male", w, int(w < 9 or w == 20)) for w in range(30)], "file_id string, page int, filter_id string, calltype string, win int, present int")
    filters = spark.createDataFrame([("k", "kiwi", 8000, "male", 0.8, [6], [2.0, 3.0, 0.0, 1.0])], FILTERS)
    starts = spark.createDataFrame([("f", 0, 0.0)], "file_id string, page int, page_start double")
    got = sorted((r.s, r.e) for r in detect.detected_segments(windows, filters, 1.0, starts).collect())
    assert got == [(0.0, 3.0), (3.0, 6.0), (6.0, 9.0)]


def test_no_recognisers(spark):
    pages = spark.createDataFrame([("f", 0, 8000, [0.0] * 100)], "file_id string, page int, fs int, samples array<double>")
    assert detect.batch(pages, spark.createDataFrame([], FILTERS)).count() == 0

"""Interval operators on small cases, and against plain loops on random ones."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fieldsong.operators import align, intervals, survey
from fieldsong.plans import interval_queries


def frame(spark, rows, columns="s double, e double, certainty double"):
    return spark.createDataFrame([("a", k, *r) for k, r in enumerate(rows)], f"rec string, ord int, {columns}")


def spans(df, *more):
    return sorted(tuple(r[c] for c in ("s", "e", *more)) for r in df.collect())


@pytest.mark.parametrize(
    ("given", "want"),
    [
        ([(1, 3), (2, 4), (5, 7), (7, 8)], [(1, 4), (5, 7), (7, 8)]),
        ([(0, 10), (1, 2), (9, 12)], [(0, 12)]),
        ([(5, 5), (5, 7)], [(5, 5), (5, 7)]),
        ([(1, 2)], [(1, 2)]),
    ],
)
def test_overlapping_ones_merge_and_touching_ones_do_not(spark, given, want):
    df = frame(spark, [(float(s), float(e), 0.0) for s, e in given])
    assert spans(intervals.merge_overlapping(df, ["rec"])) == [(float(s), float(e)) for s, e in want]


@pytest.mark.parametrize(("gap", "given", "want"), [(3, [(1, 2), (3, 4)], [(1, 4)]), (0, [(1, 2), (2, 3)], [(1, 3)]), (0.5, [(1, 2), (3, 4)], [(1, 2), (3, 4)])])
def test_gaps_join(spark, gap, given, want):
    df = frame(spark, [(float(s), float(e), 0.0) for s, e in given])
    assert spans(intervals.join_gaps(df, ["rec"], gap)) == [(float(s), float(e)) for s, e in want]


def test_certainty_is_the_mean_of_the_pieces(spark):
    strict = frame(spark, [(1.0, 3.0, 50.0), (2.0, 5.0, 70.0)])
    assert spans(intervals.merge_overlapping(strict, ["rec"], "certainty"), "certainty") == [(1, 5, 60)]
    apart = frame(spark, [(1.0, 2.0, 50.0), (3.0, 5.0, 70.0)])
    assert spans(intervals.join_gaps(apart, ["rec"], 3, "certainty"), "certainty") == [(1, 5, 60)]


def test_random_intervals_join_as_a_loop_would(spark):
    rng = random.Random(2)
    rows = [(float(s), float(s + rng.randint(0, 6)), 0.0) for s in (rng.randint(0, 60) for _ in range(40))]
    want = []
    for s, e, _ in sorted(rows, key=lambda r: r[0]):
        if want and s - want[-1][1] <= 1:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    assert spans(intervals.join_gaps(frame(spark, rows), ["rec"], 1)) == sorted(map(tuple, want))


def test_short_ones_go_and_long_ones_are_split(spark):
    df = frame(spark, [(1.0, 3.0, 50.0), (4.0, 5.0, 50.0)])
    assert spans(intervals.drop_short(df, 1.5)) == [(1, 3)]
    assert spans(intervals.split_long(frame(spark, [(1.0, 5.0, 50.0)]), 2)) == [(1, 3), (3, 5)]


def test_an_interval_across_a_chunk_edge_is_in_both(spark):
    got = intervals.split_to_chunks(frame(spark, [(895.0, 905.0, 0.0)]), 900.0)
    assert sorted((r.chunk, r.cs, r.ce) for r in got.collect()) == [(0, 895.0, 900.0), (1, 0.0, 5.0)]


def test_bins_that_an_interval_touches(spark):
    df = frame(spark, [(1.0, 3.0, 0.0)])
    assert sorted(r.bin for r in intervals.bins_of(df, 1.0).collect()) == [1, 2]
    wide = frame(spark, [(0.96, 3.04, 0.0)])
    assert sorted(r.bin for r in intervals.bins_of(wide, 1.0).collect()) == [0, 1, 2, 3]
    assert sorted(r.bin for r in intervals.bins_of(wide, 1.0, F.lit(2)).collect()) in ([0, 1], [0, 1, 2])
    assert intervals.bins_of(frame(spark, [(2.0, 2.0, 0.0)]), 1.0).count() == 0


def test_runs_of_ones(spark):
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([0, 1, 1, 1, 0, 1])], "rec string, i int, on int")
    assert spans(intervals.run_lengths(df, ["rec"], "i", "on")) == [(1, 4), (5, 6)]


def test_overlap_pairs_match_brute_force(spark):
    rng = random.Random(4)
    rows = lambda n: [(rng.choice("xy"), k, float(s), float(s + rng.randint(0, 30))) for k, s in enumerate(rng.randint(0, 200) for _ in range(n))]
    a, b = rows(40), rows(40)
    left = spark.createDataFrame(a, "pair string, ord int, s double, e double")
    right = spark.createDataFrame(b, "pair string, ord2 int, s2 double, e2 double")
    got = {(r.ord, r.ord2) for r in align.overlap_pairs(left, right, ["pair"], 25.0).collect()}
    assert got == {(x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3]}
    assert align.overlap_pairs(left, right, ["pair"], 25.0).count() == len(got)


def test_recorders_linked_in_a_chain_are_one_group(spark):
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 3, 5.0), (7, 9, 1.0)], "a int, b int, shift double")
    got = {r.recorder: (r.root, abs(r["shift"])) for r in align.recorder_groups(edges).collect()}
    assert got == {1: (1, 0), 2: (1, 5), 3: (1, 10), 7: (7, 0), 9: (7, 1)}


def test_best_shift_of_all_intervals_and_601_shifts(spark, tmp_path):
    """Two recorders with clocks 200 hops apart."""
    rng = random.Random(4)
    t0, rows = 1704067200, []
    for k in range(40):
        at = t0 + rng.randint(0, 20 * 86400)
        rows += [(2 * k, 2, "view", at, 1.0 + rng.random()), (2 * k + 1, 3, "view", at + 200 * 600, 1.0 + rng.random())]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, t long, value double")
    df.selectExpr("event_id", "user_id", "event_type", "timestamp_seconds(t) as ts", "value").write.parquet(f"{tmp_path}/events.parquet")
    ms = lambda t: math.floor(t * 1000)  # noqa: E731  times are whole milliseconds
    a, b = ([(ms(t), ms(t + v * 600)) for _, u, _, t, v in rows if u == n] for n in (2, 3))
    want = {}
    for k in range(-300, 301):
        total = sum(max(0, min(e + k * 600_000, e2) - max(s + k * 600_000, s2)) for s, e in a for s2, e2 in b) / 1000
        if total > 0:
            want[k] = total
    got = {r["shift"]: r.overlap for r in interval_queries.shift_overlaps(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in want)
    best = interval_queries.best_shift(spark, str(tmp_path)).collect()
    assert [(r.pair, r["shift"]) for r in best] == [(1, 200)] and max(want, key=want.get) == 200


def test_a_chain_of_over_32_recorders_is_one_group(spark):
    edges = spark.createDataFrame([(k, k + 1, 2.0) for k in range(36)], "a int, b int, shift double")
    got = {r.recorder: (r.root, abs(r["shift"])) for r in align.recorder_groups(edges).collect()}
    assert got == {k: (0, 2.0 * k) for k in range(37)}


def test_an_interval_without_length_matches_none(spark):
    a = spark.createDataFrame([("x", 1, 5.0, 5.0), ("x", 2, 4.0, 6.0)], "pair string, ord int, s double, e double")
    b = spark.createDataFrame([("x", 7, 0.0, 9.0)], "pair string, ord2 int, s2 double, e2 double")
    assert [(r.ord, r.ord2, r.overlap) for r in align.best_match(a, b, ["pair"], ["ord"], 25.0).collect()] == [(2, 7, 2.0)]


def test_overlap_counts_of_an_interval_without_length(spark):
    df = spark.createDataFrame([("x", 1, 0.0, 9.0), ("x", 2, 5.0, 5.0), ("x", 3, 6.0, 7.0)], "rec string, ord int, s double, e double")
    count = lambda **how: {r.ord: r.overlaps for r in intervals.overlap_counts(df, ["rec"], **how).collect()}
    assert count() == {1: 2, 2: 1, 3: 0}
    assert count(own=True) == {1: 2, 2: 0, 3: 0}


def test_generated_recordings_are_not_broadcast(spark):
    sheet = spark.createDataFrame([("x", 1, 900.0), ("x", 2, 900.5), ("x", 3, 0.0), ("y", 4, 10.0)], "rec string, ord int, end_s double")
    starts = spark.createDataFrame([("x",)], "rec string").withColumn("start_s", F.explode(F.sequence(F.lit(0), F.lit(1800), F.lit(900)).cast("array<double>")))
    got = survey.matched_rows(sheet, starts, ["rec"], 900.0, F.lit(20.0))
    assert sorted((r.ord, r.start_s, r.s, r.e) for r in got.collect()) == [(1, 0.0, 880.0, 900.0), (2, 900.0, -19.5, 0.5)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()

import numpy as np
import pytest

from fieldsong.llm import vectors


def exact(rows, k=5):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in (i for i in ok if i % 50 == 0):
        s = [(-round(float(ok[q] @ v / np.sqrt((ok[q] @ ok[q]) * (v @ v))), 12), i) for i, v in ok.items() if i != q]
        out[q] = sorted(s)[:k]
    return out


def test_recall_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[300:700] = x[299]  # a vector that many rows share
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1050, [0.0] * 8), (1100, [None] + [1.0] * 7), (1150, [float("nan")] + [1.0] * 7), (1200, [float("inf")] * 8), (1250, [1.0]), (None, [1.0] * 8), (5, x[5].tolist())]
    df = spark.createDataFrame([(*r, 1, 0.5, 2) for r in rows], "vec_id long, embedding array<float>, label int, score double, rank int")
    got, wanted = {}, exact(rows)
    for r in vectors.nearest(df).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == set(wanted)
    hit = 0
    for q, best in wanted.items():
        assert sorted(got[q]) == [1, 2, 3, 4, 5]
        score = dict((i, -s) for s, i in exact(rows, 2000)[q])
        assert all(abs(score[i] - s) < 1e-9 for i, s in got[q].values())
        assert [(-round(s, 12), i) for i, s in (got[q][k] for k in range(1, 6))] == sorted((-round(s, 12), i) for i, s in got[q].values())
        hit += len({i for _, i in best} & {i for i, _ in got[q].values()})
    assert hit / (5 * len(wanted)) >= 0.9
    assert [got[350][k][0] for k in range(1, 6)] == [299, 300, 301, 302, 303]


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_few_rows(spark, n):
    rows = [(50 * i, [1.0, float(i)]) for i in range(n)]
    got = vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == n * max(0, n - 1)


def test_lists_that_hold_too_few(spark, monkeypatch):
    monkeypatch.setattr(vectors, "WITHIN", 0.0)
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 4)))], "vec_id long, embedding array<double>")
    got = vectors.nearest(df).groupBy("query_id").count().collect()
    assert {r["count"] for r in got} == {5} and len(got) == 4


def test_very_large_and_very_small_components(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    rows = [(i, (v * 10.0 ** rng.choice([-300, -200, 0, 200, 300])).tolist()) for i, v in enumerate(x)] + [(100, [1e-200, 0.0]), (150, [1e200, 1.0]), (200, [5e-324, 0.0])]
    got = {}
    for r in vectors.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {0, 50, 100, 150, 200} and all(len(v) == 5 for v in got.values())
    plain = dict(rows)
    angle = lambda v: np.arctan2(*(np.array(v) / np.abs(v).max()))
    for q, found in got.items():
        assert all(abs(s - np.cos(angle(plain[q]) - angle(plain[i]))) < 1e-9 for i, s in found)
    assert dict(got[100])[200] == 1.0


@pytest.mark.parametrize("kind", ["near copies", "one direction", "mixed"])
def test_vectors_closer_than_codewords_are_told_apart(kind):
    import pandas as pd

    rng = np.random.default_rng(5)
    centres = rng.standard_normal((6, 64))
    x = {
        "near copies": centres[rng.integers(0, 6, 6000)] + 0.0005 * rng.standard_normal((6000, 64)),
        "one direction": 3 + 0.02 * rng.standard_normal((6000, 64)),
        "mixed": np.concatenate([rng.standard_normal((3000, 64)), centres[0] + 0.003 * rng.standard_normal((3000, 64))]),
    }[kind].astype(np.float32)
    index, at = vectors.fit(x, len(x)), np.arange(0, len(x), 100)
    own, codes = vectors.encode(index, x)
    rows = pd.DataFrame({"rep": np.arange(len(x)), "vector": list(x), "list": own, "codes": [c.tobytes() for c in codes]})
    asked = pd.DataFrame({"rep": at, "vector": list(x[at]), "lists": [np.arange(len(index.centroids))] * len(at)})
    got = vectors.search_group(index, asked, rows, 6).groupby("q_rep")["rep"].apply(set)
    near = np.argsort(-(vectors.unit(x[at]) @ vectors.unit(x).T), axis=1, kind="stable")[:, :6]
    assert np.mean([len(got[a] & set(b)) / 6 for a, b in zip(at, near)]) > 0.99

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from fieldsong.llm import language, quality

SYLLABLES = {"aa": ["ba", "lo", "mi", "ta"], "bb": ["sch", "ung", "ich", "ker"], "cc": ["oux", "elle", "tre", "ión"]}


def made(n=240, seed=1):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(SYLLABLES[k]) for _ in range(rng.randint(1, 3)))
    return [(i, " ".join(word(k) for _ in range(rng.randint(5, 80))), k) for i, k in ((i, rng.choice(list(SYLLABLES))) for i in range(n))]


def test_learned_languages_are_told_apart(spark, odd):
    docs = spark.createDataFrame(made(), "doc_id long, text string, lang string")
    model = language.fit(language.training_rows(docs))
    found = {r.doc_id: r for r in language.identify(docs, model).collect()}
    held = [i for i, _, _ in made() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in found.items() if r.held_out} == set(held)
    assert np.mean([found[i].lang_pred == k for i, _, k in made() if i in set(held)]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())
    rows = language.identify(odd, model).collect()
    assert len(rows) == odd.count()
    pred = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [pred[i].lang_pred for i in (3, 4, 5, 10)] == ["und"] * 4 and pred[3].score == 0
    assert pred[9].lang_pred in model.labels
    mixed = spark.createDataFrame([(1, " ".join(["balomi"] * 20 + ["schungker"] * 20)), (2, None)], "doc_id long, text string")
    spans = {r.doc_id: [(x.lang, x.words) for x in r.s] for r in mixed.select("doc_id", language.language_spans(model, F.col("text")).alias("s")).collect()}
    assert [k for k, _ in spans[1]] == ["aa", "bb"] and sum(n for _, n in spans[1]) == 40 and spans[2] == []


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    model = language.Model(["a", "b"], np.zeros((1, 2)), {}, np.zeros((0, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    lengths = np.array([4, 1, 0, 6, 6])
    scores = rng.normal(size=(lengths.sum(), 2)).astype(np.float32)
    got, at = language.posteriors(model, scores, lengths), 0
    for n in lengths:
        s, p = scores[at : at + n], np.zeros((n, 2))
        for code in range(2**n):
            path = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(s[k, y] for k, y in enumerate(path)) + (model.start[path[0]] if n else 0) + sum(model.steps[a, b] for a, b in zip(path, path[1:])))
            for k, y in enumerate(path):
                p[k, y] += w
        if n:
            assert np.allclose(got[at : at + n], p / p.sum(axis=1, keepdims=True), atol=1e-4)
        at += n


def test_nothing_to_learn_from(spark, odd, none):
    model = language.fit(language.training_rows(none))
    assert {r.lang_pred for r in language.identify(odd, model).collect()} == {"und"}
    assert language.identify(none, model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    votes = quality.classify(odd, quality.learn(odd, labels))
    assert {(r.score, r.predicted) for r in votes.collect()} == {(0.5, 1)}
    assert quality.classify(none, quality.learn(none, labels)).count() == 0


def test_junk_is_voted_down(spark, odd):
    rng = random.Random(2)
    rows = made(300, 4)
    bad = {i for i, _, _ in rows if rng.random() < 0.3}
    junk = lambda t: " ".join(w.upper() + "!!" for w in t.split())
    docs = spark.createDataFrame([(i, junk(t) if i in bad else t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i not in bad), 0) for i, _, _ in rows] + [(1, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.learn(docs, labels)
    found = quality.classify(docs, model).collect()
    assert np.mean([r.predicted == int(r.doc_id not in bad) for r in found if r.held_out]) > 0.97
    again = {r.doc_id: r.score for r in quality.classify(docs.repartition(5), quality.learn(docs.repartition(3), labels)).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in found)
    assert all(0 <= r.score <= 1 for r in quality.classify(odd, model).collect())


def test_terms_do_not_depend_on_runs(monkeypatch):
    text = (b"word worse other. " * 40)[:-1]
    whole = quality.terms_of(text)
    for run in (1, 5, 17):
        monkeypatch.setattr(quality, "RUN", run)
        got = quality.terms_of(text)
        assert np.array_equal(got[: quality.REPEATS], whole[: quality.REPEATS])
        assert np.array_equal(got[quality.FIRST_WORD :], whole[quality.FIRST_WORD :])


def test_columns_named_like_our_own_are_no_matter(spark, odd, odd_rows):
    """Documents and labels may have columns with the names that learning uses in its joins."""
    labels = spark.createDataFrame([(i, i % 2, 7, 7, "x") for i, *_ in odd_rows if i is not None], "doc_id long, quality int, l_id int, label int, d_id string")
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    a, b = quality.learn(odd, labels), quality.learn(plain, labels.select("doc_id", "quality"))
    assert len(a.labels) and all(np.allclose(x, y) for x, y in zip(a, b))
    assert language.training_rows(odd) == language.training_rows(plain) != []


def test_votes_against_brute_force():
    """Cosines of all labelled vectors, sorted by cosine and place; many are equal."""
    rng = np.random.default_rng(3)
    pool = rng.normal(size=(40, 6))
    vectors = quality._unit(pool[rng.integers(0, 40, 300)])
    labels, shares = rng.integers(0, 2, 300), rng.uniform(1, 3, 300)
    model = quality.Model(None, None, vectors, labels, shares, 0.5, 1.0)
    v = quality._unit(np.concatenate([pool[:10], rng.normal(size=(20, 6))]))
    for x, got in zip(v, quality.voted(model, v)):
        cosines = [round(float(c), quality.PLACES) for c in vectors @ x]
        first = sorted(range(300), key=lambda i: (-cosines[i], i))[: quality.NEIGHBOURS]
        weights = [max(cosines[i], 0) * shares[i] for i in first]
        assert abs(got - sum(w * labels[i] for w, i in zip(weights, first)) / sum(weights)) < 1e-5


def test_scores_against_brute_force(spark):
    """The whole operator on few documents: terms, rarity, singular vectors (by numpy's own decomposition), votes, power."""
    docs = spark.createDataFrame(made(120, 9), "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(k == "aa")) for i, _, k in made(120, 9)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    rows = [(i, t, int(k == "aa")) for i, t, k in made(120, 9)]
    own = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    x = quality.damped(np.stack([quality.terms_of(t.encode()) for _, t, _ in own]))
    rarity = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1
    _, _, axes = np.linalg.svd(x * rarity, full_matrices=False)
    axes = axes[: quality.DIMENSIONS].T
    project = lambda y: (y * rarity) @ axes / np.linalg.norm((y * rarity) @ axes, axis=1, keepdims=True)
    near = project(quality.damped(np.stack([quality.terms_of(t.encode()) for _, t, _ in rows]))) @ project(x).T
    found = {r.doc_id: r.score for r in quality.classify(docs, model).collect()}
    good = np.array([k for _, _, k in own])
    off = []
    for (i, _, _), row in zip(rows, near):
        first = np.lexsort((np.arange(len(row)), -np.round(row, quality.PLACES)))[: quality.NEIGHBOURS]
        w = np.maximum(row[first], 0)
        off.append(abs((w @ good[first] / w.sum()) ** model.power - found[i]))
    assert np.median(off) < 0.02 and max(off) < 0.25  # the singular vectors are found by iteration


def test_repeated_and_long_texts(spark):
    docs = spark.createDataFrame([(1, "ab cd " * 400_000), (1, "ab cd " * 400_000), (2, "xy"), (2, "xy"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    scores = [(r.doc_id, r.score) for r in quality.classify(docs, quality.learn(docs, labels)).collect()]
    assert len(scores) == 5 and len(set(scores)) == 3
    model = language.fit([("aa", ["ab", "cd"] * 30), ("bb", ["xy", "zz"] * 30)])
    found = [(r.doc_id, r.lang_pred) for r in language.identify(docs, model).collect()]
    assert sorted(found) == [(1, "aa"), (1, "aa"), (2, "bb"), (2, "bb"), (3, "und")]


def test_scores_do_not_depend_on_the_block():
    """A text's score is the same number alone, among a few and among many."""
    rng = np.random.default_rng(4)
    counts = np.stack([quality.terms_of(t.encode()) for _, t, _ in made(300, 6)])
    pool = rng.normal(size=(quality.TERMS, 48)).astype(np.float32)
    weights = rng.uniform(1, 8, quality.TERMS).astype(np.float32)
    x = quality.damped(counts)
    vectors = quality._unit((x * weights) @ pool)
    model = quality.Model(weights, pool, vectors, rng.integers(0, 2, 300), rng.uniform(1, 3, 300), 0.5, 0.7)
    whole = quality.score_block(model, x)
    for size in (1, 2, 3, 7, 64, 100):
        assert np.array_equal(np.concatenate([quality.score_block(model, x[a : a + size]) for a in range(0, len(x), size)]), whole)

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from fieldsong.llm import toxicity as T

LABELS = "doc_id long, quality int, toxic int, text string, source string, lang string"


def made(n=500, seed=2):
    """Toxic texts hold words that begin with grob and an insult; clean ones the bare grob and quiet words."""
    rng = random.Random(seed)
    quiet = ["morning", "grob", "river", "table", "and", "the", "slowly", "green", "garden", "walks"]
    docs = []
    for i in range(n):
        toxic = rng.random() < 0.25
        words = [rng.choice(quiet) for _ in range(rng.randint(8, 60))]
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["grob" + "".join(rng.choice("xyzq") for _ in range(3)), "nitwit"]))
        docs.append((i, " ".join(words) + ".", int(toxic)))
    return docs


def model_of(spark, docs):
    texts = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y, None, None, None) for i, _, y in docs], LABELS)
    return texts, T.learn(texts, labels)


def test_learned_insults_and_beginnings(spark, odd):
    docs = made()
    texts, model = model_of(spark, docs)
    assert "nitwit" in model.words and "grob" in model.stems and model.words["grob"] == 0 and "nit" not in model.stems
    rows = {r.doc_id: r for r in T.classify(texts, model).collect()}
    held = {i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {i for i, r in rows.items() if r.held_out} == held
    assert np.mean([rows[i].predicted == y for i, _, y in docs if i in held]) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    again = T.learn(texts.repartition(5), spark.createDataFrame([(i, 1, y, None, None, None) for i, _, y in docs], LABELS))
    assert again.words == model.words and again.stems == model.stems and abs(again.offset - model.offset) < 1e-9
    out = T.classify(odd, model).collect()
    assert len(out) == odd.count() and {r.predicted for r in out} == {0} and all(r.held_out for r in out if r.doc_id is None)


def test_nothing_learned_from_held_out_rows(spark):
    docs = [(i, t, y if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - y) for i, t, y in made()]
    assert model_of(spark, docs)[1].stems == model_of(spark, made())[1].stems


def test_tables_without_labels_or_rows(spark, odd, none):
    labels = spark.createDataFrame([], LABELS)
    assert {(r.score, r.predicted) for r in T.classify(odd, T.learn(odd, labels)).collect()} == {(0.5, 1)}
    assert T.classify(none, T.learn(none, labels)).collect() == []
    clean = spark.createDataFrame([(i, 1, 0, None, None, None) for i in range(60)] + [(1, 1, None, None, None, None), (2, 1, 7, None, None, None)], LABELS)
    assert {r.predicted for r in T.classify(odd, T.learn(odd, clean)).collect()} == {0}


def by_hand(symbols):
    """The grammar in words: what a clause scores."""
    reported = quoted = target = False
    reach, total, waiting = 0, 0.0, False
    for c in symbols:
        soft, denied, reach = reported or quoted, reach > 0, reach if c == T.QUOTE else max(0, reach - 1)
        if c == T.REPORT:
            reported = True
        elif c == T.QUOTE:
            quoted = not quoted
        elif c == T.NEGATION:
            reach = T.REACH
        elif c == T.TARGET:
            total += T.THREAT_STRENGTH if waiting else 0
            target, waiting = True, False
        elif c == T.THREAT and not soft and not denied:
            total += T.THREAT_STRENGTH if target else 0
            waiting = not target
        elif c >= T.INSULT:
            total += (c - T.INSULT) * T.STEP * (0.4 if denied else 0.6 if soft else 1)
    return total * (T.LIFT if target else 1)


def test_composed_machine_equals_the_grammar_in_words():
    rng = random.Random(1)
    for _ in range(3000):
        clause = bytes(rng.choice([0, 0, 2, 3, 4, 5, 6, 6, 8, 20]) for _ in range(rng.randint(0, 12)))
        assert abs(T.clause_score(clause) - by_hand(clause)) < 1e-9, list(clause)


def test_composition_is_one_after_the_other():
    first, second = T.reported(), T.negated()
    both = T.compose(first, second)
    rng = random.Random(7)
    for _ in range(300):
        s = x = y = 0
        for _ in range(15):
            c = rng.choice(list(T.CLASSES))
            s, out, w = both.arcs[s, c]
            x, middle, v = first.arcs[x, c]
            y, want, u = second.arcs[y, middle]
            assert (out, w) == (want, v * u)
        assert both.ends[s] == first.ends[x] * second.ends[y]


def test_clauses(spark):
    model = T.Model({"oaf": 4.0}, {"nas": 2.0}, np.zeros(T.FACTS), np.ones(T.FACTS), np.ones(T.FACTS), 0.0)
    texts = ["Fine day. You are an oaf! So it is", "She said: he is an oaf", "You are not an oaf", "I will kill you; really", "they kill time. you wait", "Nasty nas", "", None, "oaf " * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: [(x.clause, x.score) for x in r.c] for r in df.select("doc_id", T.toxic_clauses(model, F.col("text")).alias("c")).collect()}
    assert found[0] == [("you are an oaf", 6.0)]
    assert [round(s, 6) for _, s in found[1]] == [3.6] and [round(s, 6) for _, s in found[2]] == [2.4]
    assert found[3] == [("i will kill you", 4.5)] and found[5] == [("nasty nas", 2.0)]
    assert found[4] == [("they kill time", 4.5)] and found[6] == found[7] == [] and found[8][0][1] == 12
    long = T.Lexicon(model.words, model.stems).facts("word " * 200_000 + "oaf")
    assert long[2] == 1 and long[4] == 200_001

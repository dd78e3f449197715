import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from fieldsong.llm import search as S

ITEMS = "item_id long, text string, term string, top long, score long"


def brute(docs, items, k):
    """item_id -> (score, doc_id) of its k best, by the definition."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    bags = [(i, Counter(cut(t))) for i, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(cut(t))
    out = {}
    for i, terms in wanted.items():
        found = []
        for d, b in bags:
            m = 100 - 50 + (50 * sum(b.values()) * n_docs) // max(1, n_terms)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in terms if b[t])
            if s > 0:
                found.append((-s, d is None, d))
        out[i] = [(-s, d) for s, _, d in sorted(found, key=lambda x: x[:2] + (x[2] or 0,))[:k]]
    return {i: x for i, x in out.items() if x}


def got(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0, r.rank)):
        out.setdefault(r.item_id, []).append((r.score, r.doc_id))
        assert r.rank == len(out[r.item_id])
    return out


@pytest.mark.parametrize("bounds", [{}, {"BLOCK_ENTRIES": 20, "CELLS": 3, "ADDED": 2, "SALTS": 3}])
def test_equals_the_definition(spark, odd, odd_rows, monkeypatch, bounds):
    for name, n in bounds.items():
        monkeypatch.setattr(S, name, n)
    rng = random.Random(5)
    texts = [t for _, t, *_ in odd_rows if t]
    some = lambda: " ".join(rng.choice(rng.choice(texts).split() or ["x"]) for _ in range(rng.randint(1, 12)))
    items = [(k, some()) for k in range(12)] + [(20, None), (21, ""), (22, " .,- "), (23, "nowhere-at-all"), (24, "a A a b"), (25, texts[5]), (24, "c"), (None, "漢字 one"), (0, "h")]
    table = spark.createDataFrame([(*x, None, None, None) for x in items], ITEMS)
    docs = [(r[0], r[1]) for r in odd_rows]
    for k in (3, 50):
        assert got(S.search(odd, table, k).collect()) == brute(docs, items, k)


def test_common_terms_bring_no_candidates(spark):
    # Half of the texts have all common terms; a rare one, in ten texts, decides the three best.
    docs = [(i, "the of and " * (1 + i % 2) + f"own{i} " + ("rare " * 3 if i % 40 == 0 else "") + "x " * (i % 7)) for i in range(400)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    items = [(1, "The rare of"), (2, "the and of")]
    found = got(S.search(table, spark.createDataFrame(items, "item_id long, text string"), 3).collect())
    assert found == brute(docs, items, 3) and all(d % 40 == 0 for _, d in found[1])
    entries = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "item_id long, term int")
    stored = spark.createDataFrame([(0, 5, 9), (1, 40, 60), (2, 7, 30)], "term int, kth long, top long")
    assert {r.term: (r.least, r.leads) for r in S.leading(entries, stored).collect()} == {0: (40, False), 2: (40, False), 1: (40, True)}


def test_empty_tables(spark, odd, none):
    items = spark.createDataFrame([(1, "one", None, None, None)], ITEMS)
    assert S.search(none, items).collect() == [] and S.search(odd, items.limit(0)).collect() == []
    assert S.search(none, items).columns == S.search(odd, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_largest_of_each_key():
    rng = np.random.default_rng(2)
    keys, values, ties = rng.integers(0, 5, 200), rng.integers(0, 9, 200), rng.permutation(200)
    at = S.largest(keys, values, ties, 4)
    for k in range(5):
        want = sorted((-v, t) for key, v, t in zip(keys, values, ties) if key == k)[:4]
        assert [(-values[i], ties[i]) for i in at if keys[i] == k] == want

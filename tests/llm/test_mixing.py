import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

import pytest

from fieldsong.llm import mixing


def by_hand(sizes):
    """Targets by resharing: stop at twice the size, share the excess by weight among the rest."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * sizes[s] < level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


@pytest.mark.parametrize("cell", [20_000, 7])
def test_taken_words_meet_targets(odd, odd_rows, monkeypatch, cell):
    monkeypatch.setattr(mixing, "CELL_ROWS", cell)
    rows = mixing.taken_per_document(odd).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id or 0, r["size"]) for r in rows) == sorted((i or 0, count(t)) for i, t, *_ in odd_rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for _, t, _, s, _ in odd_rows:
        sizes[s] += count(t)
    for r in rows:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r["size"] and r.source_size == sizes[r.source]
    wanted = by_hand(sizes)
    for r in rows:
        assert r.target == pytest.approx(wanted[r.source])
    for s in sizes:
        assert abs(taken[s] - wanted[s]) <= 1
    again = mixing.taken_per_document(odd.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_places_follow_finish_times(odd):
    rows = sorted((r for r in mixing.mix(odd).collect() if r.place is not None), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(len(rows)))
    order = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    upto, last = defaultdict(int), 0.0
    all_sources = sorted({r.source for r in mixing.mix(odd).collect()}, key=lambda s: (s is None, s or ""))
    for r in rows:
        upto[r.source] += r.taken
        finish = upto[r.source] / (5, 2, 1)[all_sources.index(r.source) % 3]
        assert finish >= last - 1e-9
        last = finish
    assert order


def test_documents_are_cut_after_words(odd):
    took = {(r.doc_id, r["size"], r.digest, r.copy): r.taken for r in mixing.mix(odd).where("taken > 0").collect()}
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns
    got = mixed.select("doc_id", mixing.words_in(mixed.text).alias("n")).collect()
    assert sum(r.n for r in got) == sum(mixing.mix(odd).agg({"taken": "sum"}).first())
    assert len(got) >= len(took)


def test_taken_against_brute_force(spark):
    """Queues served step by step: in each step all sources go on until one copy ends or the budget is spent."""
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 3, 9, 200]))), rng.choice(["a", "a", "a", "b", None, "c"])) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    queues = defaultdict(list)
    for i, t, s in rows:
        spot = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:15], 16)
        queues[s].append((spot, i, len(t.split())))
    order = sorted(queues, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction((5, 2, 1)[k % 3]) for k, s in enumerate(order)}
    left = {s: [[i, n] for _, i, n in sorted(q) * 2 if n] for s, q in queues.items()}
    budget, taken = Fraction(3, 2) * sum(n for q in queues.values() for *_, n in q), defaultdict(Fraction)
    while budget > 0:
        open_ = [s for s in left if left[s]]
        step = min([left[s][0][1] / weight[s] for s in open_] + [budget / sum(weight[s] for s in open_)])
        for s in open_:
            i, n = left[s][0]
            taken[i] += step * weight[s]
            left[s][0][1] -= step * weight[s]
            budget -= step * weight[s]
            if not left[s][0][1]:
                left[s].pop(0)
    got = {r.doc_id: r.taken for r in mixing.taken_per_document(docs).collect()}
    assert len(got) == len(rows)
    assert all(abs(got[i] - taken[i]) < 1.001 for i in got)


def test_the_cut_decides(spark, odd):
    """With a smaller budget and the same targets' weights the mix is a prefix of the larger one."""
    rows = lambda share: {(r.doc_id, r["size"], r.digest, r.copy): r.taken for r in mixing.mix(odd, share=share).where("taken > 0").collect()}
    small, large = rows(0.4), rows(1.2)
    assert small.keys() < large.keys() and all(n <= large[k] for k, n in small.items())
    assert sum(small.values()) < sum(large.values())


def test_empty(none):
    assert mixing.taken_per_document(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0

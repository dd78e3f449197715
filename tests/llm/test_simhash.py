import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from fieldsong.llm import components as component_operators
from fieldsong.llm import near_copies, simhash, words
from fieldsong.llm.components import components


def by_hand(text, n=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    parts = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def test_fingerprints_and_components_of_odd_texts(odd, odd_rows):
    found = simhash.near_duplicates(odd).withColumn("hex", simhash.hex_of(F.col("fp"))).collect()
    assert len(found) == len(odd_rows)
    fps = sorted({by_hand(t) for _, t, *_ in odd_rows})
    assert {r.hex for r in found} == {f"{f:016x}" for f in fps}
    root = roots(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2])
    least = {}
    for i, t, *_ in odd_rows:
        if i is not None:
            k = root[by_hand(t)]
            least[k] = min(least.get(k, i), i)
    for r in found:
        assert r.component_id == least.get(root[int(r.hex, 16)])


@pytest.mark.parametrize("crowded", [24, 2])
def test_links_join_all_within_two_bits(spark, monkeypatch, crowded):
    """Crowded postings go by meeting points: both ways give the groups of brute force."""
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    rng = random.Random(1)
    fps = {0, 1, 3, 2**63, 2**64 - 1}
    for _ in range(12):
        seed = rng.getrandbits(64)
        fps |= {seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(30)}
    signed = sorted(int(np.uint64(f).view(np.int64)) for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    pairs = [(a, b) for a in signed for b in signed if a < b]
    for d in (0, 1, 2):
        assert all(apart(r.a, r.b) <= d for r in simhash.links(df, d).collect())
        root = {r.node: r.root for r in components(simhash.links(df, d)).collect()}
        assert {f: root.get(f, f) for f in signed} == roots(signed, [p for p in pairs if apart(*p) <= d])


def test_tally_counts_shared_bytes(spark):
    """What is retained before any bits are compared is just what shares enough positional bytes."""
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = {base ^ sum(rng.randint(0, 255) << 8 * k for k in rng.sample(range(8), rng.randint(0, 4))) for _ in range(150)}
    signed = sorted(int(np.uint64(f).view(np.int64)) for f in fps)
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    shared = lambda a, b: sum((a >> 8 * k & 255) == (b >> 8 * k & 255) for k in range(8))
    for d, tallies in ((2, {6: 3, 7: 7}), (1, {7: 7})):
        want = {(a, b): tallies[shared(a, b)] for a in signed for b in signed if a < b and shared(a, b) in tallies}
        assert {(r.a, r.b): r.tally for r in simhash.tallied(simhash.postings(df), d).collect()} == want


def test_components_of_a_long_chain(spark):
    edges = [(k, k + 1) for k in range(100)] + [(200, 300), (300, 200), (7, 7), (250, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 101)}, 300: 200, 250: 200}


def test_runs_of_words_do_not_change_shingles(monkeypatch):
    text = b"a bb  ccc\td e f\x0bg " * 50
    whole = [x for part in words.ngram_runs(text, 3) for x in part]
    monkeypatch.setattr(words, "RUN_BYTES", 5)
    assert [x for part in words.ngram_runs(text, 3) for x in part] == whole
    assert [x for part in words.ngram_runs(b" one two ", 3) for x in part] == [b"one two"]


def _shingles(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} or ({" ".join(w)} if w else set())


def test_near_copies_against_brute_force(spark, odd, odd_rows):
    rng = random.Random(5)
    rows = [(i, t) for i, t, *_ in odd_rows if i is not None]
    for g in range(25):
        w = [f"w{rng.randint(0, 9999)}" for _ in range(rng.randint(80, 300))]
        rows.append((1000 + 40 * g, " ".join(w)))
        for c in range(1, rng.choice([2, 4, 15])):
            v = list(w)
            for _ in range(max(1, len(v) // 70)):
                v[rng.randrange(len(v))] = f"x{rng.randint(0, 9999)}"
            rows.append((1000 + 40 * g + c, " ".join(v)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(i, _shingles(t), t or "") for i, t in rows]
    linked = [(i, j) for i, a, s in sets for j, b, t in sets if i < j and (s == t or (not a and not b) or (a and b and len(a & b) / len(a | b) >= 0.8))]
    root = roots([i for i, _ in rows], linked)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == root
    kept = [r.doc_id for r in near_copies.one_of_each(docs).collect()]
    assert sorted(kept) == sorted(set(root.values()))
    assert near_copies.one_of_each(odd).columns == odd.columns


def _against_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(i, _shingles(t)) for i, t in rows]
    linked = [(i, j) for i, a in sets for j, b in sets if i < j and len(a & b) / len(a | b) >= 0.8]
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()}
    assert got == roots([i for i, _ in rows], linked)


def test_short_texts_with_words_added_at_the_ends(spark):
    rng = random.Random(6)
    rows = []
    for g in range(120):
        w = [f"w{rng.randint(0, 99999)}" for _ in range(rng.randint(6, 40))]
        longer = [[*w, f"y{g}"], [f"z{g}", *w], [f"z{g}", *w, f"y{g}"]]
        rows += [(10 * g + c, " ".join(v)) for c, v in enumerate([w, longer[g % 3]])]
    _against_brute_force(spark, rows)


def test_large_group_without_a_centre(spark):
    """Texts of widespread passages, alike only in pairs: a crowded passage does not keep a pair apart."""
    rng = random.Random(8)
    blocks = [[f"b{k}_{i}" for i in range(60)] for k in range(8)]
    rows = []
    for g in range(60):
        w = [x for k in rng.sample(range(8), 4) for x in blocks[k]]
        for c in range(2):
            v = list(w)
            v[5 + 7 * c] = f"x{g}_{c}"
            rows.append((10 * g + c, " ".join(v)))
    _against_brute_force(spark, rows)


def test_empty(none):
    assert simhash.near_duplicates(none).count() == 0
    assert near_copies.one_of_each(none).count() == 0


def test_candidates_are_compared_without_shuffling_texts(spark):
    keys = spark.range(5000).select((F.col("id") * 7919).alias("key"))
    rows = spark.range(40_000).select((F.col("id") * 7919 - 70_000_000).alias("id"))
    got = near_copies._maybe(rows, F.col("id"), near_copies.written(near_copies._members(keys)))
    kept = {r.id for r in got.collect()}
    assert {r.id for r in rows.join(keys, F.col("id") == F.col("key")).collect()} <= kept and len(kept) < 12_000
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("few", [100_000, 0])
def test_few_links_need_no_rounds(spark, monkeypatch, few):
    """A long chain, a star and pairs, in any order: the same groups by one task, which writes twice, as by rounds."""
    monkeypatch.setattr(component_operators, "FEW", few)
    tables = []
    monkeypatch.setattr(component_operators, "written", lambda df: tables.append(near_copies.written(df)) or tables[-1])
    rng = random.Random(4)
    name = rng.sample(range(-500, 500), 400)
    edges = [(name[i], name[i + 1]) for i in range(150)] + [(name[200], name[i]) for i in range(201, 260)] + [(name[i], name[i + 1]) for i in range(300, 398, 2)] + [(name[0], name[0])]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in rng.sample(edges, len(edges))]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: r for n, r in roots({n for e in edges for n in e}, edges).items() if n != r}
    assert (len(tables) == 2) == (few > 0)


def test_long_texts_that_share_a_passage_are_put_aside_by_bitmaps(spark, monkeypatch):
    """Sets of shingles are read for near copies only, not for every two long texts with a passage in common."""
    rng = random.Random(7)
    rows = [(i, " ".join([*(f"passage{i // 2}_{k}" for k in range(60)), *(f"w{rng.randrange(10**6)}" for _ in range(1500 + i))])) for i in range(30)]
    rows.append((100, rows[3][1].replace(" passage1_7 ", " other ")))
    compared = []

    def written(df):
        table = near_copies.written.real(df)
        if "a_digest" in df.columns:
            compared.append({(r.a, r.b) for r in table.collect()})
        return table

    written.real = near_copies.written
    monkeypatch.setattr(near_copies, "written", written)
    _against_brute_force(spark, rows)
    assert len(compared) == 3 and set().union(*compared) == {(3, 100)}


def test_wide_bitmaps_are_folded(spark):
    rng = np.random.default_rng(1)
    shingles = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (600, 1100, 2040)]
    parity = lambda h, cells: np.packbits((np.bincount((h % np.uint64(cells)).astype(int), minlength=cells) & 1).astype(np.uint8), bitorder="little").view("<i8")
    cells = [1024, 2048, 2048]
    for i in range(3):
        for j in range(3):
            x, y = parity(shingles[i], cells[i]), parity(shingles[j], cells[j])
            least = min(cells[i], cells[j])
            want = sum((int(v) & (2**64 - 1)).bit_count() for v in parity(shingles[i], least) ^ parity(shingles[j], least))
            df = spark.createDataFrame([(x.tolist(), y.tolist())], "x array<long>, y array<long>")
            assert df.select(near_copies._wide_apart(F.col("x"), F.col("y"))).first()[0] == want


def test_scratch_tables_of_near_copies_are_deleted(spark, odd):
    """Of all tables that are written on the way, what is returned reads one."""
    with near_copies.tables_written() as tables:
        kept = near_copies.one_of_each(odd)
        n = kept.count()
    there = [t for t in tables if (p := spark._jvm.org.apache.hadoop.fs.Path(t._scratch)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)]
    assert n and len(tables) > 10 and [t.columns for t in there] == [["kept_id", "kept_a", "kept_b", "n_rows"]]

import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import functions as F

from fieldsong.llm import sharding


def check(rows, source):
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in source)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and 0 <= r.shard < 16 and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(odd, odd_rows):
    rows = sharding.shard_documents(odd).collect()
    check(rows, odd_rows)
    assert sorted(map(str, sharding.shard_documents(odd.repartition(3)).collect())) == sorted(map(str, rows))


def by_hand(source, n=16):
    """Shard and slot of each row: cut the sorted keys at the key nearest to each aim, or beside the text that it is in."""
    key = lambda i, t: (int(np.uint64(xxhash.xxh64_intdigest((t or "").encode(), 42)).view(np.int64)), -(2**63) if i is None else i)
    rows = sorted((key(i, t), len((t or "").encode()) + 1) for i, t in source)
    size, of_text = defaultdict(int), defaultdict(int)
    for k, b in rows:
        size[k] += b
        of_text[k[0]] += b
    below, upto, first = {}, 0, {}
    for k in sorted(size):
        below[k] = upto
        first.setdefault(k[0], upto)
        upto += size[k]
    cuts = []
    for k in range(1, n):
        aim = upto * k / n
        lo = max(x for x in below if below[x] <= aim)
        hi = min((x for x in below if below[x] > aim), default=None)
        group = lo[0]
        if of_text[group] <= upto / n / 16:
            cuts.append(first[group] if aim - first[group] <= first[group] + of_text[group] - aim else first[group] + of_text[group])
        else:
            cuts.append(below[lo] if hi is None or aim - below[lo] <= below[hi] - aim else below[hi])
    shard_of = {k: sum(c <= b for c in cuts) for k, b in below.items()}
    seen, out = Counter(), []
    for k, b in rows:
        out.append((shard_of[k], seen[shard_of[k]], b))
        seen[shard_of[k]] += 1
    return sorted(out)


def test_against_brute_force(spark, odd, odd_rows):
    groups = [(k, f"text {k // 10} " * (k // 10 % 7 + 1)) for k in range(12_000)]
    hot = [(k, "the same text" if k % 3 == 0 else f"text {k}") for k in range(900)]
    for source in (groups, hot, [(i, t) for i, t, *_ in odd_rows]):
        got = sharding.shard_documents(spark.createDataFrame(source, "doc_id long, text string")).collect()
        assert sorted((r.shard, r.slot, r["size"]) for r in got) == by_hand(source)
        if source is groups:
            assert len({(r.text_crc32, r.shard) for r in got}) == 1200  # no text is in two shards


def test_what_the_driver_sees_does_not_grow(spark, monkeypatch):
    seen = []
    draw = sharding._draw
    monkeypatch.setattr(sharding, "_draw", lambda *a: seen.append(len(out := draw(*a))) or out)
    for n in (2_000, 40_000):
        seen.clear()
        sharding.find_splitters(spark.range(n).select(F.xxhash64("id").alias("high"), F.col("id").alias("low"), F.lit(7).alias("bytes")), 16)
        assert max(seen) <= 15 * sharding.PROBES and len(seen) <= 6


def test_sizes_are_near_equal_with_a_hot_text(spark):
    source = [(k, "the same text " * 3 if k % 3 == 0 else f"text {k} " * (k % 11)) for k in range(3000)]
    rows = sharding.shard_documents(spark.createDataFrame(source, "doc_id long, text string")).collect()
    check(rows, source)
    total = Counter()
    for r in rows:
        total[r.shard] += r["size"]
    mean = sum(total.values()) / 16
    assert max(abs(v - mean) for v in total.values()) <= 0.01 * mean + 2 * max(len(t) for _, t in source)
    same = sorted({r.shard for r in rows if r.text_crc32 == zlib.crc32(source[0][1].encode())})
    assert same == list(range(same[0], same[-1] + 1))  # a group too large for one shard lies in neighbours


def test_cells_of_keys_that_share_their_first_part():
    cuts = [(1, 5), (1, 9), (3, 0)]
    high, low = np.array([0, 1, 1, 1, 2, 3, 3]), np.array([0, 4, 5, 9, 0, -1, 0])
    assert sharding.cell_of(high, low, cuts).tolist() == [0, 0, 1, 2, 2, 2, 3]
    assert sharding.cell_of(high, low, []).tolist() == [0] * 7


def test_empty_and_few(spark, none):
    assert sharding.shard_documents(none).count() == 0
    check(sharding.shard_documents(spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")).collect(), [(1, "a"), (2, None)])

import random

from fieldsong.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, place string, nth int, side string, seat int, part_no int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, 3) for r in rows], SCHEMA)


def entries(rows, conv):
    own = {r[1:] for r in rows if r[0] == conv and conv is not None}
    low = lambda x: (x is not None, x or "")
    own = sorted(own, key=lambda r: (r[0] is None, r[0] or 0, low(r[1]), low(r[2])))
    seen, out = {}, []
    for t, role, text in own:
        seen[t] = seen.get(t, 0) + 1
        out.append(((chat.LAST if t is None else t, seen[t]), role, text))
    return out


def by_hand(rows, chosen, rejected):
    a, b = entries(rows, chosen), entries(rows, rejected)
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    clean = lambda s: (s or "").replace("<|", "< |")
    show = lambda xs: "".join(f"<|{clean(r)}|>\n{clean(t)}<|end|>\n" for _, r, t in xs)

    def mask(xs):
        out = []
        for _, r, t in xs:
            head, body = len(f"<|{clean(r)}|>\n"), len(f"{clean(t)}<|end|>\n")
            out += [head, body] if r == "assistant" else [head + body, 0]
        return out

    return n, show(a[:n]), show(a[n:]), mask(a[n:]), show(b[n:]), mask(b[n:])


def joined(found):
    """The parts of each pair put together."""
    out = {}
    for r in sorted(found, key=lambda r: (r.pair_id, r.part)):
        was = out.get(r.pair_id, (0, "", "", [], "", []))
        out[r.pair_id] = tuple(x + y for x, y in zip(was, (r.prompt_turns, r.prompt, r.chosen, r.chosen_mask, r.rejected, r.rejected_mask)))
    return out


ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi <|end|> 🙂"), (1, 2, "assistant", "yes"), (1, 3, "user", "ok"),
    (2, 0, "system", "be kind"), (2, 1, "user", "hi <|end|> 🙂"), (2, 2, "assistant", "no"),
    (3, 0, "user", "alone"), (4, 0, "user", "alone"),  # alike
    (5, 0, "user", None), (6, 0, "user", ""), (7, 0, None, "x"), (8, None, "user", "late"), (8, 0, "user", "x"),
    (9, 0, "user", "a"), (9, 1, "assistant", "b"), (10, 0, "user", "a"),  # one is the other's beginning
    (11, 0, "user", "t"), (11, 0, "user", "s"), (11, 0, "user", "s"), (12, 0, "user", "s"), (12, 0, "assistant", "u"),  # ties, a repeated row
    (None, 0, "user", "lost"), (13, 0, "user", "w " * 50_000), (14, 5, "user", "w " * 50_000), (14, 900, "assistant", "far"),
]


def test_against_brute_force(spark):
    pairs = [(1, 1, 2), (2, 3, 4), (3, 5, 6), (4, 7, 8), (5, 9, 10), (6, 10, 9), (7, 11, 12), (8, 13, 14), (9, 1, None), (10, None, None), (11, 99, 2), (12, 1, 1)]
    given = spark.createDataFrame(pairs, "pair_id long, chosen_id long, rejected_id long")
    found = chat.preference_records(frame(spark, ROWS), given).collect()
    got = joined(found)
    assert set(got) == {p for p, _, _ in pairs}
    for p, a, b in pairs:
        assert got[p] == by_hand(ROWS, a, b), p
    assert {r.part for r in found if r.pair_id == 8} == {0, 1}
    assert all(sum(r.chosen_mask) == len(r.chosen) and sum(r.rejected_mask) == len(r.rejected) for r in found)


def test_random_conversations_in_small_parts(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice("ab")) for c in range(60) for t in range(rng.randint(0, 12))]
    turns = frame(spark, rows)
    pairs = chat.pair_by_opening(turns).collect()
    had = {r[0] for r in rows}
    assert sorted(x for r in pairs for x in (r.chosen_id, r.rejected_id) if x is not None) == sorted(had)
    assert sum(r.rejected_id is None for r in pairs) == len(had) % 2
    opening = {c: entries(rows, c)[0][1:] for c in had}
    assert sum(opening[r.chosen_id] == opening.get(r.rejected_id) for r in pairs) >= len(pairs) - 4
    got = joined(chat.preference_records(turns, spark.createDataFrame(pairs, "pair_id long, chosen_id long, rejected_id long"), part_turns=3).collect())
    assert {r.pair_id: by_hand(rows, r.chosen_id, r.rejected_id) for r in pairs} == got


def test_no_conversations(spark):
    assert chat.paired_by_opening(frame(spark, [])).count() == 0
    assert chat.paired_by_opening(frame(spark, [(None, 1, "user", "x")])).count() == 0

import base64
import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldsong.llm import bpe

DATA = bpe.ranks_file(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
MERGES = bpe.merges_of(DATA, public_tokenizers.PATTERN)
OTHER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=MERGES.ranks, special_tokens={})


def same(texts):
    got = MERGES.encode_block(texts)
    for t, ids in zip(texts, got):
        ids = np.frombuffer(ids, "<i4")
        assert ids.tolist() == OTHER.encode_ordinary(t)
        assert MERGES.decode(ids)[0].tobytes() == t.encode()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cn"], max_codepoint=0x2FFF)), max_size=5))
def test_any_text(texts):
    same(texts)


def test_odd_texts(odd_rows):
    rng = random.Random(0)
    same([t or "" for _, t, *_ in odd_rows])
    same(["a" * n for n in range(40)] + [" " * n + "x" for n in range(9)] + ["x" + " " * n for n in range(9)] + ["don't'll 'S \n\n  \t x"])
    same(["".join(rng.choice("ab \n\x1c\x85\u3000.,'é漢") for _ in range(rng.randint(0, 40))) for _ in range(2000)])


def test_any_code_point():
    """Characters that Unicode has no name for yet too, alone and among letters and digits."""
    rng = random.Random(1)
    same(["".join(chr(rng.choice([rng.randrange(0x110000 - 0x800) + 0x800, rng.randrange(0xD800), 0x61, 0x31, 0x20, 0x323B0 + rng.randrange(0x1000)])) for _ in range(12)).encode("utf-16", "surrogatepass").decode("utf-16", "replace") for _ in range(4000)])
    same([f"x{chr(c)}1 {chr(c)}a" for c in range(0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn" and (c < 0x20000 or c % 37 == 0)])


def test_low_ranks_made_late():
    """A merge can open one of a lower rank; other places of its word wait for that."""
    ranks = {bytes([b]): 1000 + b for b in range(256)} | {b"abc": 0, b"ab": 1, b"bc": 2, b"abcab": 3}
    own = bpe.Merges(ranks, r"[\s\S]+")
    tk = tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
    for t in ("abcabcab", "ababcbcabab", "aabbccabc", "bcbcab"):
        assert np.frombuffer(own.encode_block([t])[0], "<i4").tolist() == tk.encode_ordinary(t)


def test_query_columns(odd, odd_rows, none, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 300)
    rows = bpe.token_digests(odd, DATA, public_tokenizers.PATTERN).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len(OTHER.encode_ordinary(t or "")) for _, t, *_ in odd_rows)
    assert bpe.token_digests(none, DATA, public_tokenizers.PATTERN).count() == 0
    kept = bpe.encode_documents(odd, DATA, public_tokenizers.PATTERN)
    assert set(kept.columns) == set(odd.columns)


def test_a_vocabulary_needs_all_bytes():
    with pytest.raises(ValueError):
        bpe.merges_of(base64.b64encode(b"a") + b" 0\n", ".")

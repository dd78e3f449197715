import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from fieldsong.llm import alignment as A

FILES = A.files(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
EMPTY = (0, 0, 0, 0, 0, 0, "")


@pytest.fixture(scope="module")
def engines():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(engines, docs):
    """Each document's row by the definition, token by token, from the engines on whole texts."""
    a_model, b_model = engines
    byte = A.letters_of_bytes()
    spans, counts = [], Counter()
    for _, text in docs:
        spans.append(None)
        if text:
            a = a_model.encode(" " + text, add_special_tokens=False).ids
            b = b_model.encode(text)
            a_bytes = [bytes(byte[c] for c in a_model.id_to_token(x)) for x in a]
            b_bytes = [bytes([int(p[3:5], 16)]) if b_model.is_byte(x) else p.replace("▁", " ").encode() for x, p in ((x, b_model.id_to_piece(x)) for x in b)]
            if b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
                ends = [np.cumsum([len(x) for x in y]).tolist() for y in (a_bytes, b_bytes)]
                links, k = [], 0
                for x, start, end in zip(a, [0, *ends[0]], ends[0]):
                    while ends[1][k] <= start:
                        k += 1
                    j = k
                    while j < len(b) and (ends[1][j - 1] if j else 0) < end:
                        links.append((x, b[j]))
                        j += 1
                groups, at = [], [0, 0]
                for c in sorted(set(ends[0]) & set(ends[1])):
                    n = [ends[s].index(c) + 1 for s in (0, 1)]
                    groups.append("|".join(",".join(map(str, ids[at[s] : n[s]])) for s, ids in ((0, a), (1, b))))
                    at = n
                spans[-1] = (len(a), len(b), groups, links)
                counts.update(links)
    most = {}
    for (_, y), n in counts.items():
        most[y] = max(n, most.get(y, 0))
    out = []
    for (i, _), s in zip(docs, spans):
        facts = EMPTY if s is None else (s[0], s[1], len(s[2]), len(s[3]), sum(counts[x] == most[x[1]] for x in s[3]), sum(counts[x] for x in s[3]), sha256(";".join(s[2]).encode()).hexdigest())
        out.append((i, *facts))
    return out


def facts(rows):
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows), key=str)


STRANGE = ["<|endoftext|> <s> </s>", "  two  spaces \n\n lines ", "a▁b", "ﬁ ½ 漢字 🙂🙂 é", "\x00\x1c\x85\xa0", "don't I'LL", " ", "กำ ไทย", "x" * 300, "tab\tand\r\nend", "﻿mark", "１２ Ⅷ ²"]


@pytest.mark.parametrize("bounds", [{}, {"ROW_BYTES": 200, "TABLE_WORDS": 5, "HELD_PAIRS": 10, "SENT_PAIRS": 40}, {"SENT_PAIRS": 0}])
def test_equals_the_definition(spark, engines, odd, odd_rows, monkeypatch, bounds):
    for name, n in bounds.items():
        monkeypatch.setattr(A, name, n)
    wide = [None] * (len(odd.columns) - 2)
    docs = [r[:2] for r in odd_rows if r[0] != 6] + [(6, odd_rows[5][1][:4000])] + [(100 + k, t) for k, t in enumerate(STRANGE)]
    table = spark.createDataFrame([(i, t, *wide) for i, t in docs], odd.schema)
    assert facts(A.align(table, *FILES).collect()) == sorted(brute(engines, docs), key=str)


def test_no_rows_and_no_tokens(spark, none, odd):
    assert A.align(none, *FILES).collect() == []
    bare = odd.where(F.coalesce(F.col("text"), F.lit("")) == "")
    assert [r[1:] for r in facts(A.align(bare, *FILES).collect())] == [EMPTY] * bare.count()


def test_words_by_themselves_are_as_in_texts(engines):
    """Both engines read whole texts; the table of words gives the same ids for any spaces and signs."""
    rng = random.Random(4)
    both = A.Both(*FILES)
    assert both.by_word and both.a_plain is not None
    signs = ["a", "B", "é", "ß", " ", " ", "  ", "\n", "\t", ".", "'s", "1", "2", "漢", "🙂", "́", "\xa0", "　", "_", "<s>", "▁", "Ǆ", "\x1f"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    for text, found, whole in zip(texts, both.ids(texts), both.encoded(texts)):
        a, b = engines[0].encode(" " + text, add_special_tokens=False).ids, engines[1].encode(text)
        assert found == whole and (found is None or (np.frombuffer(found[0], np.int32).tolist(), np.frombuffer(found[1], np.int32).tolist()) == (a, b)), text

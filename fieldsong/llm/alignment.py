"""Cross-tokenizer alignment: where two tokenizers cut the same texts alike, and which of their tokens go together.

A batch of texts stands end to end as one row of bytes. The ends of both tokenizers' tokens are counted once over it;
where both end, a group ends. Sums along the row number the groups and say how many tokens lie before any byte, and
their differences at the ends of documents are the documents' results. Every stretch between neighbouring ends lies
in exactly one token of either, and every two tokens that overlap share exactly one stretch: so the stretches are the
links, and need no join.

Links are counted over the corpus by pairs of ids. The commonest pairs, of a bounded number, are broadcast and looked
up in each task, so that no hot pair is shuffled; what is left is joined.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldsong.llm.bpe import SPACED_WORDS, cut
from fieldsong.llm.common import text_batches, written

#: Bytes of text that stand in one row (or one text).
ROW_BYTES = 2 << 20
#: Characters before this one are letters, digits and white space alike to every version of Unicode that the engines follow.
PLAIN_BEFORE = "\u0250"
#: Words whose ids a worker keeps, before it starts afresh.
TABLE_WORDS = 250_000
#: Pairs of ids that a task holds before it hands them on, and those that are broadcast, at most.
HELD_PAIRS = 1 << 20
SENT_PAIRS = 1 << 20


def letters_of_bytes() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Side:
    """A tokenizer: the bytes of each of its ids, and the ids of words."""

    def __init__(self, tokens: list[bytes]):
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(tokens), np.uint8)
        # Each id in decimal digits, six columns or more, to be followed by a sign.
        numbers = [str(k).encode() for k in range(len(tokens))]
        self.digits = np.array([len(x) for x in numbers], np.int64)
        self.decimal = np.zeros((len(tokens), max(map(len, numbers), default=0) + 1), np.uint8)
        for k, x in enumerate(numbers):
            self.decimal[k, : len(x)] = np.frombuffer(x, np.uint8)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.letters[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.places[ids] - (ends - sizes), sizes)].tobytes()


class Both:
    """Tokenizers A (byte-level, of space and text) and B (pieces, which puts the space before a text itself)."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a_model = Tokenizer.from_str(a_file.decode())
        self.a_model.encode_special_tokens = True  # their strings in a text are text
        self.b_model = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        byte = letters_of_bytes()
        entries = {k: t for t, k in self.a_model.get_vocab(with_added_tokens=True).items()}
        spell = lambda t: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        tokens = [spell(entries.get(k, "")) for k in range(max(entries) + 1)]
        self.a = Side(tokens)
        # A second engine reads A's plain words, a few times as fast; it goes by ranks, so ids have to follow the merges.
        state = json.loads(a_file)
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in state["model"]["merges"]]
        step, special = state.get("pre_tokenizer") or {}, {t["id"] for t in state.get("added_tokens", [])}
        byte_level = state.get("normalizer") is None and step.get("type") == "ByteLevel" and step.get("use_regex") is True and not step.get("add_prefix_space")
        self.a_plain = None
        if byte_level and all(state["model"]["vocab"][m] == 256 + k for k, m in enumerate(merges)):
            self.a_plain = tiktoken.Encoding("a", pat_str=SPACED_WORDS, mergeable_ranks={t: k for k, t in enumerate(tokens) if k not in special}, special_tokens={})
        pieces = [self.b_model.id_to_piece(k) for k in range(self.b_model.get_piece_size())]
        self.b_tokens = [bytes([int(x[3:5], 16)]) if self.b_model.is_byte(k) else x.replace("▁", " ").encode() for k, x in enumerate(pieces)]
        self.b = Side(self.b_tokens)
        # B merges nothing across a space after another character if no piece holds one; A's pattern never does.
        self.by_word = byte_level and not any("▁" in x.lstrip("▁") for x in pieces)
        self.words: dict[str, tuple[bytes, bytes] | None] = {}

    def encoded(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """Ids of A and of B, four bytes an id, of each space and text; None where the tokens do not spell it."""
        plain = [self.a_plain is not None and max(t, default="") < PLAIN_BEFORE for t in texts]
        other = iter(self.a_model.encode_batch_fast([" " + t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        b_ids = self.b_model.encode(texts, num_threads=1)
        spelt = self.b_tokens.__getitem__
        out: list[tuple[bytes, bytes] | None] = []
        for t, p, y in zip(texts, plain, b_ids):
            want = " " + t
            if p:
                x = self.a_plain.encode_ordinary(want)
            else:
                x = next(other).ids
                p = self.a.bytes_of(np.array(x, np.int32)) == want.encode()
            out.append((array("i", x).tobytes(), array("i", y).tobytes()) if p and b"".join(map(spelt, y)) == want.encode() else None)
        return out

    def ids(self, texts: list[str]) -> list[tuple[bytes, bytes] | None]:
        """As encoded(), from a table of words where both tokenizers work word by word."""
        if not self.by_word:
            return self.encoded(texts)
        parts = [cut(t) for t in texts]
        if len(self.words) > TABLE_WORDS:
            self.words = {}
        new = list(set(chain.from_iterable(parts)).difference(self.words))
        self.words.update(zip(new, self.encoded(new)))
        out: list[tuple[bytes, bytes] | None] = []
        for words in parts:
            found = list(map(self.words.__getitem__, words))
            out.append(None if None in found else (b"".join([x for x, _ in found]), b"".join([y for _, y in found])))
        return out


@lru_cache(maxsize=2)
def both_of(a_file: bytes, b_file: bytes) -> Both:
    return Both(a_file, b_file)


def aligned(both: Both, found: list[tuple[bytes, bytes]]) -> dict[str, list]:
    """n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of each document; found: its ids of A and B, not empty."""
    a, b = (np.frombuffer(b"".join(x[k] for x in found), np.int32) for k in (0, 1))
    n_a, n_b = (np.array([len(x[k]) // 4 for x in found]) for k in (0, 1))
    end_a, end_b = np.cumsum(both.a.sizes[a]), np.cumsum(both.b.sizes[b])
    size = int(end_a[-1]) + 1
    at_a, at_b = (np.bincount(x, minlength=size).astype(bool) for x in (end_a, end_b))
    upto_a, upto_b = np.cumsum(at_a, dtype=np.int32), np.cumsum(at_b, dtype=np.int32)
    cut_at, end_at = at_a & at_b, at_a | at_b
    upto_cut = np.cumsum(cut_at, dtype=np.int32)
    last = end_a[np.cumsum(n_a) - 1]  # where documents end
    ends = np.flatnonzero(end_at)
    n_links = np.diff(np.cumsum(end_at, dtype=np.int32)[last], prepend=0)
    # The token of each side that covers the stretch up to an end.
    pair = a[upto_a[ends] - at_a[ends]].astype(np.int64) * len(both.b.sizes) + b[upto_b[ends] - at_b[ends]]
    span = len(both.a.sizes) * len(both.b.sizes)
    keys, times = np.unique(np.repeat(np.arange(len(found)), n_links) * span + pair, return_counts=True)
    of_doc = np.searchsorted(keys, np.arange(len(found) + 1) * span)
    kind = np.uint32 if span <= 1 << 32 else np.int64
    keys, times = (keys % span).astype(kind), times.astype(np.uint32)
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": np.diff(upto_cut[last], prepend=0), "n_links": n_links,
        "groups_sha256": digests(both, (a, b), (end_a, end_b), (upto_a, upto_b), cut_at, upto_cut, np.cumsum(n_a + n_b)),
        "pairs": [keys[x:y].tobytes() for x, y in zip(of_doc, of_doc[1:])], "times": [times[x:y].tobytes() for x, y in zip(of_doc, of_doc[1:])],
    }


def digests(both: Both, ids: tuple, end: tuple, upto: tuple, cut_at: np.ndarray, upto_cut: np.ndarray, ends: np.ndarray) -> list[str]:
    """SHA-256 of each document's groups as `a1,a2|b1;a3|b2,b3`.

    ids, end, upto: of A and of B, their tokens' ids and ends, and how many of them end up to each byte; ends: of the
    documents, in tokens of both.
    """
    cuts = np.flatnonzero(cut_at)
    group_a, group_b = (upto_cut[x] - cut_at[x] for x in end)
    before = np.concatenate([[0], upto[1][cuts]])
    rank_a = np.arange(len(end[0])) + before[group_a]  # a group's tokens of A stand after the earlier groups' of B
    rank_b = np.arange(len(end[1])) + upto[0][cuts][group_b]
    width = max(both.a.decimal.shape[1], both.b.decimal.shape[1])
    rows, lengths = np.zeros((len(rank_a) + len(rank_b), width), np.uint8), np.empty(len(rank_a) + len(rank_b), np.int64)
    for side, own_ids, rank, stop_at, stop in ((both.a, ids[0], rank_a, cut_at[end[0]], ord("|")), (both.b, ids[1], rank_b, cut_at[end[1]], ord(";"))):
        own, digits = side.decimal[own_ids], side.digits[own_ids]
        own[np.arange(len(own)), digits] = np.where(stop_at, stop, ord(","))
        rows[rank, : own.shape[1]] = own
        lengths[rank] = digits + 1
    text = memoryview(rows[np.arange(width) < lengths[:, None]].tobytes())
    marks = np.concatenate([[0], np.cumsum(lengths)[ends - 1]]).tolist()
    return [sha256(text[x : y - 1]).hexdigest() for x, y in zip(marks, marks[1:])]


FACTS = ["n_a", "n_b", "n_groups", "n_links"]


def aligned_documents(docs: DataFrame, a_file: bytes, b_file: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the document's different pairs of linked ids with how often each is linked."""
    sent = text_batches().sparkContext.broadcast((a_file, b_file))

    def rows(texts: list[str | None]) -> dict[str, list]:
        both = both_of(*sent.value)
        at = [k for k, t in enumerate(texts) if t]
        ids = both.ids([texts[k] for k in at])
        at, ids = [k for k, x in zip(at, ids) if x], [x for x in ids if x]
        out = {c: [0] * len(texts) for c in FACTS} | {"groups_sha256": [""] * len(texts)} | {c: [b""] * len(texts) for c in ("pairs", "times")}
        if ids:
            for c, values in aligned(both, ids).items():
                for k, v in zip(at, values.tolist() if isinstance(values, np.ndarray) else values):
                    out[c][k] = v
        return out

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, held, start = [], 0, 0
            for k, t in enumerate(batch["text"]):
                block.append(t.as_py())
                held += len(block[-1] or "")
                if held >= ROW_BYTES or k + 1 == len(batch):
                    own = rows(block)
                    yield pa.RecordBatch.from_arrays(
                        [batch["doc_id"].slice(start, len(block)), *(pa.array(own[c], pa.int64()) for c in FACTS), pa.array(own["groups_sha256"], pa.string()), *(pa.array(own[c], pa.binary()) for c in ("pairs", "times"))],
                        ["doc_id", *FACTS, "groups_sha256", "pairs", "times"],
                    )
                    block, held, start = [], 0, k + 1
        both_of(*sent.value).words = {}

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(align, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def joined(column: pa.Array, kind: type) -> np.ndarray:
    """A binary column's numbers end to end."""
    return np.frombuffer(b"".join(x.as_py() for x in column), kind)


def pair_counts(rows: DataFrame, kind: type) -> DataFrame:
    """pair, n: how many links of all documents hold each pair."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64)]
        for batch in batches:
            pairs = np.concatenate([held[0], joined(batch["pairs"], kind).astype(np.int64)])
            times = np.concatenate([held[1], joined(batch["times"], np.uint32).astype(np.int64)])
            order = np.argsort(pairs, kind="stable")
            heads = np.flatnonzero(np.diff(pairs[order], prepend=-1))
            held = [pairs[order][heads], np.add.reduceat(times[order], heads) if len(heads) else times]
            if len(held[0]) >= HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["pair", "n"])
                held = [np.empty(0, np.int64), np.empty(0, np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["pair", "n"])

    return rows.select("pairs", "times").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def commonest(counts: DataFrame, most: int) -> pa.Table:
    """The pairs of counts(pair, n, best) whose counts are at least the smallest power of two that leaves at most `most` of them, by pair."""
    sizes = {r.power: r.c for r in counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count(F.lit(1)).alias("c")).collect()}  # 64 rows at most
    least, total = 63, 0
    while least > 0 and total + sizes.get(least - 1, 0) <= most:
        least -= 1
        total += sizes.get(least, 0)
    return counts.where(F.floor(F.log2("n")) >= least).toArrow().sort_by("pair")


def looked_up(rows: DataFrame, known: pa.Table, kind: type) -> DataFrame:
    """rows with n_best and count_sum of the pairs that are known, and the others in `rest` with their number in `rest_times`."""
    sent = rows.sparkSession.sparkContext.broadcast([known["pair"].to_numpy(), known["n"].to_numpy(), known["best"].to_numpy()])
    columns = ["row", "doc_id", *FACTS, "groups_sha256"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = sent.value
        known, counts, best = np.append(known, np.iinfo(np.int64).max), np.append(counts, 0), np.append(best, False)
        for batch in batches:
            pairs, times = joined(batch["pairs"], kind).astype(np.int64), joined(batch["times"], np.uint32).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(x.as_py()) // 4 for x in batch["times"]])]).astype(np.int64)
            at = np.searchsorted(known, pairs)
            there = known[at] == pairs
            summed = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[ends]))
            left = np.concatenate([[0], np.cumsum(~there)])[ends].astype(np.int32)
            rest = [pa.ListArray.from_arrays(pa.array(left), pa.array(x[~there])) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in columns), summed(np.where(there & best[at], times, 0)), summed(np.where(there, times * counts[at], 0)), *rest], [*columns, "n_best", "count_sum", "rest", "rest_times"]
            )

    return rows.mapInArrow(
        look, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long, rest array<long>, rest_times array<long>"
    )


def align(docs: DataFrame, a_file: bytes, b_file: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs.

    Null and empty texts, and those that the tokens do not spell (B normalises or does not know them), have zeros and
    an empty digest. Texts of any length are read whole; repeated rows are repeated and count as often; null doc_ids
    stay null; ties for a B id's highest count are all best; an empty table gives no rows. Other columns are not read.
    """
    both = Both(a_file, b_file)
    kind = np.uint32 if len(both.a.sizes) * len(both.b.sizes) <= 1 << 32 else np.int64
    rows = written(aligned_documents(docs, a_file, b_file, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
    counts = written(pair_counts(rows, kind))
    highest = counts.groupBy((F.col("pair") % len(both.b.sizes)).alias("b")).agg(F.max("n").alias("most"))  # a row an id of B
    counts = counts.join(F.broadcast(highest), F.col("pair") % len(both.b.sizes) == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    known = commonest(counts, SENT_PAIRS)
    found = looked_up(rows, known, kind)
    columns = ["doc_id", *FACTS, "n_best", "count_sum", "groups_sha256"]
    if known.num_rows == counts.count():
        return found.select(columns)
    found = written(found)
    rest = found.select("row", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("row", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("times"))
    more = rest.join(counts, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum"))
    total = lambda x, y: (F.col(x) + F.coalesce(y, F.lit(0))).alias(x)
    return found.join(more, "row", "left").select("doc_id", *FACTS, total("n_best", "more_best"), total("count_sum", "more_sum"), "groups_sha256")


def files(a_path: str, b_path: str) -> tuple[bytes, bytes]:
    """Both tokenizers' files, read on the driver; about a megabyte each."""
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        return a.read(), b.read()

"""Byte-level BPE: encoding by merge replay over the words of whole blocks of texts, and decoding.

A task takes its texts in blocks, and its table of words lasts for the whole task. The distinct pretokens of a block stand end to end in one long row of bytes. An
inverted index maps the pairs that merge, by the rank of the merge in bands, to the positions where they stand.
The lowest band that is not empty is drawn; of each word's positions in it the one of lowest rank is merged, in
all words at once, and only the pairs to the left and right of a merge change and are filed anew. A word's other
positions wait, and new pairs may fall in a lower band, which is then drawn first, so that each word sees the
merges in the order of rank in which it alone would see them.
"""

from __future__ import annotations

import base64
import ctypes
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldsong.llm.common import text_batches

#: Bytes of text that make a block, and entries that a worker's table of pieces holds before it starts afresh.
BLOCK_BYTES = 4 << 20
TABLE_ENTRIES = 300_000
#: Texts decoded at once.
DECODED = 256
#: Words that go through the merges together.
REPLAYED = 40_000
#: The index files places by bands of ranks; a band ends before each of these.
BANDS = np.array([32, 128, 512, 1024, 2048, 4096, 8192, 16384, 32768])
NONE = 1 << 30

#: Fixed value: the pattern of which the short cuts below are known to be right. Texts are not cut for any other pattern.
SPACED_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters and digits that Unicode 16.0 added, first and last of each run. The regex module knows later ones, which the tiktoken
#: library has no letters for; the interpreter's tables may end with 15.1.
ADDED_16 = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D49), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3),
    (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139), (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF),
    (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0), (0x1E5F1, 0x1E5FA),
]
#: A space between two characters that are not white space always starts a pretoken (white space here in the
#: widest sense, so that in doubt nothing is cut).
CLEAN_SPACE = re.compile(r"(?<=\S) (?=\S)")
UNCLEAN = re.compile(r"\s | \s")


def cut(text: str) -> list[str]:
    """text in pieces that are encoded each by itself."""
    if text[:1] == " " or text[-1:] == " " or UNCLEAN.search(text):
        return CLEAN_SPACE.split(text)
    return text.split(" ")


def unknown(c: str) -> bool:
    """Whether Unicode 16.0 has no such character."""
    return unicodedata.category(c) == "Cn" and not any(a <= ord(c) <= b for a, b in ADDED_16)


class Merges:
    """A vocabulary of byte strings by rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.regex, self.short = ranks, regex.compile(pattern), pattern == SPACED_WORDS
        self.token = {n: b for b, n in ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary has no token for byte {missing[0]}")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        # Every way in which two tokens make a third, as sorted keys with the third's rank.
        self.base = max(ranks.values()) + 1
        kind = np.uint32 if self.base <= 1 << 16 else np.int64
        made = sorted((ranks[w[:k]] * self.base + ranks[w[k:]], n) for w, n in ranks.items() for k in range(1, len(w)) if w[:k] in ranks and w[k:] in ranks)
        self.pair_keys = np.array([k for k, _ in made] + [np.iinfo(kind).max], dtype=kind)
        self.pair_ranks = np.array([n for _, n in made] + [NONE], dtype=np.int32)
        # All tokens' bytes end to end, for decoding.
        tokens = [self.token.get(n, b"") for n in range(self.base)]
        self.sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        self.places, self.letters = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(tokens), dtype=np.uint8)
        # Ids of pieces after a space, of those that begin a text, and of pretokens.
        self.pieces: dict[str, bytes] = {}
        self.heads: dict[str, bytes] = {}
        self.words: dict[bytes, bytes] = {}

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of the tokens that pairs make, NONE where they make none."""
        keys = a.astype(self.pair_keys.dtype) * self.pair_keys.dtype.type(self.base) + b.astype(self.pair_keys.dtype)
        at = np.searchsorted(self.pair_keys, keys)
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], NONE)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, four bytes an id. All words go through the merges together."""
        if not words:
            return []
        ids = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        word_of = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        left, right = np.arange(-1, len(ids) - 1, dtype=np.int32), np.arange(1, len(ids) + 1, dtype=np.int32)
        left[starts], right[ends - 1] = -1, -1
        rank = np.full(len(ids), NONE, dtype=np.int32)
        rank[:-1] = self.merged(ids[:-1], ids[1:])
        rank[ends - 1] = NONE
        index: list[list[np.ndarray]] = [[] for _ in range(len(BANDS) + 1)]

        def file(spots: np.ndarray, ranks: np.ndarray) -> None:
            some = np.flatnonzero(ranks < NONE)
            band = np.searchsorted(BANDS, ranks[some], side="right").astype(np.int8)
            some = some[np.argsort(band, kind="stable")]
            cuts = np.cumsum(np.bincount(band, minlength=len(index))).tolist()
            for k, (x, y) in enumerate(zip([0, *cuts], cuts)):
                if x < y:
                    index[k].append(spots[some[x:y]])

        file(np.arange(len(ids), dtype=np.int32), rank)
        while (k := next((k for k, x in enumerate(index) if x), None)) is not None:
            at, index[k] = np.sort(np.concatenate(index[k])), []
            own = rank[at]
            good = np.searchsorted(BANDS, own, side="right") == k
            good[1:] &= at[1:] != at[:-1]
            good &= own < NONE
            at, own = at[good], own[good]
            if not len(at):
                continue
            # Of each word's places the one of lowest rank, and the leftmost of these; the others come up again.
            word = word_of[at]
            heads = np.flatnonzero(np.diff(word, prepend=-1))
            lowest = np.repeat(np.minimum.reduceat(own, heads), np.diff(heads, append=len(at)))
            first = np.flatnonzero(own == lowest)
            first = first[np.flatnonzero(np.diff(word[first], prepend=-1))]
            if len(first) < len(at):
                rest = np.ones(len(at), bool)
                rest[first] = False
                index[k].append(at[rest])
            at, r = at[first], own[first]
            gone, before = right[at], left[at]
            after = right[gone]
            ids[at], ids[gone], rank[at], rank[gone], right[at] = r, -1, NONE, NONE, after
            has, had = after >= 0, before >= 0
            kept, r_after, r_before = at[has], r[has], r[had]
            after, before = after[has], before[had]
            left[after] = kept
            fresh = np.concatenate((self.merged(r_after, ids[after]), self.merged(ids[before], r_before)))
            spots = np.concatenate((kept, before))
            rank[spots] = fresh
            file(spots, fresh)
        kept = ids >= 0
        upto = (np.cumsum(np.add.reduceat(kept, starts)) * 4).tolist()
        packed = ids[kept].astype("<i4").tobytes()
        return [packed[a:b] for a, b in zip([0, *upto], upto)]

    def split(self, piece: str) -> list[str]:
        """As the pattern splits it. What Unicode 16.0 has no character for is neither letter nor digit."""
        if piece.isascii() or not any(map(unknown, piece)):
            return self.regex.findall(piece)
        shape = "".join("\ue000" if unknown(c) else c for c in piece)
        return [piece[m.start() : m.end()] for m in self.regex.finditer(shape)]

    def pretokens(self, piece: str, spaced: bool) -> list[bytes]:
        """A space and letters are one pretoken in any case, with or without a stop or comma."""
        if spaced:
            if piece.isalpha():
                return [b" " + piece.encode()]
            if piece[-1] in ".,!?;:" and piece[:-1].isalpha():
                return [b" " + piece[:-1].encode(), piece[-1].encode()]
            piece = f" {piece}"
        return [w.encode() for w in self.split(piece)]

    def learn(self, pieces: set[str], spaced: bool) -> dict[str, bytes]:
        """The table of pieces with the ids of these filled in, four bytes an id."""
        if len(self.pieces) > TABLE_ENTRIES:
            self.forget()
        table = self.pieces if spaced else self.heads
        new = {x: self.pretokens(x, spaced) for x in pieces if x not in table}
        todo = []
        for w in set(chain.from_iterable(new.values())).difference(self.words):
            if (n := self.ranks.get(w)) is not None:
                self.words[w] = n.to_bytes(4, "little")
            else:
                todo.append(w)
        for a in range(0, len(todo), REPLAYED):
            part = todo[a : a + REPLAYED]
            self.words.update(zip(part, self.replay(part)))
        known = self.words
        for x, words in new.items():
            table[x] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])
        return table

    def forget(self) -> None:
        """Drop the tables of pieces and words and hand their memory back: workers live on between tasks, of other jobs too."""
        self.pieces, self.heads, self.words = {}, {}, {}
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass
        pa.default_memory_pool().release_unused()

    def encode_block(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes an id."""
        parts = [cut(t) if self.short else [t] for t in texts]
        # Every piece but a text's first has a space before it.
        heads = [x[0] for x in parts]
        rest: set[str] = set()
        for x in parts:
            x[0] = x[-1] if len(x) > 1 else None
            rest.update(x)
        rest.discard(None)
        spaced = self.learn(rest, True).__getitem__
        first = self.learn(set(heads), False)
        return [first[head] + b"".join(map(spaced, x[1:])) for head, x in zip(heads, parts)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, and how many of them each id has."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.places[ids] - (ends - sizes), sizes)
        return self.letters[at], sizes


@lru_cache(maxsize=2)
def merges_of(data: bytes, pattern: str) -> Merges:
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x)}
    return Merges(ranks, pattern)


def ranks_file(path: str) -> bytes:
    """A file of ranks, read on the driver; about a megabyte for 50,000 tokens."""
    with open(path, "rb") as f:
        return f.read()


def encoded(merges: Merges, texts: pa.Array) -> pa.Array:
    """The ids of each text, a block at a time."""
    out, block, held = [], [], 0
    for t in texts:
        block.append(t.as_py() or "")
        held += len(block[-1])
        if held >= BLOCK_BYTES:
            out += merges.encode_block(block)
            block, held = [], 0
    out += merges.encode_block(block)
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in out])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(out), dtype="<i4")))


def decoded(merges: Merges, ids: pa.Array) -> pa.Array:
    """The bytes of each row's ids, some rows at a time; null for null."""
    marks = ids.offsets.to_numpy()
    ends, pieces = [0], []
    for a in range(0, len(ids), DECODED):
        rows = marks[a : a + DECODED + 1]
        letters, sizes = merges.decode(ids.values[rows[0] : rows[-1]].to_numpy(zero_copy_only=False))
        pieces.append(letters.tobytes())
        ends += (np.concatenate([[0], np.cumsum(sizes)])[rows[1:] - rows[0]] + ends[-1]).tolist()
    whole = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.array(ends, dtype=np.int64)), pa.py_buffer(b"".join(pieces))])
    return pc.if_else(ids.is_valid(), whole.cast(pa.binary()), pa.scalar(None, pa.binary()))


def encoder(spark: SparkSession, ranks: bytes, pattern: str):
    """An expression from a text column to array<int>: its ids as the tiktoken library gives them, no special tokens.

    Null and empty texts have no ids. Texts are taken whole; a very long one is a block by itself.
    """
    sent = text_batches().sparkContext.broadcast(ranks)

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merges = merges_of(sent.value, pattern)
        for texts in batches:
            yield encoded(merges, texts)
        merges.forget()

    return F.arrow_udf(encode, "array<int>")


def decoder(spark: SparkSession, ranks: bytes, pattern: str):
    """An expression from array<int> to the bytes that the ids stand for; null for null."""
    sent = spark.sparkContext.broadcast(ranks)
    return F.arrow_udf(lambda ids: decoded(merges_of(sent.value, pattern), ids), "binary")


def round_trip(spark: SparkSession, ranks: bytes, pattern: str):
    """An expression from a text column to struct<ids: array<int>, decoded: binary>: encoder() and decoder() in one worker a task."""
    sent = text_batches().sparkContext.broadcast(ranks)

    def there_and_back(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merges = merges_of(sent.value, pattern)
        for texts in batches:
            ids = encoded(merges, texts)
            yield pa.StructArray.from_arrays([ids, decoded(merges, ids)], ["ids", "decoded"])
        merges.forget()

    return F.arrow_udf(there_and_back, "ids array<int>, decoded binary")


def encode_documents(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with a column of ids; a column of that name is replaced, others are kept."""
    return docs.withColumn(ids, encoder(docs.sparkSession, ranks, pattern)(F.col(text)))


def joined(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")


def token_digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row's text, encoded and decoded again.

    Null texts are as empty ones: no ids, and the digests of nothing. Texts of any length are encoded whole; repeated rows are
    repeated; an empty table gives no rows. Other columns are not read.
    """
    both = docs.select("doc_id", round_trip(docs.sparkSession, ranks, pattern)(F.col("text")).alias("both")).select("doc_id", "both.*")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined(F.col("ids")).cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))

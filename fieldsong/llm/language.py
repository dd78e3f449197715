"""Language identification by a linear-chain conditional random field over words.

A word's features are hashed n-grams of its letters with marks at both ends (those that touch a mark are its
affixes) and its place in a lexicon of frequent words. Their weights and those of the transitions between
labels are learned from code-switched sequences, spliced from labelled documents. Forward-backward gives each
word's label probabilities, in blocks of documents at once; a document's label is the one with most mass.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsong.llm.common import first_of_each, share_of_each, text_batches

#: Labelled documents of a language whose whole texts are cut into passages, words of a passage, and passages of a
#: language, of all languages and languages (the most frequent ones) that the model is fitted on at most.
FIT_DOCS, FIT_WORDS, FIT_PASSAGES, ALL_PASSAGES, LANGUAGES = 400, 96, 400, 12_000, 256
STEPS, RATE, DECAY = 45, 0.12, 1e-4
#: Mean run of one language in the sequences that are fitted on, and their length.
RUN_WORDS, SEQUENCE = 24, 64
BUCKETS = 1 << 15
LEXICON = 300
GRAMS = (2, 3, 4)
#: Characters of text labelled at once; a text of more than SEGMENT is labelled in parts of that size.
BLOCK_CHARS, SEGMENT = 2 << 20, 1 << 20
NO_LETTERS = bytes(c for c in range(128) if not (chr(c).isalpha() or c == 32))
UNKNOWN = "und"


class Model(NamedTuple):
    labels: list[str]
    weights: np.ndarray  # BUCKETS x labels
    lexicon: dict[str, int]
    word_weights: np.ndarray  # lexicon x labels
    steps: np.ndarray  # label x next label, logarithms
    start: np.ndarray


def held_out(doc_id: Column) -> Column:
    """Documents whose crc32(doc_id as text) is divisible by 5, null ids too; nothing is learned from them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def gram_positions(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each n-gram, the word that it is of, and which words have any letter (or byte beyond ASCII)."""
    flat = np.frombuffer((" " + " ".join(words) + " ").lower().encode().translate(None, NO_LETTERS), np.uint8)
    mark = flat == 32
    word_of = np.cumsum(mark) - 1  # of the word that starts at or before this byte
    buckets, owners = [], []
    code = flat.astype(np.uint32)
    for n in range(2, max(GRAMS) + 1):
        inner = mark[1:][: len(flat) - n + 1] if n > 2 else np.zeros(max(0, len(flat) - 1), bool)
        code = code[: len(flat) - n + 1] * np.uint32(0x01000193) ^ flat[n - 1 :]
        for k in range(2, n - 1):
            inner = inner | mark[k : len(flat) - n + 1 + k]
        if n in GRAMS:
            fine = np.flatnonzero(~inner & ~(mark[: len(inner)] & mark[n - 1 :]) if n == 2 else ~inner)
            mixed = (code[fine] ^ np.uint32(n)) * np.uint32(0x9E3779B1)
            buckets.append(mixed >> np.uint32(32 - 15))
            owners.append(word_of[fine])
    seats = np.flatnonzero(mark)
    lettered = np.diff(seats) > 1
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), lettered


def emissions(model: Model, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Label scores of each word, and which words have letters. Words are taken without their case."""
    buckets, owners, lettered = gram_positions(words)
    out = np.empty((len(words), len(model.labels)), np.float32)
    for k in range(out.shape[1]):
        out[:, k] = np.bincount(owners, model.weights[buckets, k], len(words))
    known = [(i, n) for i, n in enumerate(map(model.lexicon.get, map(str.lower, words))) if n is not None]
    if known:
        at, which = np.array(known).T
        out[at] += model.word_weights[which]
    return out, lettered


def posteriors(model: Model, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Label probabilities of each word of sequences that stand end to end, by forward-backward.

    Step t is taken for all sequences that have a word t at once.
    """
    order = np.argsort(-lengths, kind="stable")
    alive = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")  # sequences longer than t
    base = np.concatenate([[0], np.cumsum(alive)])
    rank = np.empty(len(lengths), np.int64)
    rank[order] = np.arange(len(lengths))
    step = np.arange(len(scores)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    packed = base[step] + np.repeat(rank, lengths)
    raised = np.exp(scores - scores.max(axis=1, keepdims=True))
    e = np.empty_like(raised)
    e[packed] = raised
    move, back = np.exp(model.steps).astype(np.float32), np.exp(model.steps).astype(np.float32).T.copy()
    ahead = np.empty_like(e)
    tiny = np.float32(1e-30)
    for t, n in enumerate(alive.tolist()):
        a = base[t]
        now = e[a : a + n] * (np.exp(model.start).astype(np.float32) if t == 0 else ahead[base[t - 1] : base[t - 1] + n] @ move)
        ahead[a : a + n] = (now + tiny) / (now.sum(axis=1, keepdims=True) + tiny)
    behind = np.ones((len(lengths), e.shape[1]), np.float32)
    for t in range(len(alive) - 1, -1, -1):
        a, n = base[t], int(alive[t])
        ahead[a : a + n] *= behind[:n]
        now = (e[a : a + n] * behind[:n]) @ back
        behind[:n] = now / (now.sum(axis=1, keepdims=True) + tiny)
    ahead /= ahead.sum(axis=1, keepdims=True) + tiny
    return ahead[packed]


def segments(text: str) -> Iterator[list[str]]:
    """The text's words, in lists of at most about SEGMENT characters."""
    start = 0
    while len(text) - start > SEGMENT:
        end = next((k for k in range(start + SEGMENT, len(text)) if text[k].isspace()), len(text))
        yield text[start:end].split()
        start = end
    yield text[start:].split()


def label_block(model: Model, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its words' label probabilities, and which of the words have letters."""
    parts = [(k, words) for k, t in enumerate(texts) for words in segments(t)]
    flat = list(chain.from_iterable(w for _, w in parts))
    index = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    if index:
        scores, lettered = emissions(model, list(index))
        ids = np.fromiter(map(index.__getitem__, flat), np.int64, len(flat))
        lengths = np.array([len(w) for _, w in parts])
        found, lettered = posteriors(model, scores[ids], lengths), lettered[ids]
    else:
        found, lettered = np.empty((0, len(model.labels)), np.float32), np.empty(0, bool)
    sizes = np.bincount([k for k, _ in parts], [len(w) for _, w in parts], len(texts)).astype(int)
    at = 0
    for n in sizes.tolist():
        yield found[at : at + n], lettered[at : at + n]
        at += n


def _blocks(texts: pa.Array) -> Iterator[list[str]]:
    block, held = [], 0
    for t in texts:
        block.append(t.as_py() or "")
        held += len(block[-1])
        if held >= BLOCK_CHARS:
            yield block
            block, held = [], 0
    if block:
        yield block


def language(model: Model, text: Column) -> Column:
    """A text column's struct<lang_pred, score>: its most probable label and that label's mean probability.

    `und` with 0 for texts that are null or have no letter, and for all texts if there was nothing to learn from.
    Of equally probable labels the first in code-point order is taken.
    """

    sent = text_batches().sparkContext.broadcast(model)  # BUCKETS x LANGUAGES weights at most

    def label(texts: pa.Array) -> pa.Array:
        model, names, scores = sent.value, [], []
        for block in _blocks(texts):
            known = [any(map(str.isalpha, t)) and bool(model.labels) for t in block]
            if not any(known):
                names += [UNKNOWN] * len(block)
                scores += [0.0] * len(block)
                continue
            for ok, (found, lettered) in zip(known, label_block(model, [t if ok else "" for t, ok in zip(block, known)])):
                mass = found[lettered].mean(axis=0, dtype=np.float64) if ok and lettered.any() else np.zeros(len(model.labels))
                names.append(model.labels[int(mass.argmax())] if ok else UNKNOWN)
                scores.append(float(min(1.0, mass.max())))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return F.arrow_udf(label, "struct<lang_pred: string, score: double>")(text)


def language_spans(model: Model, text: Column) -> Column:
    """A text column's runs of words of one language: array<struct<lang, words>>, in order; words are separated by white space."""
    kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))
    sent = text_batches().sparkContext.broadcast(model)

    def spans(texts: pa.Array) -> pa.Array:
        model, out = sent.value, []
        for block in _blocks(texts):
            for found, _ in label_block(model, block) if model.labels else ((np.empty((0, 1)), None) for _ in block):
                best = found.argmax(axis=1)
                edges = np.flatnonzero(np.diff(best, prepend=-1))
                out.append([{"lang": model.labels[best[a]], "words": int(b - a)} for a, b in zip(edges, [*edges[1:], len(best)])])
        return pa.array(out, kind)

    return F.arrow_udf(spans, "array<struct<lang: string, words: long>>")(text)


def training_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, list[str]]]:
    """(lang, words) of a bounded sample of passages, drawn evenly from whole texts, the same each time.

    A sample of labelled documents of each language is cut into passages from end to end, and of these a sample is
    drawn. Null texts and languages and held-out documents are not learned from. Other columns are not read.
    """
    pool = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    pool = pool.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    totals = {r.lang: r.n for r in pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    some = pool.where(share_of_each(F.col("lang"), totals, FIT_DOCS // 2, F.col("id")))

    def cut(texts: pa.Array) -> pa.Array:
        words = [t.as_py().split() for t in texts]
        return pa.array([[" ".join(w[a : a + FIT_WORDS]) for a in range(0, len(w), FIT_WORDS)] for w in words], pa.list_(pa.string()))

    most = min(FIT_PASSAGES, ALL_PASSAGES // max(1, len(totals)))
    each = some.select("id", "lang", F.posexplode(F.arrow_udf(cut, "array<string>")(F.col("text"))).alias("nth", "words"))
    spot = F.xxhash64(F.lit(3), "id", "nth")
    picked = first_of_each(each, "lang", [spot, F.col("id"), F.col("nth"), F.col("words")], most)
    found = sorted((r.lang, str(r.id), r.nth, r.words) for r in picked.collect())
    return [(name, words.split()) for name, _, _, words in found]


def fit(rows: list[tuple[str, list[str]]], seed: int = 5) -> Model:
    """A model from (label, words). Sequences splice runs of words of several labels."""
    labels = sorted({name for name, _ in rows})
    n = len(labels)
    if not n:
        return Model([], np.zeros((BUCKETS, 0), np.float32), {}, np.zeros((0, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    runs: list[list[list[str]]] = [[] for _ in labels]
    counts = [Counter() for _ in labels]
    for name, words in rows:
        k, at = labels.index(name), 0
        counts[k].update(map(str.lower, words))
        while at < len(words):
            size = 1 + int(rng.geometric(1 / RUN_WORDS))
            runs[k].append(words[at : at + size])
            at += size
    heads = sorted({w for c in counts for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]})
    lexicon = {w: i for i, w in enumerate(heads)}
    pool = [(k, r) for k, own in enumerate(runs) for r in own]
    stream, gold = [], []
    for i in rng.permutation(len(pool)):
        k, run = pool[i]
        stream += run
        gold += [k] * len(run)
    size = min(SEQUENCE, len(stream))
    rows_n = len(stream) // size
    words = list(dict.fromkeys(stream))
    index = {w: i for i, w in enumerate(words)}
    ids = np.array([index[w] for w in stream[: rows_n * size]]).reshape(rows_n, size)
    truth = np.eye(n, dtype=np.float32)[np.array(gold[: rows_n * size]).reshape(rows_n, size)]
    buckets, owners, _ = gram_positions(words)
    known = [(i, lexicon[w.lower()]) for i, w in enumerate(words) if w.lower() in lexicon]
    at, which = np.array(known).T
    pairs = np.einsum("sti,stj->ij", truth[:, :-1], truth[:, 1:])
    params = [np.zeros((BUCKETS, n), np.float32), np.zeros((len(heads), n), np.float32), np.zeros((n, n), np.float32), np.zeros(n, np.float32)]
    firsts, seconds = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        scores = np.stack([np.bincount(owners, params[0][buckets, k], len(words)) for k in range(n)], axis=1).astype(np.float32)
        scores[at] += params[1][which]
        e = np.exp(scores - scores.max(axis=1, keepdims=True))[ids]
        move = np.exp(params[2])
        ahead, behind = np.empty_like(e), np.ones_like(e)
        for t in range(size):
            now = e[:, t] * (np.exp(params[3]) if t == 0 else ahead[:, t - 1] @ move)
            ahead[:, t] = now / now.sum(axis=1, keepdims=True)
        joint = np.zeros((n, n), np.float32)
        for t in range(size - 1, 0, -1):
            out = e[:, t] * behind[:, t]
            both = ahead[:, t - 1, :, None] * move * out[:, None, :]
            joint += (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            now = out @ move.T
            behind[:, t - 1] = now / now.sum(axis=1, keepdims=True)
        gamma = ahead * behind
        gamma /= gamma.sum(axis=2, keepdims=True)
        off = gamma - truth
        per_word = np.stack([np.bincount(ids.ravel(), off[:, :, k].ravel(), len(words)) for k in range(n)], axis=1)
        grads = [
            np.stack([np.bincount(buckets, per_word[owners, k], BUCKETS) for k in range(n)], axis=1),
            np.stack([np.bincount(which, per_word[at, k], len(heads)) for k in range(n)], axis=1),
            joint - pairs,
            off[:, 0].sum(axis=0),
        ]
        for p, g, m, v in zip(params, grads, firsts, seconds):
            g = g / truth[:, :, 0].size + DECAY * p
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(labels, params[0].astype(np.float32), lexicon, params[1], params[2], params[3])


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs; other columns are not read.

    Texts that are null or have no letter are `und` with score 0; null doc_ids are held out; very long texts are
    labelled whole, in parts; repeated rows are repeated; an empty table gives no rows.
    """
    found = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), language(model, F.col(text)).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")

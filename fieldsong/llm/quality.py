"""Quality classification: similar labelled documents vote.

Documents become latent-semantic vectors: counts of words and of byte trigrams (both hashed), of pairs of
neighbouring character classes and of repeated words, damped and weighted by rarity, are projected on the leading
singular vectors of the labelled sample. The sample's vectors are broadcast; a block of documents is multiplied
with all of them, and the nearest ones' labels are weighted by their cosine. The votes are raised to a power,
learned from the votes that the labelled documents get from each other, so that the threshold falls where labels
part best.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsong.llm.common import first_of_each, share_of_each, text_batches
from fieldsong.llm.language import held_out

#: Labelled documents of each label that the model is fitted on, at most.
FIT_DOCS = 1500
DIMENSIONS, NEIGHBOURS = 48, 25
THRESHOLD = 0.3
BLOCK = 256
#: Documents of a block that are held in doubles at once.
SLAB = 64
#: Bytes that are read at once; the terms do not depend on it.
RUN = 1 << 17

#: Each byte's class: letters without case, then capitals apart, digits, white space, signs by themselves.
_SIGNS = b".,;:!?'\"-_|/\\()[]{}<>@#$%&*+="
CLASS = np.full(256, 26, np.int64)
for _k in range(26):
    CLASS[ord("a") + _k] = _k
CLASS[ord("A") : ord("Z") + 1] = 27
CLASS[ord("0") : ord("9") + 1] = 28
CLASS[32], CLASS[9], CLASS[10], CLASS[13] = 29, 29, 30, 30
for _k, _c in enumerate(_SIGNS):
    CLASS[_c] = 31 + _k
CLASSES = 31 + len(_SIGNS)
REPEATS, NEW, EMPTY = CLASSES * CLASSES, CLASSES * CLASSES + 1, CLASSES * CLASSES + 2
#: Words and byte trigrams are hashed into so many terms.
WORDS, GRAMS = 4096, 2048
FIRST_WORD = EMPTY + 1
FIRST_GRAM = FIRST_WORD + WORDS
TERMS = FIRST_GRAM + GRAMS
#: Cosines are compared to so many places; of equal ones the labelled document with the smaller id votes first.
PLACES = 6
#: Scores are given to so many places.
SCORE_PLACES = 9


class Model(NamedTuple):
    weights: np.ndarray  # rarity of each term
    axes: np.ndarray  # TERMS x dimensions
    vectors: np.ndarray  # labelled documents, unit length
    labels: np.ndarray
    shares: np.ndarray  # documents that each vector stands for
    prior: float
    power: float  # scores are raised to it, so that THRESHOLD parts the labels best


def _mixed(code: np.ndarray, size: int) -> np.ndarray:
    """Hashes of 64-bit numbers, below size (a power of two)."""
    return ((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - size.bit_length())).astype(np.int64)


def terms_of(data: bytes) -> np.ndarray:
    """How often each term is in the text, which is read a run at a time; a run starts where a word does."""
    out = np.zeros(TERMS, np.float32)
    start, last = 0, None
    while start < len(data):
        end = start + RUN
        while end < len(data) and data[end] > 32:
            end += 1
        end = min(end, len(data))
        size = end - start
        ahead = np.frombuffer(data, np.uint8, min(size + 2, len(data) - start), start)  # pairs and trigrams reach into the next run
        start = end
        kind, wide = CLASS[ahead[: size + 1]], ahead.astype(np.uint64)
        out[:REPEATS] += np.bincount(kind[:-1] * CLASSES + kind[1:], minlength=REPEATS)
        if len(ahead) > 2:
            out[FIRST_GRAM:] += np.bincount(_mixed(wide[:-2] << np.uint64(16) | wide[1:-1] << np.uint64(8) | wide[2:], GRAMS), minlength=GRAMS)
        raw, wide = ahead[:size], wide[:size]
        white = raw <= 32
        starts = ~white & np.concatenate(([True], white[:-1]))
        if starts.any():
            # A word's hash sums its bytes, weighted by their place in it; the white space behind it adds nothing.
            seat = np.arange(len(raw))
            place = (seat - np.maximum.accumulate(np.where(starts, seat, 0))).astype(np.uint64)
            code = np.where(white, 0, wide)
            sums = np.add.reduceat(code * (code + np.uint64(17)) * (place * np.uint64(2654435761) + np.uint64(97)), np.flatnonzero(starts))
            same = int((sums[1:] == sums[:-1]).sum()) + int(last is not None and sums[0] == last)
            last = sums[-1]
            out[REPEATS] += same
            out[NEW] += len(sums) - same
            out[FIRST_WORD:FIRST_GRAM] += np.bincount(_mixed(sums, WORDS), minlength=WORDS)
    if not len(data):
        out[EMPTY] = 1
    return out


def damped(counts: np.ndarray) -> np.ndarray:
    """Square roots of the shares that terms have of their kind: character pairs, repeats, words, trigrams."""
    out = counts.astype(np.float32)
    for a, b in ((0, REPEATS), (REPEATS, EMPTY), (FIRST_WORD, FIRST_GRAM), (FIRST_GRAM, TERMS)):
        out[:, a:b] = np.sqrt(out[:, a:b] / np.maximum(1, out[:, a:b].sum(axis=1, keepdims=True)))
    return out


class Sample(NamedTuple):
    """Damped terms of labelled documents, without the zeros; a document's end in ends."""

    columns: np.ndarray
    values: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.ends)

    def blocks(self, weights: np.ndarray):
        """The documents' weighted terms, BLOCK documents at once."""
        starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        for a in range(0, len(self), BLOCK):
            some = slice(starts[a], self.ends[min(a + BLOCK, len(self)) - 1])
            x = np.zeros((min(BLOCK, len(self) - a), TERMS), np.float32)
            x[np.repeat(np.arange(len(x)), (self.ends - starts)[a : a + BLOCK]), self.columns[some]] = self.values[some]
            yield x * weights


def project(x: np.ndarray, weights: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors of damped terms, in doubles: what is left of the other texts in a block, by the order in which products are summed, is far below PLACES."""
    wide = axes.astype(np.float64)
    return _unit(np.concatenate([(x[a : a + SLAB] * weights).astype(np.float64) @ wide for a in range(0, len(x), SLAB)]))


def _unit(v: np.ndarray) -> np.ndarray:
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(v.dtype)


def leading(sample: Sample, weights: np.ndarray, n: int, rounds: int = 4, seed: int = 1) -> np.ndarray:
    """About the first n right singular vectors of the weighted sample, by subspace iteration from a random start."""
    basis = np.random.default_rng(seed).standard_normal((TERMS, min(2 * n, len(sample)))).astype(np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(sum(y.T @ (y @ basis) for y in sample.blocks(weights)))
    _, _, turned = np.linalg.svd(np.concatenate([y @ basis for y in sample.blocks(weights)]), full_matrices=False)
    return (basis @ turned.T)[:, :n].astype(np.float32)


def fit(sample: Sample, labels: np.ndarray, totals: dict[int, int]) -> Model:
    """totals: how many documents of each label there are in all."""
    if not len(sample):
        return Model(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, np.zeros(0), 0.5, 1.0)
    rarity = (np.log((1 + len(sample)) / (1 + np.bincount(sample.columns, minlength=TERMS))) + 1).astype(np.float32)
    axes = leading(sample, rarity, DIMENSIONS)
    shares = np.array([totals[int(k)] / (labels == k).sum() for k in labels])
    vectors = _unit(np.concatenate([y @ axes for y in sample.blocks(rarity)]))
    plain = Model(rarity, axes, vectors, labels, shares, float((labels * shares).sum() / shares.sum()), 1.0)
    own = np.concatenate([voted(plain, vectors[a : a + BLOCK], np.arange(a, min(a + BLOCK, len(sample)))) for a in range(0, len(sample), BLOCK)])
    return plain._replace(power=float(np.log(THRESHOLD) / np.log(parting(own, labels, shares))))


def parting(scores: np.ndarray, labels: np.ndarray, shares: np.ndarray) -> float:
    """The score, 0.05 to 0.95, that parts the labels with the least weight on the wrong side; the middle of its gap."""
    order = np.argsort(scores, kind="stable")
    s, good = scores[order], labels[order] == 1
    w = shares[order]
    wrong = np.concatenate([[0.0], np.cumsum(np.where(good, w, 0))]) + np.concatenate([np.cumsum(np.where(good, 0, w)[::-1])[::-1], [0.0]])
    edges = np.concatenate([[0.0], s, [1.0]])
    gap = np.where(np.diff(edges) > 0, np.diff(edges), -1.0)
    best = np.lexsort((-gap, np.where(gap > 0, wrong, np.inf)))[0]
    return float(np.clip((edges[best] + edges[best + 1]) / 2, 0.05, 0.95))


def score_block(model: Model, x: np.ndarray) -> np.ndarray:
    if not len(model.vectors):
        return np.full(len(x), model.prior)
    return np.round(voted(model, project(x, model.weights, model.axes)) ** model.power, SCORE_PLACES)


def voted(model: Model, v: np.ndarray, leave: np.ndarray | None = None) -> np.ndarray:
    """The votes of the NEIGHBOURS nearest labelled documents on unit vectors v; leave: the one that has no vote on each."""
    near = np.round(v @ model.vectors.T, PLACES)
    if leave is not None:
        near[np.arange(len(v)), leave] = -2
    k = min(NEIGHBOURS, near.shape[1])
    last = np.partition(near, -k, axis=1)[:, -k][:, None]
    # Those above the last one vote, and of its equals the first as far as there is room.
    equal = near == last
    room = k - (near > last).sum(axis=1, keepdims=True)
    votes = (near > last) | (equal & (np.cumsum(equal, axis=1) <= room))
    weight = np.where(votes, np.maximum(near, 0), 0).astype(np.float64) * model.shares
    total = weight.sum(axis=1)
    return np.where(total > 0, weight @ model.labels / np.where(total > 0, total, 1), model.prior)


def quality(model: Model, text: Column) -> Column:
    """A text column's scores, 0 to 1, higher where label 1 is likelier. Null texts are as empty ones.

    A text without similar labelled ones gets the share of label 1; if nothing was labelled, 0.5. Equal texts have equal
    scores. The model, whose size its parameters bound, is broadcast.
    """
    sent = text_batches().sparkContext.broadcast(model)

    def score(texts: pa.Array) -> pa.Array:
        out = []
        for a in range(0, len(texts), BLOCK):
            counts = np.stack([terms_of((t.as_py() or "").encode()) for t in texts[a : a + BLOCK]])
            out.append(np.clip(score_block(sent.value, damped(counts)), 0, 1))
        return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return F.arrow_udf(score, "double")(text)


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model of labels(doc_id, quality 0 or 1) on at most FIT_DOCS documents of each label, the same ones each time.

    Documents that are held out, unlabelled or have another label are not learned from, nor are null ids. A document
    that is labelled more than once, or rows that repeat a doc_id, count as several. Other columns are not read.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("l_id"), F.col(label).cast("int").alias("label")).distinct()
    own = docs.select(F.col(doc_id).alias("d_id"), F.col(text).alias("text"))
    pool = known.where(~held_out(F.col("l_id"))).join(own.select("d_id"), F.col("l_id") == F.col("d_id"), "left_semi")
    totals = {r.label: r.n for r in pool.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = pool.where(share_of_each(F.col("label"), totals, FIT_DOCS, F.col("l_id")))

    def terms(texts: pa.Array) -> pa.Array:
        rows = [damped(terms_of((t.as_py() or "").encode())[None])[0] for t in texts]
        at = [np.flatnonzero(x) for x in rows]
        return pa.StructArray.from_arrays([pa.array([a.astype(np.uint16).tobytes() for a in at], pa.binary()), pa.array([x[a].tobytes() for x, a in zip(rows, at)], pa.binary())], ["at", "value"])

    # some has about 2 FIT_DOCS rows a label.
    found = own.join(F.broadcast(some), F.col("d_id") == F.col("l_id")).withColumn("digest", F.xxhash64("text"))
    picked = first_of_each(found, "label", [F.xxhash64(F.lit(11), "l_id"), F.col("l_id"), F.col("digest")], FIT_DOCS)
    rows = picked.select("l_id", "digest", "label", F.arrow_udf(terms, "at binary, value binary")(F.col("text")).alias("terms")).select("l_id", "digest", "label", "terms.*").toArrow()
    rows = rows.sort_by([("l_id", "ascending"), ("digest", "ascending"), ("label", "ascending")])
    joined = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in rows[name]), kind)
    ends = np.cumsum([len(x.as_py()) // 2 for x in rows["at"]]).astype(np.int64)
    return fit(Sample(joined("at", np.uint16), joined("value", np.float32), ends), rows["label"].to_numpy().astype(np.int64), totals)


def classify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.3) for each row of docs; other columns are not read.

    Null texts are scored as empty ones, null doc_ids are held out, repeated rows are repeated, equal texts have equal
    scores whatever their length, and an empty table gives no rows.
    """
    scored = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), quality(model, F.col(text)).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))

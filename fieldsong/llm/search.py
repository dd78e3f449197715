"""Ranked lexical search: the k best documents of each item, by a threshold-seeded join.

A forward index keeps of each document the terms that items have. From it every term's k-th largest and largest
impact are stored. An item's k-th best score is at least the largest k-th impact of its terms, for k documents have
that much from one term alone. Its terms are put in the order of their largest impacts; those at the low end whose
largest impacts add up to less than that bound cannot lift a document into the k best by themselves and bring no
candidates. Documents with any of the other terms are candidates and are scored exactly, by all terms.

Items go through in blocks whose terms fit in a broadcast; each block reads all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldsong.llm.common import text_batches, written

K = 50
#: Items are dealt into blocks of about so many (item, term) entries. A block holds whole items.
BLOCK_ENTRIES = 1 << 18
#: Cells (documents x items) and additions at once.
CELLS, ADDED = 1 << 21, 1 << 21
#: What tasks have found of one key meets in so many groups before it meets in one.
SALTS = 32
#: Bytes that part terms (all of ASCII but letters and digits) become spaces, A-Z become lower case.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, with repeats; null has none."""
    return (text or "").encode().translate(TERM_BYTES).split()


class Block(NamedTuple):
    """Items of one block: item i has the terms terms[at[i]:at[i + 1]], of which some bring candidates."""

    terms: np.ndarray  # of each entry
    items: np.ndarray  # of each entry
    leads: np.ndarray  # whether the entry brings candidates
    least: np.ndarray  # lower bound of each item's k-th score
    weights: np.ndarray  # of each term


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, term: the different terms of each item; rows that repeat an item_id are one item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(terms_of(t.as_py()))) for t in batch["text"]]
            rows = np.repeat(np.arange(len(terms)), [len(x) for x in terms])
            yield pa.RecordBatch.from_arrays([batch["item_id"].take(pa.array(rows)), pa.array([t.decode() for x in terms for t in x], pa.string())], ["item_id", "term"])

    text_batches()
    own = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    return own.mapInArrow(cut, "item_id long, term string").distinct()


def forward_index(docs: DataFrame, vocabulary: list[str], doc_id: str, text: str) -> DataFrame:
    """doc_id, n (terms with repeats), terms (places in the vocabulary), tfs: a row for each row of docs."""
    sent = text_batches().sparkContext.broadcast({t.encode(): k for k, t in enumerate(vocabulary)})

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = sent.value.get
        for batch in batches:
            sizes, ids, tfs, ends = [], [], [], [0]
            for t in batch["text"]:
                words = terms_of(t.as_py())
                found, often = np.unique(np.array([k for k in map(place, words) if k is not None], np.int32), return_counts=True)
                sizes.append(len(words))
                ids.append(found)
                tfs.append(often.astype(np.int32))
                ends.append(ends[-1] + len(found))
            marks = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(marks, pa.array(np.concatenate([np.empty(0, np.int32), *x]))) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(index, "doc_id long, n long, terms array<int>, tfs array<int>")


def weight(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64)


def postings(batch: pa.RecordBatch, weights: np.ndarray, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row in the batch, term and impact of each posting, in the order of rows."""
    marks = batch["terms"].offsets.to_numpy()
    terms = batch["terms"].values.to_numpy()[marks[0] : marks[-1]]
    tfs = batch["tfs"].values.to_numpy()[marks[0] : marks[-1]].astype(np.int64)
    rows = np.repeat(np.arange(len(batch)), np.diff(marks))
    m = 100 - 50 + (50 * batch["n"].to_numpy() * n_docs) // max(1, n_terms)
    return rows, terms, weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m[rows]))


def largest(keys: np.ndarray, values: np.ndarray, ties: np.ndarray, k: int) -> np.ndarray:
    """Places of each key's k largest values, in the order of keys, of equal values the one with the smaller tie first."""
    order = np.lexsort((ties, -values, keys))
    own = keys[order]
    heads = np.flatnonzero(np.diff(own, prepend=-1))
    nth = np.arange(len(own)) - np.repeat(heads, np.diff(heads, append=len(own)))
    return order[nth < k]


def first_by(df: DataFrame, key: str, order: list[Column], k: int, number: str) -> DataFrame:
    """The first k rows of each key, numbered from 1. What different tasks found meets in SALTS groups first."""
    salted = df.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    nth = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    few = salted.withColumn(number, nth(key, "salt")).where(F.col(number) <= k).drop("salt")
    return few.withColumn(number, nth(key)).where(F.col(number) <= k)


def impacts(index: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """term, kth (its k-th largest impact, 0 if fewer documents have it), top (its largest)."""
    sent = index.sparkSession.sparkContext.broadcast(weights)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_terms, kept = np.empty(0, np.int32), np.empty(0, np.int64)
        for batch in batches:
            _, terms, own = postings(batch, sent.value, n_docs, n_terms)
            terms, own = np.concatenate([kept_terms, terms]), np.concatenate([kept, own])
            at = largest(terms, own, terms, k)
            kept_terms, kept = terms[at], own[at]
        yield pa.RecordBatch.from_arrays([pa.array(kept_terms, pa.int32()), pa.array(kept, pa.int64())], ["term", "impact"])

    found = first_by(index.select("n", "terms", "tfs").mapInArrow(best, "term int, impact long"), "term", [F.desc("impact")], k, "nth")
    return found.groupBy("term").agg(F.coalesce(F.max(F.when(F.col("nth") == k, F.col("impact"))), F.lit(0)).alias("kth"), F.max("impact").alias("top"))


def leading(entries: DataFrame, stored: DataFrame) -> DataFrame:
    """entries(item_id, term) with least (the lower bound of the item's k-th score) and leads (whether the term brings candidates).

    Terms that no document has, or that weigh nothing, bring none.
    """
    item = Window.partitionBy("item_id")
    rising = item.orderBy("top", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = entries.join(stored, "term")
    return own.select("item_id", "term", F.max("kth").over(item).alias("least"), F.sum("top").over(rising).alias("upto")).select(
        "item_id", "term", "least", ((F.col("upto") >= F.col("least")) & (F.col("upto") > 0)).alias("leads")
    )


def expanded(heads: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places heads[k], heads[k] + 1, ... of counts[k] entries each, in a row."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(heads - (ends - counts), counts)


def scores(index: DataFrame, block: Block, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """item (place in the block), doc_id, score: what each task has found to be its k best candidates of each item."""
    n_items = len(block.least)
    order = np.argsort(block.terms, kind="stable")
    sent = index.sparkSession.sparkContext.broadcast((block.terms[order], block.items[order], block.leads[order], block.least, block.weights))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_term, of_item, leads, least, weights = sent.value
        lists = []
        for some in (leads, np.ones(len(leads), bool)):
            heads = np.concatenate([[0], np.cumsum(np.bincount(of_term[some], minlength=len(weights)))])
            lists.append((heads, of_item[some]))
        (lead_heads, lead_items), (all_heads, all_items) = lists
        kept = [np.empty(0, np.int64)] * 4  # item, score, doc_id, whether there is none
        for batch in batches:
            ids = batch["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
            bare = batch["doc_id"].is_null().to_numpy(zero_copy_only=False).astype(np.int64)
            rows, terms, own = postings(batch, weights, n_docs, n_terms)
            step = max(1, CELLS // max(1, n_items))
            for a in range(0, len(batch), step):
                x, y = np.searchsorted(rows, [a, a + step])
                cell, term, impact = (rows[x:y] - a) * n_items, terms[x:y], own[x:y]
                wanted = np.zeros(min(step, len(batch) - a) * n_items, bool)
                total = np.zeros(len(wanted), np.int64)
                for part in cuts(np.diff(lead_heads)[term]):
                    c, t = cell[part], term[part]
                    n = lead_heads[t + 1] - lead_heads[t]
                    wanted[np.repeat(c, n) + lead_items[expanded(lead_heads[t], n)]] = True
                for part in cuts(np.diff(all_heads)[term]):
                    c, t = cell[part], term[part]
                    n = all_heads[t + 1] - all_heads[t]
                    spot = np.repeat(c, n) + all_items[expanded(all_heads[t], n)]
                    some = wanted[spot]
                    np.add.at(total, spot[some], np.repeat(impact[part], n)[some])
                spot = np.flatnonzero(wanted)
                item, score = spot % n_items, total[spot]
                good = (score > 0) & (score >= least[item])
                doc = a + spot[good] // n_items
                kept = [np.concatenate(z) for z in zip(kept, (item[good], score[good], ids[doc], bare[doc]))]
                at = largest(kept[0], kept[1], kept[2], k)
                kept = [z[at] for z in kept]
                if len(at):  # what a task has k of raises the bound for the rest of it
                    full = np.flatnonzero(np.bincount(kept[0], minlength=n_items) >= k)
                    ends = np.cumsum(np.bincount(kept[0], minlength=n_items))
                    least = least.copy()
                    least[full] = np.maximum(least[full], kept[1][ends[full] - 1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(kept[0], pa.int64()), pa.array(kept[2], pa.int64(), mask=kept[3].astype(bool)), pa.array(kept[1], pa.int64())], ["item", "doc_id", "score"]
        )

    return index.mapInArrow(found, "item long, doc_id long, score long")


def cuts(counts: np.ndarray) -> Iterator[slice]:
    """Slices of rows that have about ADDED entries each."""
    ends = np.cumsum(counts)
    marks = np.searchsorted(ends, np.arange(ADDED, (ends[-1] if len(ends) else 0) + ADDED, ADDED))
    a = 0
    for b in [*np.unique(marks).tolist(), len(counts)]:
        if b > a:
            yield slice(a, b)
            a = b


def search(docs: DataFrame, items: DataFrame, k: int = K, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: each item's k documents of highest score above 0, of equal scores the smaller doc_id first.

    Null texts have no terms, so null, empty and blank items have no rows and such documents are never found; a null
    doc_id comes after others of the same score. Rows that repeat a doc_id are documents of their own; rows that
    repeat an item_id, null too, are one item. Texts of any length are read whole. Other columns are not read. Empty
    tables give no rows.
    """
    spark = docs.sparkSession
    entries = written(item_terms(items, item_id, text))
    blocks = max(1, -(-entries.count() // BLOCK_ENTRIES))
    parts = [_block(docs, entries.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), k, doc_id, text) for b in range(blocks)]
    found = [x for x in parts if x is not None]
    out = found[0] if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def _block(docs: DataFrame, entries: DataFrame, k: int, doc_id: str, text: str) -> DataFrame | None:
    """search() for the items of one block; None if no document has a term of theirs."""
    spark = docs.sparkSession
    vocabulary = sorted(r.term for r in entries.select("term").distinct().collect())  # at most about BLOCK_ENTRIES
    index = written(forward_index(docs, vocabulary, doc_id, text))
    sums = index.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r.term] = r["count"]
    if not df.any():
        return None
    weights = weight(sums.docs, df)
    seats = spark.createDataFrame(pa.table({"term_text": pa.array(vocabulary, pa.string()), "term": pa.array(np.arange(len(vocabulary), dtype=np.int32))}))
    numbered = entries.join(F.broadcast(seats), entries.term == F.col("term_text")).select("item_id", seats.term)
    stored = written(impacts(index, weights, sums.docs, sums.terms, k))
    model = leading(numbered, stored).toArrow().to_pandas().sort_values(["item_id", "term"])  # at most about BLOCK_ENTRIES rows
    names, place = np.unique(np.array([-(1 << 63) if r is None or r != r else int(r) for r in model.item_id.astype(object)], np.int64), return_inverse=True)
    least = np.zeros(len(names), np.int64)
    least[place] = model.least.to_numpy(np.int64)
    block = Block(model.term.to_numpy(np.int64), place.astype(np.int64), model.leads.to_numpy(bool), least, weights)
    ids = spark.createDataFrame(pa.table({"item": pa.array(np.arange(len(names))), "item_id": pa.array(names, mask=names == -(1 << 63))}))
    best = first_by(scores(index, block, sums.docs, sums.terms, k), "item", [F.desc("score"), F.col("doc_id").asc_nulls_last()], k, "rank")
    return best.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")

"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a shuffled order, passed over as often as a document may repeat.
A copy's virtual finish time is the words of its source up to and with it, divided by the source's weight. All
copies are sorted by it over all partitions, and along this order the words served add up: until a source's last
copy it is served in proportion to its weight, then its words are all served and its weight falls out. Where the
words served pass the budget the order is cut; copies that have finished by then are taken whole, and of the one that
each source has in service then the words served so far. Sources that run out early leave their share to the
rest, which is what resharing their excess by weight comes to.

A source may hold most rows: its queue is dealt by the shuffle's leading bits into cells of bounded size, and
only sums of cells are summed up along it.
"""

from __future__ import annotations

import re
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from fieldsong.llm.common import WORD, fresh, numbered, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
#: Rows that a cell of one source's queue holds on average.
CELL_ROWS = 4_000
#: The shuffle's order has so many bits.
SPOT_BITS = 60
SEED = 17


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, weight, target: one row for each source of sizes(source, size).

    Sources in code-point order, null last, weigh weights in turn. They divide share times all words by weight;
    where that passes repeats times the source's size it stops there and the excess goes to the others by
    weight, until none is above. In closed form: with the sources in order of cap over weight, those whose cap
    lies under the level stop at it, the others get the level times their weight.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1  # one row a source
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below, rest, every = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing), by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(below), F.lit(0.0))) / F.sum("weight").over(rest)
    per = per.withColumn("level", level)
    # The first source, in this order, whose cap is not under the level sets the level for itself and all behind
    # it; from there on the level falls, so it is the largest.
    per = per.withColumn("final_level", F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(every))
    return per.select("source", "source_size", "n_docs", "weight", F.least("cap", F.coalesce(F.col("final_level") * F.col("weight"), F.col("cap"))).alias("target"))


def shuffled(doc_id: Column, seed: int) -> Column:
    """A document's place in the shuffled order: the first SPOT_BITS bits of its id's MD5."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, SPOT_BITS // 4), 16, 10).cast("long")


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = SEED) -> DataFrame:
    """The mix, one row for each copy that it takes and, for documents not taken at all, one row with taken 0.

    Columns: doc_id, source, size (words of the whole text; null: 0), digest (of the text), source_size, target, queue_start
    (words of the source queued before the document), copy (from 1), taken (words of this copy, fewer than size only for
    the copy that a source has in service at the end), place (of the copy in the mix, from 0; null if not taken).
    target is what the source's share comes to in closed form; the words taken come from the sort and the cut.
    The shuffle orders by a hash of doc_id; rows that repeat a doc_id and a text are alike, so reruns agree.
    Null sources are a source; documents of size 0 are never taken; an empty table gives no rows.
    Columns of docs other than the three are not read.
    """
    digest = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    sizes = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), words_in(F.col(text)).alias("size"), digest.alias("digest")))
    targets = written(source_targets(sizes, weights, share, repeats))
    # Cells: the shuffled order's leading part, as many as bring CELL_ROWS rows into a cell.
    n_cells = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / CELL_ROWS)).cast("long")
    of_source = targets.select(F.col("source").alias("of_source"), "source_size", "weight", "target", n_cells.alias("n_cells"))
    queued = (
        sizes.join(of_source, F.col("source").eqNullSafe(F.col("of_source")))
        .withColumn("spot", shuffled(F.col("doc_id"), seed))
        .withColumn("cell", F.floor(F.col("spot") / float(1 << SPOT_BITS) * F.col("n_cells")))
    )
    order = [F.col("spot"), F.col("doc_id"), F.col("size"), F.col("digest")]
    in_cell = Window.partitionBy("source", "cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cells = queued.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(F.col("source").alias("c_source"), F.col("cell").alias("c_cell"), F.coalesce(F.sum("cell_size").over(before), F.lit(0)).alias("cell_before"))
    queued = queued.withColumn("up_to", F.sum("size").over(in_cell)).join(
        cells, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("cell") == F.col("c_cell"))
    )
    start = F.col("cell_before") + F.col("up_to") - F.col("size")
    columns = ["doc_id", "source", "size", "digest", "source_size", "target"]
    copies = queued.select(
        *columns, "weight", "spot", start.alias("queue_start"), F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("copy")
    ).withColumn("start", F.col("queue_start") + (F.col("copy") - 1) * F.col("source_size"))
    some = copies.where("size > 0").withColumn("finish", (F.col("start") + F.col("size")) / F.col("weight"))
    # A source ends with its last copy: then its weight falls out, and all its words are served.
    cap = F.col("source_size") * repeats
    ends = F.col("start") + F.col("size") == cap
    parts = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["finish", "source", "spot", "doc_id", "size", "digest", "copy"]
    sorted_ = written(numbered(some, [F.col(k) for k in keys], parts, "place", {"ended_weight": F.when(ends, F.col("weight")).otherwise(0.0), "ended_words": F.when(ends, cap).otherwise(0)}))
    sums = targets.agg(F.sum("source_size").alias("words"), F.sum(F.when(F.col("source_size") > 0, F.col("weight"))).alias("weight")).first()
    budget, weight = (sums.words or 0) * float(share), sums.weight or 0.0
    # Words served up to a copy's finish: those of sources that ended before it, and of the others in proportion.
    ended_weight, ended_words = F.col("ended_weight") - F.when(ends, F.col("weight")).otherwise(0.0), F.col("ended_words") - F.when(ends, cap).otherwise(0)
    served = ended_words + F.col("finish") * (F.lit(weight) - ended_weight)
    past = sorted_.where(served >= budget)
    cut = past.agg(F.min_by((F.lit(budget) - ended_words) / (F.lit(weight) - ended_weight), "place").alias("at")).first().at
    placed = sorted_
    if cut is not None:
        placed = sorted_.where(F.col("start") < cut * F.col("weight"))
    service = F.floor(F.lit(cut) * F.col("weight") + 1e-6) - F.col("start") if cut is not None else F.col("size")
    placed = placed.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("size"), service)).cast("long")).where("taken > 0")
    shown = [*columns, "queue_start", "copy", "taken", "place"]
    never = (F.col("start") >= cut * F.col("weight")) | (F.floor(F.lit(cut) * F.col("weight") + 1e-6) <= F.col("start")) if cut is not None else F.lit(False)
    none = copies.where((F.col("copy") == 1) & ((F.col("size") == 0) | never)).select(*columns, "queue_start", "copy", F.lit(0).cast("long").alias("taken"), F.lit(None).cast("long").alias("place"))
    return placed.select(*shown).unionByName(none.select(*shown))


def taken_per_document(docs: DataFrame, **how) -> DataFrame:
    """mix() with one row for each row of docs: taken sums its copies, place is that of the first."""
    copies = mix(docs, **how)
    one = ["doc_id", "source", "size", "digest", "source_size", "target", "queue_start"]
    took = copies.where("taken > 0").groupBy(*one).agg(F.sum("taken").alias("taken"), F.min("place").alias("place"))
    return took.unionByName(copies.where("taken = 0").select(*took.columns))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """docs as mixed: a row for each copy taken, its text cut after the words taken; all columns of docs kept.

    Rows that repeat a doc_id, source and text take the copies of such rows in turn. Null texts and ids, very long texts
    and an empty table are as in mix().
    """
    doc_id, text, source = how.get("doc_id", "doc_id"), how.get("text", "text"), how.get("source", "source")
    key, size, digest, turn = (fresh(docs, c) for c in ("mix_key", "mix_size", "mix_digest", "mix_turn"))
    m_key, m_size, m_digest, m_turn, m_taken = (fresh(docs, c) for c in ("took_key", "took_size", "took_digest", "took_turn", "took_words"))
    named = lambda i, s: F.xxhash64(i, s, i.isNull(), s.isNull())  # noqa: E731  null ids and sources too
    rows = docs.withColumn(key, named(F.col(doc_id), F.col(source))).withColumn(size, words_in(F.col(text))).withColumn(digest, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.withColumn(turn, F.row_number().over(Window.partitionBy(key, size, digest).orderBy(key)))
    took = mix(docs, **how).where("taken > 0").withColumn("named", named(F.col("doc_id"), F.col("source")))
    nth = F.row_number().over(Window.partitionBy("named", "size", "digest", "copy").orderBy(F.desc("taken")))
    took = took.select(F.col("named").alias(m_key), F.col("size").alias(m_size), F.col("digest").alias(m_digest), nth.alias(m_turn), F.col("taken").alias(m_taken))
    both = rows.join(took, (F.col(key) == F.col(m_key)) & (F.col(size) == F.col(m_size)) & (F.col(digest) == F.col(m_digest)) & (F.col(turn) == F.col(m_turn)))
    short = F.col(m_taken) < F.col(size)
    cut = F.when(short, _first_words(F.when(short, F.col(text)), m_taken)).otherwise(F.col(text))
    return both.select(*[cut.alias(c) if c == text else F.col(c) for c in docs.columns])


@F.pandas_udf(StringType())
def _first_words(texts: pd.Series, counts: pd.Series) -> pd.Series:
    """Each text up to the end of its n-th word; only copies cut short, at most one a source, are not null here."""

    def cut(text: str | None, n: int) -> str | None:
        if text is None:
            return None
        ends = (m.end() for m in re.finditer(WORD, text))
        return text[: next(islice(ends, int(n) - 1, None))]

    return pd.Series([cut(t, n) for t, n in zip(texts, counts)], dtype=object)

"""Sharding by histogram sort: shards of nearly equal bytes, cut from one global order.

The order is by a hash of the text, then doc_id, so equal texts stand side by side; rows alike in both are one key.
Splitters are found without sorting: each round draws probe keys from the keys still between a splitter's known
bounds, counts the exact bytes below every probe over all partitions, and narrows the bounds, until the bytes below
a probe meet the splitter's aim within the tolerance or no key is left between the bounds. A splitter that falls
among equal texts moves to their nearer end, unless they are too many. Then keys are dealt once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldsong.llm.common import numbered, written

SHARDS = 16
#: A splitter may miss its aim by this part of a shard's bytes; with 0 it is as near as whole keys allow.
TOLERANCE = 0.0
#: Equal texts stay in one shard if they hold no more than this part of its bytes.
GROUP_SHARE = 1 / 16
#: Keys drawn a round between the bounds of one splitter.
PROBES = 48

Key = tuple[int, int]
LOWEST = (-(2**63), -(2**63))


def text_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def shard_key(doc_id: Column, text: Column) -> list[Column]:
    return [F.xxhash64(F.coalesce(text, F.lit(""))), F.coalesce(doc_id.cast("long"), F.lit(LOWEST[1]))]


def cell_of(high: np.ndarray, low: np.ndarray, cuts: list[Key]) -> np.ndarray:
    """How many of the sorted cuts are at or below each key."""
    heads = np.array([c[0] for c in cuts], dtype=np.int64)
    out = np.searchsorted(heads, high, side="left")
    last = np.searchsorted(heads, high, side="right")
    for h in np.unique(high[last > out]):  # keys that share their first part with a cut
        at, own = high == h, [c[1] for c in cuts if c[0] == h]
        out[at] += np.searchsorted(np.array(own, dtype=np.int64), low[at], side="right")
    return out


def _histogram(keys: DataFrame, cuts: list[Key]) -> list[int]:
    """Exact bytes of the rows below each of the sorted cuts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(cuts) + 1, dtype=np.int64)
        for x in batches:
            np.add.at(total, cell_of(x.high.to_numpy(), x.low.to_numpy(), cuts), x["bytes"].to_numpy())
        some = np.flatnonzero(total)
        yield pd.DataFrame({"cell": some.astype(np.int32), "bytes": total[some]})

    per = keys.mapInPandas(count, "cell int, bytes long").groupBy("cell").agg(F.sum("bytes").alias("bytes"))
    found = {r.cell: r.bytes for r in per.collect()}  # as many rows as cuts, at most
    return list(np.cumsum([found.get(k, 0) for k in range(len(cuts))]))


def _draw(keys: DataFrame, bounds: list[tuple[Key, Key | None]], seed: int) -> list[Key]:
    """Up to PROBES keys strictly between each pair of bounds, the same ones whenever it is run."""
    spans = sorted(set(bounds), key=lambda b: b[0])
    ends = sorted({k for b in spans for k in b if k})
    where = {b: ends.index(b[0]) + 1 if b[0] in ends else 0 for b in spans}
    wanted = np.array(sorted(set(where.values())))

    def lies(high: pd.Series, low: pd.Series) -> pd.Series:
        cell = cell_of(high.to_numpy(), low.to_numpy(), ends)
        return pd.Series(np.where(np.isin(cell, wanted), cell, -1).astype(np.int32))

    spot = F.xxhash64(F.lit(seed), "high", "low")
    drawn = (
        keys.select("high", "low", F.pandas_udf(lies, "int")("high", "low").alias("span"), spot.alias("spot"))
        .where("span >= 0")
        .withColumn("nth", F.dense_rank().over(Window.partitionBy("span").orderBy("spot", "high", "low")))
        .where(F.col("nth") <= PROBES)
        .select("high", "low")
        .distinct()
    )
    return sorted({(r.high, r.low) for r in drawn.collect()} - set(ends))  # PROBES a splitter, at most


def find_splitters(keys: DataFrame, n: int, tolerance: float = TOLERANCE, group_share: float = GROUP_SHARE, seed: int = 29) -> list[Key]:
    """n - 1 sorted keys that cut keys(high, low, bytes) into n parts of nearly equal bytes.

    A row belongs to the part after the last splitter at or below its key. What the driver sees of the keys is PROBES of
    them a splitter and round; rounds grow as the logarithm of the keys.
    """
    whole = keys.agg(F.sum("bytes")).first()[0] or 0
    aims = [whole * (k + 1) / n for k in range(n - 1)]
    low: list[tuple[Key, int]] = [(LOWEST, 0)] * len(aims)  # known keys around each aim, with the bytes below them
    high: list[tuple[Key | None, int]] = [(None, whole)] * len(aims)
    slack, open_ = tolerance * whole / n, list(range(len(aims)))
    while whole and open_:
        probes = _draw(keys, [(low[k][0], high[k][0]) for k in open_], seed)
        seed += 1
        if not probes:
            break
        below = list(zip(probes, map(int, _histogram(keys, probes))))
        moved = []
        for k in open_:
            was = low[k], high[k]
            # Of keys with the same bytes below them the last one holds the aim.
            low[k] = max([low[k], *[x for x in below if x[1] <= aims[k]]], key=lambda x: x[0])
            high[k] = min([high[k], *[x for x in below if x[1] > aims[k]]], key=lambda x: (x[0] is None, x[0] or LOWEST))
            if (low[k], high[k]) != was and not min(aims[k] - low[k][1], high[k][1] - aims[k]) < slack:
                moved.append(k)
        open_ = moved
    near = [lo if hi[0] is None or aim - lo[1] <= hi[1] - aim else hi for lo, hi, aim in zip(low, high, aims)]
    # The texts around the aims, from their first key to the next text's.
    ends = {lo[0][0]: ((lo[0][0], LOWEST[1]), (lo[0][0] + 1, LOWEST[1])) for lo in low if lo[0] > LOWEST}
    edges = sorted({e for both in ends.values() for e in both})
    upto = dict(zip(edges, map(int, _histogram(keys, edges)))) if edges else {}
    found = []
    for aim, (lo, _), (cut, _) in zip(aims, low, near):
        if lo[0] in ends:
            a, b = ends[lo[0]]
            if upto[b] - upto[a] <= group_share * whole / n and upto[a] <= aim:
                cut = a if aim - upto[a] <= upto[b] - aim else b
        found.append(cut)
    return sorted(found)


def shard_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus 1; null text: 1), text_crc32, law, shard, slot, grown_shard for each row of docs.

    law is `bytes`: shards hold nearly equal sizes, as near as whole rows allow. Rows alike in doc_id and text
    stay in one shard; so do equal texts, unless they hold more than GROUP_SHARE of a shard's bytes: then they stand
    side by side and are split where a shard ends among them. slot counts a shard's rows from 0 without gaps, in the
    order of the sort; rows alike in doc_id and text are alike in the result, so reruns agree. grown_shard is null.
    Null texts are as empty ones. An empty table gives no rows; with fewer rows than shards some shards are empty.
    Other columns of docs are not read.
    """
    high, low = shard_key(F.col(doc_id), F.col(text))
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_bytes(F.col(text)).alias("size"), crc.alias("text_crc32"), high.alias("high"), low.alias("low"))
    own = ["high", "low", "doc_id", "size", "text_crc32"]
    keys = written(rows.groupBy(*own).agg(F.count(F.lit(1)).alias("rows")).withColumn("bytes", F.col("size") * F.col("rows")))
    splitters = find_splitters(keys.select("high", "low", "bytes"), shards, tolerance)
    past = [(F.col("high") > h) | ((F.col("high") == h) & (F.col("low") >= b)) for h, b in splitters]
    dealt = keys.withColumn("shard", sum((p.cast("int") for p in past), F.lit(0)))
    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = numbered(dealt, [F.col(k) for k in own], parts, "nth", {"upto": F.col("rows")})
    per = dealt.groupBy("shard").agg(F.sum("rows").alias("n"))
    ahead = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(F.col("shard").alias("s_shard"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    first = F.col("upto") - F.col("rows") - F.col("start")
    return placed.join(F.broadcast(starts), F.col("shard") == F.col("s_shard")).select(  # a row a shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        F.explode(F.sequence(first.cast("long"), (first + F.col("rows") - 1).cast("long"))).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )

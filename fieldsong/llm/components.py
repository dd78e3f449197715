"""Connected components of links by alternating stars, in a number of rounds that grows as the graph's logarithm."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fieldsong.llm.common import discard, written

#: Links that one task takes in a moment; tables of no more need no rounds, each of which costs the driver a few jobs.
FEW = 100_000


def _kept(links: DataFrame) -> tuple[DataFrame, tuple]:
    """links as a written table, and how many there are with a digest of them, told by the job that writes it."""
    seen = Observation()
    now = written(links.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("digest")))
    return now, (seen.get["n"], seen.get["digest"])


def _joined(links: DataFrame) -> DataFrame:
    """links(u, v) of FEW rows at most as the star of each component, by one task: v is the smallest node that links reach from u."""
    kind = links.schema

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def top(x):
            while (above := up.get(x, x)) != x:
                up[x] = above = up.get(above, above)
                x = above
            return x

        types = None
        for batch in batches:
            types = batch.schema
            for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist()):
                a, b = top(u), top(v)
                if a != b:
                    up[max(a, b)] = min(a, b)
        if up:
            yield pa.RecordBatch.from_pydict({"u": list(up), "v": [top(x) for x in list(up)]}, types)

    return links.coalesce(1).mapInArrow(join, kind)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: the smallest node that links reach from it, for each node that has a smaller one.

    In a round, each node's larger neighbours, then its smaller ones, are linked to the smallest in its
    neighbourhood instead; at the end every node is linked to its root. Neighbourhoods are never gathered: a
    minimum by node (summed up map-side) is joined back, and a hub's links are dealt over tasks by Spark's skew
    join. Each round's links are written, so a lost executor costs one round at most. FEW links or fewer are joined by
    one task at once.
    """
    high, low = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    table, state = _kept(links.where(F.col(a) != F.col(b)).select(high, low).distinct())
    olds: list[DataFrame] = []
    while state[0] > FEW:
        both = table.unionByName(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        # table has every pair once, u above v: both ends of it learn the smallest around the other.
        large = both.join(least, F.col("u") == F.col("w")).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        below = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        met = large.join(below, F.col("u") == F.col("w"))
        small = met.select("u", F.col("m").alias("v")).unionByName(met.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        was, olds = state, [*olds, table]
        table, state = _kept(small.distinct())
        if state == was:
            break
    if 0 < state[0] <= FEW:
        olds, table = [*olds, table], written(_joined(table))
    discard(*olds)
    return table.select(F.col("u").alias("node"), F.col("v").alias("root"))

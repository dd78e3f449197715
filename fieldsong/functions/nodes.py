"""Nodes of a wavelet packet tree, numbered from the root 0 in breadth, as a table of frequency bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def level_of(node: Column) -> Column:
    return F.floor(F.log2(node + 1)).cast("int")


def band_order(position: Column) -> Column:
    """The place in frequency of the node at a position in its level: every second split is turned round, as in Gray code."""
    out = position
    for shift in (1, 2, 4, 8):
        out = out.bitwiseXOR(F.shiftright(out, shift))
    return out


def band_position(node: int) -> int:
    """band_order() of one node, in plain numbers."""
    out = node + 1 - (1 << (node + 1).bit_length() - 1)
    for shift in (1, 2, 4, 8):
        out ^= out >> shift
    return out


def node_bands(spark: SparkSession, levels: int, rate: int) -> DataFrame:
    """node, level, f_lo, f_hi for all nodes down to a level."""
    nodes = spark.range(2 ** (levels + 1) - 1).select(F.col("id").cast("int").alias("node"))
    nodes = nodes.withColumn("level", level_of(F.col("node")))
    width = F.lit(rate / 2.0) / F.pow(F.lit(2.0), F.col("level"))
    position = (F.col("node") + 1 - F.pow(F.lit(2.0), F.col("level"))).cast("int")
    nodes = nodes.withColumn("place", band_order(position))
    return nodes.select("node", "level", (F.col("place") * width).alias("f_lo"), ((F.col("place") + 1) * width).alias("f_hi"))


def bands_of(rates: DataFrame, by: list[str], rate: str, levels: int) -> DataFrame:
    """by, node, level, f_lo, f_hi for recordings of any rate."""
    unit = node_bands(rates.sparkSession, levels, 1)
    each = rates.select(*by, F.col(rate).cast("double").alias("own_rate")).join(F.broadcast(unit))  # the nodes of a tree, 2,047 at most
    return each.select(*by, "node", "level", (F.col("f_lo") * F.col("own_rate")).alias("f_lo"), (F.col("f_hi") * F.col("own_rate")).alias("f_hi"))


def overlapping(nodes: DataFrame, low: float, high: float) -> DataFrame:
    """Nodes whose bands overlap [low, high], more than at an end."""
    return nodes.where((F.col("f_lo") < high) & (F.col("f_hi") > low))

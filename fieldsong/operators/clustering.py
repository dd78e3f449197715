"""Clusters of call types: library models on features, distances of unequal series, and numbering of clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType
from pyspark.sql.window import Window

MODELS = {"kmeans": KMeans, "hierarchical": BisectingKMeans, "mixture": GaussianMixture}


def scaled(df: DataFrame, features: str = "features") -> DataFrame:
    """Features less their mean and over their deviation; constant ones become 0."""
    vectors = df.withColumn("raw", array_to_vector(F.col(features)))
    model = StandardScaler(inputCol="raw", outputCol="std", withMean=True, withStd=True).fit(vectors)
    return model.transform(vectors).withColumn(features, vector_to_array("std")).drop("raw", "std")


def clustered(df: DataFrame, k: int, model: str = "kmeans", features: str = "features", seed: int = 1) -> DataFrame:
    """df with `cluster`."""
    vectors = df.withColumn("vec", array_to_vector(F.col(features)))
    fitted = MODELS[model](k=k, seed=seed, featuresCol="vec", predictionCol="cluster").fit(vectors)
    return fitted.transform(vectors).drop("vec", "probability")


def silhouette(df: DataFrame, features: str = "features", cluster: str = "cluster") -> float:
    return ClusteringEvaluator(featuresCol="vec", predictionCol=cluster).evaluate(df.withColumn("vec", array_to_vector(F.col(features))))


def centres(df: DataFrame, features: str = "features", cluster: str = "cluster") -> DataFrame:
    """cluster, centre: means of the features."""
    each = df.select(cluster, F.posexplode(features).alias("k", "x")).groupBy(cluster, "k").agg(F.avg("x").alias("x"))
    return each.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda p: p["x"]).alias("centre"))


def renumbered(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """Cluster numbers without gaps, in their order."""
    order = df.select(cluster).distinct()
    order = order.withColumn("new_no", F.row_number().over(Window.orderBy(cluster)) - 1)  # one row a cluster
    return df.join(F.broadcast(order), cluster).withColumn(cluster, F.col("new_no")).drop("new_no")


def merged(df: DataFrame, chosen: list[int], cluster: str = "cluster") -> DataFrame:
    """The chosen clusters as the first, the others after it in their order."""
    first = df.withColumn(cluster, F.when(F.col(cluster).isin(chosen), -1).otherwise(F.col(cluster)))
    return renumbered(first, cluster)


def warped(a: np.ndarray, b: np.ndarray) -> float:
    """Dynamic time warping of two series: the least sum of differences along a path, one anti-diagonal at a time."""
    far = np.full((len(a) + 1, len(b) + 1), np.inf)
    far[0, 0] = 0
    cost = np.abs(np.subtract.outer(a, b))
    for d in range(2, len(a) + len(b) + 1):
        i = np.arange(max(1, d - len(b)), min(len(a), d - 1) + 1)
        j = d - i
        far[i, j] = cost[i - 1, j - 1] + np.minimum(np.minimum(far[i - 1, j], far[i, j - 1]), far[i - 1, j - 1])
    return float(far[len(a), len(b)])


@F.pandas_udf(DoubleType())
def _warp(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([warped(np.asarray(x, float), np.asarray(y, float)) for x, y in zip(a, b)], dtype=float)


def warping_distance(a: Column, b: Column) -> Column:
    return _warp(a, b)


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    row = np.zeros(len(b) + 1, dtype=int)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
    return int(row[-1])


def subsequence(a: list, b: list) -> list:
    """The longest common subsequence itself; of equally long ones the one whose last values stand earliest in b, then in a."""
    n, m = len(a), len(b)
    far = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            far[i + 1][j + 1] = far[i][j] + 1 if a[i] == b[j] else max(far[i][j + 1], far[i + 1][j])
    out, i, j = [], n, m
    while i and j:
        if far[i][j] == far[i][j - 1]:
            j -= 1
        elif far[i][j] == far[i - 1][j]:
            i -= 1
        else:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
    return out[::-1]


@F.pandas_udf(ArrayType(IntegerType()))
def _subsequence(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([subsequence(list(x), list(y)) if x is not None and y is not None else None for x, y in zip(a, b)], dtype=object)


def common_part(a: Column, b: Column) -> Column:
    """The longest common subsequence of two columns of whole numbers; null for null."""
    return _subsequence(a, b)


def density_links(pairs: DataFrame, radius: float, least: int) -> DataFrame:
    """Links a, b of density clusters from pairs(a, b, d), each pair once: both within radius, one at least a core.

    A core has least neighbours with itself. Groups of linked cores are the clusters (see align.recorder_groups).
    """
    near = pairs.where(F.col("d") <= radius)
    both = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    cores = both.groupBy("a").agg((F.count(F.lit(1)) + 1).alias("n")).where(F.col("n") >= least).select(F.col("a").alias("core"))
    return near.join(cores, near.a == cores.core).select("a", "b").union(near.join(cores, near.b == cores.core).select("a", "b")).distinct()

"""Evaluation of detections: confusion counts, correlations, thresholds, cluster agreement."""

from __future__ import annotations

from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldsong.sources.scratch import written


def confusion(df: DataFrame, by: list[str], truth: Column, predicted: Column, beta: float = 2.0) -> DataFrame:
    """tp, fp, tn, fn, recall, precision and the F-score; null where a denominator is 0."""
    of = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    counts = df.groupBy(*by).agg(of(truth & predicted).alias("tp"), of(~truth & predicted).alias("fp"), of(~truth & ~predicted).alias("tn"), of(truth & ~predicted).alias("fn"))
    share = lambda x, y: x / F.when(y != 0, y)
    counts = counts.withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp")))
    b2 = beta * beta
    return counts.withColumn("fbeta", share((1 + b2) * F.col("recall") * F.col("precision"), F.col("recall") + b2 * F.col("precision")))


def point_biserial(df: DataFrame, by: list[str], value: str, truth: Column) -> DataFrame:
    """r: how a value goes with a 0/1 truth; 0 where the value is constant or a class is empty."""
    agg = df.groupBy(*by).agg(
        F.avg(F.when(truth, F.col(value))).alias("m1"), F.avg(F.when(~truth, F.col(value))).alias("m0"),
        F.stddev_pop(value).alias("sd"), F.sum(F.when(truth, 1).otherwise(0)).alias("n1"), F.sum(F.when(truth, 0).otherwise(1)).alias("n0"),
    )
    n = F.col("n0") + F.col("n1")
    r = (F.col("m1") - F.col("m0")) / F.when(F.col("sd") > 0, F.col("sd")) * F.sqrt(F.col("n0") * F.col("n1")) / n
    return agg.select(*by, F.coalesce(r, F.lit(0.0)).alias("r"))


def threshold_counts(df: DataFrame, by: list[str], truth: Column, score: Column, thresholds: list[float]) -> DataFrame:
    """tp, fp, tn, fn, tpr, fpr at each threshold (score >= threshold is a detection).

    Each row falls between two thresholds; counts of these steps are summed up along the thresholds, so rows are
    not multiplied by them.
    """
    ordered = sorted(thresholds)
    step = F.size(F.filter(F.array(*[F.lit(float(t)) for t in ordered]), lambda t: t <= score))
    steps = df.groupBy(*by, step.alias("step")).agg(F.sum(F.when(truth, 1).otherwise(0)).alias("pos"), F.sum(F.when(truth, 0).otherwise(1)).alias("neg"))
    spark = df.sparkSession
    grid = F.broadcast(spark.createDataFrame([(k + 1, float(t)) for k, t in enumerate(ordered)], "k int, threshold double"))
    keys = steps.select(*by).distinct() if by else spark.range(1).select(F.lit(0).alias("_"))
    joined = keys.join(grid, F.col("k") > 0).withColumnRenamed("k", "at")  # thresholds are a short list
    cond = F.lit(True)
    right = steps
    for c in by:
        right = right.withColumnRenamed(c, f"r_{c}")
        cond = cond & F.col(c).eqNullSafe(F.col(f"r_{c}"))
    hit = lambda c, reached: F.sum(F.when(reached, F.col(c)).otherwise(0)).cast("long")
    got = F.col("step") >= F.col("at")
    out = joined.join(right, cond).groupBy(*by, "threshold").agg(hit("pos", got).alias("tp"), hit("neg", got).alias("fp"), hit("neg", ~got).alias("tn"), hit("pos", ~got).alias("fn"))
    rate = lambda x, y: x / F.when(x + y != 0, x + y)
    return out.withColumn("tpr", rate(F.col("tp"), F.col("fn"))).withColumn("fpr", rate(F.col("fp"), F.col("tn")))


def network_thresholds(roc: DataFrame, by: list[str]) -> DataFrame:
    """lower: the threshold nearest to the perfect corner; upper: the first with no false positives, else the last."""
    nearest = F.min_by("threshold", F.struct(((1 - F.col("tpr")) * (1 - F.col("tpr")) + F.col("fpr") * F.col("fpr")).alias("d"), "threshold"))
    clean = F.coalesce(F.min(F.when(F.col("fpr") == 0, F.col("threshold"))), F.max("threshold"))
    return roc.groupBy(*by).agg(nearest.alias("lower"), clean.alias("upper"))


def cluster_agreement(df: DataFrame, truth: str, found: str) -> DataFrame:
    """homogeneity, completeness, v_measure and adjusted_rand of two labellings, from their table of counts."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(found).alias("c")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = lambda name: cells.groupBy(name).agg(F.sum("n").alias("n"))
    pairs = F.sum(F.col("n") * (F.col("n") - 1) / 2)
    bits = F.sum(F.col("n") * F.ln("n"))
    measured = lambda d, k: d.agg(F.sum("n").alias(f"n_{k}"), pairs.alias(f"p_{k}"), bits.alias(f"b_{k}"))
    one = measured(cells, "x").join(measured(sums("t"), "t"), F.lit(True)).join(measured(sums("c"), "c"), F.lit(True))  # one row each
    n = F.col("n_x")
    h_t, h_c = F.ln(n) - F.col("b_t") / n, F.ln(n) - F.col("b_c") / n
    mutual = F.ln(n) + F.col("b_x") / n - F.col("b_t") / n - F.col("b_c") / n
    one = one.select(
        F.when(h_t == 0, 1.0).otherwise(mutual / h_t).alias("homogeneity"), F.when(h_c == 0, 1.0).otherwise(mutual / h_c).alias("completeness"),
        (F.col("p_t") * F.col("p_c") / (n * (n - 1) / 2)).alias("expected"), ((F.col("p_t") + F.col("p_c")) / 2).alias("most"), F.col("p_x").alias("pairs"),
    )
    h, c = F.col("homogeneity"), F.col("completeness")
    return one.select(
        "homogeneity", "completeness", F.when(h + c == 0, 0.0).otherwise(2 * h * c / (h + c)).alias("v_measure"),
        F.when(F.col("most") == F.col("expected"), 1.0).otherwise((F.col("pairs") - F.col("expected")) / (F.col("most") - F.col("expected"))).alias("adjusted_rand"),
    )


def adjusted_mutual_information(df: DataFrame, truth: str, found: str) -> DataFrame:
    """ami: mutual information of two labellings less what chance gives, over the mean of their entropies less the same; 1 where both have one label.

    What chance gives is a sum over pairs of labels and the counts that a pair could have; it comes from the labels' sizes
    alone, so only tables of labels are joined. Nulls are a label.
    """
    cells = written(df.groupBy(F.col(truth).alias("t"), F.col(found).alias("c")).agg(F.count(F.lit(1)).cast("double").alias("n")))
    a, b = (cells.groupBy(k).agg(F.sum("n").alias(x)) for k, x in (("t", "a"), ("c", "b")))
    total = cells.agg(F.sum("n").alias("z"))

    def chance(one: pd.Series, other: pd.Series, z: pd.Series) -> pd.Series:
        out = []
        log = np.frompyfunc(lgamma, 1, 1)
        for x, y, n in zip(one, other, z):
            k = np.arange(max(1.0, x + y - n), min(x, y) + 1)
            weigh = lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - sum(log(v + 1).astype(float) for v in (k, x - k, y - k, n - x - y + k))
            out.append(float((k / n * np.log(n * k / (x * y)) * np.exp(weigh)).sum()))
        return pd.Series(out, dtype=float)

    every = a.join(b).join(F.broadcast(total))  # two tables of labels, and one row
    expected = every.agg(F.sum(F.pandas_udf(chance, "double")("a", "b", "z")).alias("expected"))
    side = lambda k: F.sum("n").over(Window.partitionBy(k))
    met = cells.withColumns({"a": side("t"), "b": side("c")}).join(F.broadcast(total))
    mutual = met.agg(F.sum(F.col("n") / F.col("z") * F.ln(F.col("z") * F.col("n") / (F.col("a") * F.col("b")))).alias("mutual"))
    entropy = lambda v, x: v.join(F.broadcast(total)).agg((-F.sum(F.col(x) / F.col("z") * F.ln(F.col(x) / F.col("z")))).alias(f"h_{x}"))
    one = mutual.join(expected).join(entropy(a, "a")).join(entropy(b, "b"))  # one row each
    span = (F.col("h_a") + F.col("h_b")) / 2 - F.col("expected")
    return one.select(F.when(span.isNull(), None).when(F.abs(span) < 1e-12, 1.0).otherwise((F.col("mutual") - F.col("expected")) / span).alias("ami"))


def majority(df: DataFrame, by: list[str], label: str) -> DataFrame:
    """by, label, votes: the commonest label; of equally common ones the first in order."""
    counts = df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("votes"))
    first = Window.partitionBy(*by).orderBy(F.desc("votes"), label)
    return counts.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def bat_label(df: DataFrame, by: list[str], long: Column, short: Column, mean_least: float, best_least: float) -> DataFrame:
    """Certainties of the two bat kinds of a file from its clicks' probabilities (null: no such label).

    A kind's mean and the sum of its three best over three, in percent, are held against mean_least and
    best_least: certain if both reach them, possible if one does.
    """
    best = lambda c: F.aggregate(F.slice(F.sort_array(F.collect_list(c), asc=False), 1, 3), F.lit(0.0), lambda a, x: a + x) / 3 * 100
    file = df.groupBy(*by).agg((F.avg(long) * 100).alias("l_mean"), (F.avg(short) * 100).alias("s_mean"), best(long).alias("l_best"), best(short).alias("s_best"))

    def certainty(m: str, b: str, om: str, ob: str) -> Column:
        mean, high, other, other_high = F.col(m) >= mean_least, F.col(b) >= best_least, F.col(om) >= mean_least, F.col(ob) >= best_least
        sure, other_none, other_sure = mean & high, ~other & ~other_high, other & other_high
        return F.when(sure & (other_none | other_sure), 100).when((mean | high) & ~other, 50).when(mean & other, 50)

    return file.select(*by, *["l_mean", "s_mean", "l_best", "s_best"], certainty("l_mean", "l_best", "s_mean", "s_best").alias("long_tailed"), certainty("s_mean", "s_best", "l_mean", "l_best").alias("short_tailed"))

"""Groups from links and distances: components with offsets, single-linkage trees, mean shift, affinity propagation.

All of them are rounds of joins and aggregations on tables of links; each round is written, so that a lost executor
costs a task and plans stay short. Components and trees contract what a round has joined, so rounds grow with the
logarithm of the longest chain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldsong.sources.scratch import written


def settled(up: DataFrame) -> DataFrame:
    """id, root, shift of up(id, up, shift): each id's last ancestor and the shifts on the way. Roots have no row; there are no circles.

    Every round doubles how far an id sees.
    """
    now = written(up)
    while True:
        above = now.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("shift").alias("more"))
        if now.join(above, "up", "left_semi").isEmpty():
            return now.select("id", F.col("up").alias("root"), "shift")
        now = written(now.join(above, "up", "left").select("id", F.coalesce("further", "up").alias("up"), (F.col("shift") + F.coalesce("more", F.lit(0.0))).alias("shift")))


def connected(links: DataFrame) -> DataFrame:
    """id, root, shift of links(a, b, shift), where a lies shift after b: the smallest id that is linked to it, and how far after it id lies.

    A round hooks every root to the neighbour that comes first in an order drawn anew, and contracts. If the links of a
    circle disagree, one of the paths counts, the same one each time. Links with a null end are left out; a link of an
    id with itself makes it a group.
    """
    links = links.select("a", "b", F.col("shift").cast("double").alias("shift")).where("a is not null and b is not null")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), (-F.col("shift")).alias("shift")))
    labels = written(both.select(F.col("a").alias("id")).distinct().withColumns({"root": F.col("id"), "shift": F.lit(0.0)}))
    live, turn = written(both.where("a <> b").groupBy("a", "b").agg(F.min("shift").alias("shift"))), 0
    while not live.isEmpty():
        order = lambda c, k=turn: F.struct(F.xxhash64(F.lit(k), F.col(c)), F.col(c))
        hooks = live.where(order("b") < order("a")).groupBy("a").agg(F.min_by(F.struct("b", "shift"), F.struct(order("b"), F.col("shift"))).alias("x"))
        up = settled(hooks.select(F.col("a").alias("id"), F.col("x.b").alias("up"), F.col("x.shift").alias("shift")))
        of = lambda c, up=up: up.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"), F.col("shift").alias(f"{c}_shift"))
        labels = written(labels.join(of("root"), "root", "left").select("id", F.coalesce("root_root", "root").alias("root"), (F.col("shift") + F.coalesce("root_shift", F.lit(0.0))).alias("shift")))
        met = live.join(of("a"), "a", "left").join(of("b"), "b", "left")
        shift = F.col("shift") + F.coalesce("b_shift", F.lit(0.0)) - F.coalesce("a_shift", F.lit(0.0))
        met = met.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"), shift.alias("shift"))
        live, turn = written(met.where("a <> b").groupBy("a", "b").agg(F.min("shift").alias("shift"))), turn + 1
    first = labels.groupBy("root").agg(F.min("id").alias("least"), F.min_by("shift", "id").alias("base"))
    return labels.join(first, "root").select("id", F.col("least").alias("root"), (F.col("shift") - F.col("base")).alias("shift"))


def spanning_forest(pairs: DataFrame) -> DataFrame:
    """a, b, d: the lightest links of pairs(a, b, d) that join all they join, a < b: the tree of single linkage.

    In each round every group takes its lightest link to another one, of equal ones that with the smallest ends; groups
    that are joined contract, and of the links between two groups the lightest is kept. Pairs with nulls or of an id
    with itself are left out, pairs given twice count once.
    """
    pairs = pairs.where("a <> b and d is not null").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.col("d").cast("double").alias("d"))
    light = F.min(F.struct("d", "x", "y")).alias("link")
    one = pairs.groupBy("x", "y").agg(F.min("d").alias("d"))
    live = written(one.select(F.col("x").alias("p"), F.col("y").alias("q"), F.struct("d", "x", "y").alias("link")).unionByName(one.select(F.col("y").alias("p"), F.col("x").alias("q"), F.struct("d", "x", "y").alias("link"))))
    parts = []
    while not live.isEmpty():
        best = written(live.groupBy("p").agg(F.min(F.struct("link", "q")).alias("m")).select("p", "m.link", "m.q"))
        parts.append(best.select(F.col("link.x").alias("a"), F.col("link.y").alias("b"), F.col("link.d").alias("d")).distinct())
        back = best.select(F.col("p").alias("q"), F.col("q").alias("answer"))
        # Two groups that chose each other stand under the smaller one.
        tree = best.join(back, "q").where((F.col("answer") != F.col("p")) | (F.col("p") > F.col("q")))
        up = settled(tree.select(F.col("p").alias("id"), F.col("q").alias("up"), F.lit(0.0).alias("shift")))
        of = lambda c, up=up: up.select(F.col("id").alias(c), F.col("root").alias(f"{c}_root"))
        met = live.join(of("p"), "p", "left").join(of("q"), "q", "left").select(F.coalesce("p_root", "p").alias("p"), F.coalesce("q_root", "q").alias("q"), "link.*")
        live = written(met.where("p <> q").groupBy("p", "q").agg(light))
    out = parts[0] if parts else one.select(F.col("x").alias("a"), F.col("y").alias("b"), "d")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cut_tree(forest: DataFrame, ids: DataFrame, height: float | None = None, clusters: int | None = None) -> DataFrame:
    """id, cluster (its smallest id): single-linkage groups of ids(id), up to a height, or as many as asked for.

    For a number of clusters the heaviest links are left out, of equal ones those with the largest ends first; if the
    forest has more trees than that, each tree is a cluster. Ids without links are clusters of their own.
    """
    kept = forest if height is None else forest.where(F.col("d") <= height)
    if clusters is not None:
        drop = clusters - (ids.select("id").distinct().count() - forest.count())
        if drop > 0:
            kept = kept.join(F.broadcast(forest.orderBy(F.desc("d"), F.desc("a"), F.desc("b")).limit(drop)), ["a", "b"], "left_anti")  # fewer than clusters
    roots = connected(kept.select("a", "b", F.lit(0.0).alias("shift")))
    return ids.join(roots.select("id", "root"), "id", "left").select("id", F.coalesce("root", "id").alias("cluster"))


def class_radius(distances: DataFrame, by: str, share: float = 0.1) -> DataFrame:
    """by, radius: the distance that a share of a class's positive distances does not exceed; 0 if it has none."""
    return distances.groupBy(by).agg(F.coalesce(F.percentile(F.when(F.col("d") > 0, F.col("d")), share), F.lit(0.0)).alias("radius"))


def nearest_class(distances: DataFrame, radii: DataFrame) -> DataFrame:
    """id, label: of distances(id, label, d) to members of classes the class with the least mean, if that is within its radius; else null (a new class)."""
    mean = distances.groupBy("id", "label").agg(F.avg("d").alias("mean"))
    best = mean.groupBy("id").agg(F.min(F.struct("mean", "label")).alias("m")).select("id", "m.*")
    return best.join(radii, "label", "left").select("id", F.when(F.col("mean") <= F.col("radius"), F.col("label")).alias("label"))


#: Grid cells that mean shift starts from, at most: its peaks are compared with each other.
MOST_PEAKS = 10_000


def _cells(x: str, size: float, at: int) -> Column:
    return F.floor(F.element_at(x, at) / size)


def mean_shift(points: DataFrame, width: float, rounds: int = 300, still: float = 1e-3) -> DataFrame:
    """id, cluster, centre of points(id, x), x an array of two values or more: peaks of density, by moving to the mean within a width.

    One seed starts in each cell, width wide, that has points, and moves to the mean of the points within width until no
    seed moves by more than still x width. Only points in the cell of a seed or next to it, in the first two values, can
    be near enough: they meet by the cell as key. Seeds within width of one with more points near it give way. Points
    belong to the nearest peak; clusters are numbered from the peak with the most points. Seeds with no point near are
    dropped; points with a null or unequal length of x have no cluster.
    """
    size = points.select(F.size("x").alias("n")).where("n > 1").groupBy("n").count().orderBy(F.desc("count"), "n").first()
    dims = size.n if size else 2
    good = points.where((F.size("x") == dims) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    table = written(good.select("id", F.transform("x", lambda v: v.cast("double")).alias("x"), *[_cells("x", width, k + 1).alias(f"c{k}") for k in range(2)]))
    cells = table.groupBy("c0", "c1").agg(F.min(F.struct("id", "x")).alias("first"))
    seeds = written(cells.select(F.monotonically_increasing_id().alias("seed"), F.col("first.x").alias("at"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("near")))
    apart = F.sqrt(F.aggregate(F.zip_with("x", "at", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    around_it = F.array(*[F.struct((_cells("at", width, 1) + i).alias("c0"), (_cells("at", width, 2) + k).alias("c1")) for i in (-1, 0, 1) for k in (-1, 0, 1)])
    for _ in range(rounds):
        moving = seeds.where(~F.col("done"))
        if moving.isEmpty():
            break
        around = moving.select("seed", "at", F.explode(around_it).alias("c")).select("seed", "at", "c.*")
        met = table.join(around, ["c0", "c1"]).where(apart <= width)
        moved = met.groupBy("seed").agg(F.first("at").alias("old"), vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("new"), F.count(F.lit(1)).alias("near"))
        step = F.sqrt(F.aggregate(F.zip_with("old", "new", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
        seeds = written(seeds.where("done").unionByName(moved.select("seed", F.col("new").alias("at"), (step <= still * width).alias("done"), "near")))
        # Seeds that have met go on as one.
        spot = F.transform("at", lambda v: F.round(v / (still * width)))
        seeds = seeds.groupBy(spot.alias("spot")).agg(F.min_by(F.struct("seed", "at", "done", "near"), F.struct(~F.col("done"), F.col("seed"))).alias("s")).select("s.*")
    peaks = seeds.where("near > 0").orderBy(F.desc("near"), "at").limit(MOST_PEAKS + 1).collect()
    if len(peaks) > MOST_PEAKS:
        raise ValueError(f"more than {MOST_PEAKS} peaks of density: the width is too small for these points")
    centres: list[np.ndarray] = []
    for p in peaks:
        v = np.array(p["at"])
        if not centres or np.linalg.norm(np.stack(centres) - v, axis=1).min() > width:
            centres.append(v)
    sent = points.sparkSession.sparkContext.broadcast(np.stack(centres) if centres else np.zeros((0, dims)))
    kind = dict(points.dtypes)["id"]

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        for b in batches:
            if len(b) and len(c):
                own = np.concatenate([((np.stack(b["x"][k : k + 256])[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1) for k in range(0, len(b), 256)])
                yield pd.DataFrame({"id": b["id"], "cluster": own, "centre": list(c[own])})

    return table.select("id", "x").mapInPandas(nearest, f"id {kind}, cluster int, centre array<double>")


def exemplars(similar: DataFrame, damping: float = 0.5, rounds: int = 60, quiet: int = 5) -> DataFrame:
    """id, exemplar by affinity propagation on similar(i, k, s): how well k would stand for i, with (i, i) its own preference.

    Each round, a row's responsibilities need its two best sums of availability and similarity, and a column's
    availabilities the sum of positive responsibilities: one shuffle by row and one by column. Rounds end when the exemplars have not
    changed, by their number and hashes, for `quiet` of them. Only given pairs send messages, so the graph decides the work; an id that chooses no
    exemplar stands for itself.
    """
    kinds = dict(similar.dtypes)
    messages = written(similar.where("s is not null").groupBy("i", "k").agg(F.max("s").cast("double").alias("s")).withColumns({"r": F.lit(0.0), "a": F.lit(0.0)}))
    last, same = None, 0
    row, column = Window.partitionBy("i"), Window.partitionBy("k")
    ranked = row.orderBy(F.desc("v"), "k")
    for _ in range(rounds):
        x = messages.withColumn("v", F.col("a") + F.col("s")).withColumn("nth", F.row_number().over(ranked))
        top, second = F.max("v").over(row), F.max(F.when(F.col("nth") > 1, F.col("v"))).over(row)
        r = F.col("s") - F.coalesce(F.when(F.col("nth") == 1, second).otherwise(top), F.lit(0.0))
        x = x.withColumn("r", damping * F.col("r") + (1 - damping) * r).drop("v", "nth")
        self_r = F.max(F.when(F.col("i") == F.col("k"), F.col("r"))).over(column)
        plus = F.sum(F.when(F.col("i") != F.col("k"), F.greatest("r", F.lit(0.0))).otherwise(0.0)).over(column)
        a = F.when(F.col("i") == F.col("k"), plus).otherwise(F.least(F.lit(0.0), F.coalesce(self_r, F.lit(0.0)) + plus - F.greatest("r", F.lit(0.0))))
        messages = written(x.withColumn("a", damping * F.col("a") + (1 - damping) * a))
        now = messages.where("i = k and a + r > 0").agg(F.count(F.lit(1)), F.sum(F.xxhash64("k") % (1 << 40)), F.bit_xor(F.xxhash64("k"))).first()
        same, last = same + 1 if now == last else 0, now
        if same >= quiet and now[0]:
            break
    chosen = messages.where("i = k and a + r > 0").select("k")
    best = messages.where("i <> k").join(chosen, "k", "left_semi").groupBy("i").agg(F.max_by("k", F.struct("s", F.struct("k"))).alias("k"))
    ids = messages.select(F.col("i").alias("id")).distinct()
    own = chosen.select(F.col("k").alias("id"), F.col("k").alias("own"))
    return ids.join(own, "id", "left").join(best.withColumnRenamed("i", "id"), "id", "left").select("id", F.coalesce("own", "k", "id").cast(kinds["k"]).alias("exemplar"))

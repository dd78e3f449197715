"""Approximate nearest neighbours: an inverted file of coarse centroids with product-quantised residuals.

Centroids and codebooks are fitted on a bounded sample; every vector is filed under its nearest centroid with
the code of what is left. A query looks through the lists of its nearest centroids: a table of its products with
all codewords gives each filed code's approximate score, and the best are scored exactly on the vectors
themselves. How many lists are looked through is set by how far down a set of trial queries, answered exactly,
find their true neighbours.

Equal vectors are filed once, with their smallest ids, so a vector that a third of all rows share is one entry.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldsong.llm.common import written

NEAREST = 5
QUERY_EVERY = 50
#: Vectors that the model is fitted on, and queries that set the number of lists, at most.
FIT_ROWS, TRIALS = 16_384, 128
MOST_LISTS, PART_DIMS, CODEWORDS = 4096, 4, 256
#: Share of the trial queries' true neighbours that the lists looked through must hold.
WITHIN = 0.98
#: Vectors filed together at least, and queries that meet them at once.
GROUP_ROWS, GROUP_QUERIES = 16_384, 4096
#: Candidates of a group that are scored exactly first, for each query, and deviations that squared distances by codes are taken to be off at most.
RERANKED, OFF = 160, 4.0


class Index(NamedTuple):
    centroids: np.ndarray  # lists x dimensions
    codebooks: np.ndarray  # parts x codewords x dimensions of a part
    dims: int


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two that bring their largest component near 1: squares neither vanish nor overflow, and nothing is rounded."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=-1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest_of(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """For each row of x the nearest of points, by Euclidean distance; the first of equally near ones."""
    half = (points * points).sum(axis=1) / 2
    return np.concatenate([(x[a : a + 2048] @ points.T - half).argmax(axis=1) for a in range(0, len(x), 2048)]) if len(x) else np.empty(0, int)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    points = x[np.sort(rng.permutation(len(x))[:k])].copy()
    for _ in range(rounds):
        own = nearest_of(x, points)
        n = np.bincount(own, minlength=k)
        for d in range(x.shape[1]):
            total = np.bincount(own, x[:, d], k)
            points[:, d] = np.where(n > 0, total / np.maximum(n, 1), points[:, d])
    return points


def fit(sample: np.ndarray, rows: int, seed: int = 7) -> Index:
    """An index of unit vectors for about so many rows; lists grow with the root of the rows."""
    rng = np.random.default_rng(seed)
    x = unit(sample).astype(np.float32)
    lists = max(1, min(MOST_LISTS, int(rows**0.5), len(x) // 4))
    centroids = k_means(x, lists, 8, rng)
    left = x - centroids[nearest_of(x, centroids)]
    step = PART_DIMS if x.shape[1] % PART_DIMS == 0 else 1
    books = [k_means(np.ascontiguousarray(left[:, a : a + step]), min(CODEWORDS, len(x)), 5, rng) for a in range(0, x.shape[1], step)]
    return Index(centroids, np.stack(books), x.shape[1])


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's list, and the codes of its residual."""
    u = unit(x).astype(np.float32)
    own = nearest_of(u, index.centroids)
    left, step = u - index.centroids[own], index.codebooks.shape[2]
    codes = np.stack([nearest_of(np.ascontiguousarray(left[:, k * step : (k + 1) * step]), b) for k, b in enumerate(index.codebooks)], axis=1)
    return own.astype(np.int32), codes.astype(np.uint8)


def lists_for(index: Index, x: np.ndarray, n: int) -> np.ndarray:
    """The n lists whose centroids are nearest to each vector's direction."""
    near = unit(x).astype(np.float32) @ index.centroids.T - (index.centroids * index.centroids).sum(axis=1) / 2
    return np.argsort(-near, axis=1, kind="stable")[:, :n].astype(np.int32)


def cosines(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Pair by pair, in double precision."""
    a, b = scaled(queries), scaled(rows)
    return (a * b).sum(axis=-1) / (np.sqrt((a * a).sum(axis=-1)) * np.sqrt((b * b).sum(axis=-1)))


def search_group(index: Index, queries: pd.DataFrame, rows: pd.DataFrame, k: int) -> pd.DataFrame:
    """Each query's k best of the rows whose lists it looks through: by their codes, then exactly.

    Codes give squared distances of unit vectors, from what is left of the query in each list, so that they part vectors
    that all lie close together too. After the first RERANKED, those are scored exactly that could still be among the k
    best by how far their codes are off: near vectors far closer to each other than codewords are share their codes.
    """
    q, x = np.stack(queries["vector"]), np.stack(rows["vector"])
    ids, own = rows["rep"].to_numpy(), rows["list"].to_numpy()
    codes = np.frombuffer(b"".join(rows["codes"]), np.uint8).reshape(len(rows), -1)
    unit_q, parts, books = unit(q), len(index.codebooks), index.codebooks.astype(np.float64)
    exact = scaled(x)
    length = np.sqrt((exact * exact).sum(axis=-1))
    kept_of = np.concatenate([books[p][codes[:, p]] for p in range(parts)], axis=1)
    error = exact / length[:, None] - index.centroids[own] - kept_of
    error = np.sqrt((error * error).sum(axis=1))
    squares = (kept_of * kept_of).sum(axis=1)
    del kept_of
    apart = np.full((len(q), len(rows)), np.inf, np.float32)  # squared distances, as codes tell
    probed = np.zeros((len(q), len(index.centroids)), bool)
    for i, some in enumerate(queries["lists"]):
        probed[i, some] = True
    for one in np.unique(own):
        at, who = np.flatnonzero(own == one), np.flatnonzero(probed[:, one])
        if len(who):
            left = unit_q[who] - index.centroids[one]
            tables = np.einsum("qpd,pcd->pqc", left.reshape(len(who), parts, -1), books, optimize=True)
            score = (left * left).sum(axis=1)[:, None] + (squares[at] - error[at] ** 2)[None]
            for p in range(parts):
                score -= 2 * tables[p][:, codes[at, p]]
            apart[np.ix_(who, at)] = score
    n, reach = min(RERANKED, len(rows)), 2 * OFF / np.sqrt(index.dims) * error
    best = np.argpartition(apart, n - 1, axis=1)[:, :n]
    a = scaled(q)
    out = []
    for i, name in enumerate(queries["rep"]):
        cosine = lambda at: (a[i] * exact[at]).sum(axis=-1) / (np.sqrt((a[i] * a[i]).sum()) * length[at])  # noqa: B023, E731
        kept = best[i][apart[i, best[i]] < np.inf]
        score = cosine(kept)
        if k <= len(kept) == n < len(rows):
            far = max(0.0, 2 - 2 * np.partition(score, -k)[-k])
            possible = apart[i] <= far + np.sqrt(far) * reach
            possible[kept] = False
            more = np.flatnonzero(possible)
            kept, score = np.concatenate([kept, more]), np.concatenate([score, cosine(more)])
        first = np.lexsort((ids[kept], -score))[:k]
        out.append(pd.DataFrame({"q_rep": name, "rep": ids[kept[first]], "score": score[first]}))
    return pd.concat(out)


def usable(vector: Column, dims: int | None = None) -> Column:
    """Neither null nor zero, without null or non-finite components (and of the right length)."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    zero = F.forall(vector, lambda v: v == 0)
    ok = vector.isNotNull() & ~bad & ~zero
    return ok if dims is None else ok & (F.size(vector) == dims)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy())


def nearest(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEAREST, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of all rows found for each row whose id is divisible by every.

    A query's own row (its id) is no candidate. Nearness is the cosine in double precision of the original
    vectors; ties go to the smaller id. Vectors that are null, zero, hold null or non-finite components, or
    have not the commonest length, take no part, nor do null ids; rows that repeat an id and a vector count
    once. With k other rows or fewer, all are returned; with no queries, no rows. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull())
    common = rows.where(usable(F.col("vector"))).groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    result = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], result)
    rows = written(rows.where(usable(F.col("vector"), common.n)).withColumn("same", F.xxhash64("vector")))
    # Of equal vectors the k + 1 smallest ids, enough for any query; the smallest names them all.
    alike = Window.partitionBy("same", "vector").orderBy("id")
    few = rows.withColumn("nth", F.dense_rank().over(alike)).where(F.col("nth") <= k + 1)
    reps = few.groupBy("same", "vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    reps = written(reps.select("same", "vector", "ids", F.col("ids")[0].alias("rep"), F.xxhash64("same", F.col("ids")[0]).alias("spot")))
    asked = rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "same", "vector").distinct()
    asked = written(asked.alias("a").join(reps.alias("r"), (F.col("a.same") == F.col("r.same")) & (F.col("a.vector") == F.col("r.vector"))).select(F.col("a.id").alias("query_id"), "r.rep"))
    queries = reps.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "vector", "spot")

    n_rows = reps.count()
    sample = _matrix(reps.orderBy("spot", "rep").limit(FIT_ROWS).select("vector").toPandas()["vector"])
    index = fit(sample, n_rows)
    sent = spark.sparkContext.broadcast(index)  # MOST_LISTS centroids at most

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if len(x):
                own, codes = encode(sent.value, _matrix(x["vector"]))
                yield x.assign(list=own, codes=[c.tobytes() for c in codes])[["rep", "ids", "vector", "list", "codes"]]

    filed = written(reps.select("rep", "ids", "vector").mapInPandas(file, f"rep long, ids array<long>, vector {dict(reps.dtypes)['vector']}, list int, codes binary"))
    sizes = {r.list: r.n for r in filed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # MOST_LISTS rows at most
    probes = _lists_needed(filed, queries, index, k)
    found = written(_search(filed, queries, sent, sizes, probes, k + 1))
    least = min(k + 1, n_rows)
    short = queries.join(found.groupBy("q_rep").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least), F.col("rep") == F.col("q_rep"), "left_anti")
    if probes < len(index.centroids) and not short.isEmpty():  # lists that hold too few: those queries look through all
        rest = _search(filed, short, sent, sizes, len(index.centroids), k + 1)
        found = found.join(short.select(F.col("rep").alias("q_rep")), "q_rep", "left_anti").unionByName(rest)
    near = found.join(filed.select("rep", "ids"), "rep").select("q_rep", "score", F.explode("ids").alias("vec_id"))
    each = asked.join(near, asked.rep == F.col("q_rep")).where(F.col("vec_id") != F.col("query_id"))
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _lists_needed(filed: DataFrame, queries: DataFrame, index: Index, k: int) -> int:
    """How many lists hold WITHIN of the true neighbours of some trial queries, which are answered exactly."""
    trial = queries.orderBy("spot", "rep").limit(TRIALS).toPandas()
    if not len(trial):
        return 1
    q, names = _matrix(trial["vector"]), trial["rep"].to_numpy()

    def exact(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            score = unit(q) @ unit(_matrix(x["vector"])).T
            score[names[:, None] == x["rep"].to_numpy()] = -2
            n = min(k, len(x))
            top = np.argpartition(-score, n - 1, axis=1)[:, :n]
            yield pd.DataFrame({"trial": np.repeat(np.arange(len(q)), n), "list": x["list"].to_numpy()[top].ravel(), "score": np.take_along_axis(score, top, axis=1).ravel()})

    best = Window.partitionBy("trial").orderBy(F.desc("score"), "list")
    true = filed.select("rep", "vector", "list").mapInPandas(exact, "trial int, list int, score double").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).toPandas()
    if not len(true):
        return 1
    order = lists_for(index, q, len(index.centroids))
    depth = np.argsort(order, axis=1)[true["trial"], true["list"]]
    return int(np.sort(depth)[min(len(depth) - 1, int(np.ceil(WITHIN * len(depth))) - 1)]) + 1


def _search(filed: DataFrame, queries: DataFrame, sent, sizes: dict[int, int], probes: int, k: int) -> DataFrame:
    """q_rep, rep, score: each query's k best of the lists that it looks through.

    Small lists are searched together, large ones in parts, so that a task holds about GROUP_ROWS vectors.
    """
    group_of, parts_of, at, held = {}, {}, 0, 0
    for one in sorted(sizes):
        if held and held + sizes[one] > GROUP_ROWS * 1.5:
            at, held = at + 1, 0
        group_of[one] = at
        held += sizes[one]
        parts_of[at] = max(1, -(-held // (2 * GROUP_ROWS)))
    spark = filed.sparkSession
    groups = spark.createDataFrame([(one, g, parts_of[g]) for one, g in group_of.items()], "list int, group int, parts int")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            if not len(x):
                continue
            rows = []
            for rep, vector, lists in zip(x["rep"], x["vector"], lists_for(sent.value, _matrix(x["vector"]), probes)):
                by: dict[int, list[int]] = {}
                for one in lists.tolist():
                    if one in group_of:
                        by.setdefault(group_of[one], []).append(one)
                rows += [(rep, vector, g, some) for g, some in by.items()]
            yield pd.DataFrame(rows, columns=["rep", "vector", "group", "lists"])

    kind = dict(filed.dtypes)["vector"]
    asking = written(queries.select("rep", "vector").mapInPandas(ask, f"rep long, vector {kind}, group int, lists array<int>"))
    turns = asking.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / GROUP_QUERIES).cast("int").alias("turns"))
    # groups and turns have a row a list at most; a group meets its queries in so many turns.
    plan = F.broadcast(groups.join(F.broadcast(turns), "group"))
    left = asking.join(F.broadcast(turns), "group").withColumn("turn", F.pmod(F.xxhash64("rep"), "turns").cast("int"))
    left = left.join(F.broadcast(groups.select("group", "parts").distinct()), "group").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    right = filed.join(plan, "list").withColumn("part", F.pmod(F.xxhash64(F.lit(1), "rep"), "parts").cast("int")).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"q_rep": np.empty(0, np.int64), "rep": np.empty(0, np.int64), "score": np.empty(0)})
        step = 256
        return pd.concat([search_group(sent.value, a[i : i + step], b, k) for i in range(0, len(a), step)])

    keys = ["group", "part", "turn"]
    pairs = left.select(*keys, "rep", "vector", "lists").groupBy(*keys).cogroup(right.select(*keys, "rep", "vector", "list", "codes").groupBy(*keys))
    best = Window.partitionBy("q_rep").orderBy(F.desc("score"), "rep")
    return pairs.applyInPandas(meet, "q_rep long, rep long, score double").withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).drop("nth")

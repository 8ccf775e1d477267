"""Search over candidates (qid, id, dist): top-n, radius, and the relaxed nearest neighbour."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import BLOCK, cells, gathered, grid, packed
from ..functions.kernels import exact_distances, nearest, paired_distances
from ..functions.vec import Distance, l2
from ..plans.sizes import broadcast_if_small, is_small

KNN = "qid long, id long, dist double"
#: Rows of a table of distances that one task should hand on.
TASK_ROWS = 1 << 24


def order_key(dist: Column) -> list[Column]:
    """Ties within rounding go to the smaller id."""
    return [F.round(dist, 9), F.col("id")]


def top_n(found: DataFrame, n: int, by: str = "dist") -> DataFrame:
    """(qid, rank, id, dist): the n nearest candidates of each query; Catalyst keeps n rows per
    query and task before it shuffles."""
    w = Window.partitionBy("qid").orderBy(*order_key(F.col(by)))
    ranked = found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= n)
    return ranked.select("qid", "rank", "id", by)


def within(found: DataFrame, radius: float, by: str = "dist") -> DataFrame:
    """The candidates at a distance of at most ``radius``."""
    return found.where(F.col(by) <= F.lit(float(radius)))


def measured(candidates: DataFrame, queries: DataFrame, distance: Distance = l2) -> DataFrame:
    """(qid, id, dist) of candidates (qid, id, vec), each pair once. Distances are taken where the
    vectors are, so only narrow rows are shuffled to drop repeats."""
    asked = broadcast_if_small(queries.select("qid", "qvec"))
    pairs = candidates.join(asked, "qid").select("qid", "id", distance(F.col("qvec"), F.col("vec")).alias("dist"))
    return pairs.groupBy("qid", "id").agg(F.min("dist").alias("dist"))


def exact_knn(vectors: DataFrame, queries: DataFrame, n: int, exclude_self: bool = False, engine: str = "arrow", distance: Distance = l2) -> DataFrame:
    """The n nearest of all vectors (id, vec) for each query (qid, qvec).

    ``arrow`` walks blocks with NumPy; ``columns`` is the same plan in expressions and takes any
    distance builder. Each task keeps n rows a query and block; the window merges them.
    """
    if engine == "columns":
        pairs = _every_pair(vectors, queries)
        pairs = pairs.where("id != qid") if exclude_self else pairs
        return top_n(pairs.select("qid", "id", distance(F.col("qvec"), F.col("vec")).alias("dist")), n)

    def work(q_ids, q, ids, x):
        for i, places, dist in nearest(q, ids, x, n, q_ids if exclude_self else None):
            for p, d in zip(places.tolist(), dist.tolist()):
                yield int(q_ids[i]), int(ids[p]), d

    found = cells(packed(vectors, "id", "vec"), gathered(queries, "qid", "qvec"), KNN, work)
    return top_n(found, n)


def exact_range(vectors: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """(qid, id, dist) of all vectors within ``radius`` of each query."""

    def work(q_ids, q, ids, x):
        dist = exact_distances(q, x)
        for i, p in zip(*np.nonzero(dist <= radius)):
            yield int(q_ids[i]), int(ids[p]), float(dist[i, p])

    return cells(packed(vectors, "id", "vec"), gathered(queries, "qid", "qvec"), KNN, work)


def nearest_allowed(n: int, exclude_self: bool):
    """Work on blocks and the pairs ``allowed`` in them: n rows a query."""

    def work(q_ids, q, ids, x, allowed):
        for i, places, dist in nearest(q, ids, x, n, q_ids if exclude_self else None, allowed):
            yield from zip([int(q_ids[i])] * len(places), ids[places].tolist(), dist.tolist())

    return work


def within_allowed(radius: float, exclude_self: bool):
    """Work on blocks and the pairs ``allowed`` in them: those within the radius."""

    def work(q_ids, q, ids, x, allowed):
        if exclude_self:
            allowed = allowed & (q_ids[:, None] != ids[None, :])
        r, c = np.nonzero(allowed & (paired_distances(q, x) <= radius * (1 + 1e-9) + 1e-12))
        dist = np.sqrt(((q[r] - x[c]) ** 2).sum(axis=1))
        near = dist <= radius
        yield from zip(q_ids[r[near]].tolist(), ids[c[near]].tolist(), dist[near].tolist())

    return work


def _every_pair(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(id, vec, qid, qvec) of every vector and query. A small query side is broadcast; a larger one
    meets the vectors on the lanes of a grid."""
    asked = queries.select("qid", "qvec")
    if is_small(asked):
        return vectors.select("id", "vec").crossJoin(F.broadcast(asked))
    x, y = grid(-(-vectors.count() // BLOCK), -(-queries.count() // BLOCK))
    held = vectors.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(x)).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(y - 1))).cast("long").alias("y"))
    sent = asked.select("qid", "qvec", F.pmod(F.xxhash64("qid"), F.lit(y)).alias("y"), F.explode(F.sequence(F.lit(0), F.lit(x - 1))).cast("long").alias("x"))
    return held.join(sent, ["x", "y"]).drop("x", "y")


def distance_table(vectors: DataFrame, queries: DataFrame, digits: int | None = None) -> DataFrame:
    """(qid, id, l2, l2sq, dot) of every query and vector, rounded to ``digits`` where they are taken. The output has a row a pair; a task
    holds two blocks and hands on some 8,192 rows at once. Where the tasks of the input would hand on more than TASK_ROWS
    each, the blocks of vectors are dealt to more tasks, so a lost task leaves little behind and repeats little."""

    def shown(values):
        if digits is None:
            return values
        return np.copysign(np.floor(np.abs(values) * 10.0 ** digits + 0.5) / 10.0 ** digits, values) + 0.0

    def work(q_ids, q, ids, x):
        few = max(1, 8192 // len(ids))
        for at in range(0, len(q), few):
            rows = q[at:at + few]
            square = np.stack([((x - row) ** 2).sum(axis=1) for row in rows]).ravel()
            yield np.repeat(q_ids[at:at + few], len(ids)), np.tile(ids, len(rows)), shown(np.sqrt(square)), shown(square), shown((rows @ x.T).ravel())

    blocks, at_once = packed(vectors, "id", "vec"), vectors.sparkSession.sparkContext.defaultParallelism
    rounds = -(-vectors.count() * queries.count() // (TASK_ROWS * at_once))
    if rounds > 1:
        blocks = blocks.repartition(rounds * at_once)
    return cells(blocks, gathered(queries, "qid", "qvec"), "qid long, id long, l2 double, l2sq double, dot double", work, arrays=True)


def eps_nearest(vectors: DataFrame, queries: DataFrame, found: DataFrame, epsilon: float = 0.1) -> DataFrame:
    """(qid, id): the best candidate of ``found`` (qid, id, dist), then replaced, in id order over
    all vectors, by each one nearer than the current by a factor of 1 + epsilon; -1 for a query
    without candidates.

    A vector that replaces is nearer than every earlier one, so a block of vectors hands on its
    running minima only, and the fold runs over those few.
    """
    seeds = top_n(found, 1).select("qid", F.col("id").alias("seed"), F.col("dist").alias("seed_dist"))
    start = queries.select("qid", "qvec").join(seeds, "qid")

    def work(q_ids, q, ids, x):
        for i, dist in enumerate(exact_distances(q, x)):
            low = np.minimum.accumulate(dist)
            record = np.concatenate(([True], dist[1:] < low[:-1]))
            for p in np.flatnonzero(record).tolist():
                yield int(q_ids[i]), int(ids[p]), float(dist[p])

    lows = cells(packed(vectors, "id", "vec"), gathered(start, "qid", "qvec"), KNN, work)
    listed = lows.join(seeds, "qid").where(F.col("dist") < F.col("seed_dist") / (1 + epsilon))
    listed = listed.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("id", "dist"))).alias("steps"))
    first = F.struct(F.col("seed").alias("id"), F.col("seed_dist").alias("dist"))
    nothing = F.array().cast("array<struct<id:long,dist:double>>")
    folded = F.aggregate(F.coalesce("steps", nothing), first, lambda best, x: F.when(x["dist"] < best["dist"] / F.lit(1 + epsilon), x).otherwise(best))
    chosen = seeds.join(listed, "qid", "left").select("qid", folded["id"].alias("id"))
    return queries.select("qid").join(chosen, "qid", "left").select("qid", F.coalesce("id", F.lit(-1).cast("long")).alias("id"))

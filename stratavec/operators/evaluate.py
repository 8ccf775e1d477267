"""Evaluation of approximate answers against exact ones."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vec import l2
from ..plans.session import materialised
from ..plans.sizes import broadcast_if_small
from .base import Index
from .search import exact_knn


def with_true_distance(found: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``found`` (qid, rank, id, dist) with true_dist, the exact distance of each hit."""
    hits = found.join(broadcast_if_small(queries.select("qid", "qvec")), "qid")
    both = vectors.select("id", "vec").join(broadcast_if_small(hits), "id")
    return both.select("qid", "rank", "id", "dist", l2(F.col("qvec"), F.col("vec")).alias("true_dist"))


def per_query(found: DataFrame, truth: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(qid, af, recall, hits): af is null for a query without an answer or with a true distance of
    at most 1e-12; every query has a row. Both answers, n rows a query, are written, as each is read more than once."""
    found, truth = materialised(found.select("qid", "rank", "id", "dist"), "found"), materialised(truth.select("qid", "rank", "id", "dist"), "truth")
    best = found.where("rank = 1").select("qid", F.col("dist").alias("got"))
    true_best = truth.where("rank = 1").select("qid", F.col("dist").alias("true"))
    size = truth.groupBy("qid").agg(F.least(F.lit(n), F.count(F.lit(1))).alias("size"))
    hits = found.select("qid", "id").join(truth.select("qid", "id"), ["qid", "id"]).groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    rows = queries.select("qid").join(best, "qid", "left").join(true_best, "qid", "left").join(size, "qid", "left").join(hits, "qid", "left")
    return rows.select(
        "qid",
        F.when(F.col("true") > 1e-12, F.col("got") / F.col("true")).alias("af"),
        F.when(F.coalesce("size", F.lit(0)) > 0, F.coalesce("hits", F.lit(0)) / F.col("size")).otherwise(0.0).alias("recall"),
        F.coalesce("hits", F.lit(0)).alias("hits"),
    )


def quality(per: DataFrame) -> DataFrame:
    """One row: avg_af counts a missing answer as 0; af_found is over the answered queries only."""
    return per.agg(
        F.coalesce(F.avg(F.coalesce("af", F.lit(0.0))), F.lit(0.0)).alias("avg_af"),
        F.avg("af").alias("af_found"),
        F.count("af").alias("n_found"),
        F.coalesce(F.avg("recall"), F.lit(0.0)).alias("recall_at_n"),
    )


@dataclass
class Run:
    """What run_queries returns: the answers, and one row of measures."""

    knn: DataFrame
    ranges: DataFrame | None
    metrics: DataFrame


def run_queries(index: Index, vectors: DataFrame, queries: DataFrame, n: int = 1, radius: float | None = None, method: str = "", dataset: str = "", exclude_self: bool = False, **options) -> Run:
    """Ground truth once, then the index's answers, their measures and times; ``options`` go to the
    search for neighbours.

    Times are of whole batches divided by the number of queries: a single query's latency in Spark
    is a job's. qps covers the neighbours and the range search, not the ground truth or the build.
    """
    spark = vectors.sparkSession
    count = max(1, queries.count())
    began = time.perf_counter()
    truth = exact_knn(vectors, queries, n, exclude_self).persist()
    truth.count()
    true_s = time.perf_counter() - began
    began = time.perf_counter()
    found = index.knn_query(queries, n, exclude_self, **options).persist()
    found.count()
    approx_s = time.perf_counter() - began
    ranges = None
    if radius is not None:
        ranges = index.range_search(queries, radius, exclude_self).persist()
        ranges.count()
    total_s = time.perf_counter() - began
    q = quality(per_query(found, truth, queries, n)).first()
    metrics = spark.createDataFrame(
        [(method, dataset, radius is not None, q["avg_af"], q["af_found"], q["n_found"], q["recall_at_n"], count / total_s, 1000 * approx_s / count, 1000 * true_s / count)],
        "method string, dataset string, range_search boolean, avg_af double, af_found double, n_found long, recall_at_n double, qps double, t_approx_ms double, t_true_ms double",
    )
    return Run(found, ranges, metrics)

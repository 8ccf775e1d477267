"""Inverted files: rows are listed under their nearest centre, and a query reads the lists of its
``nprobe`` nearest centres (an equi-join on the list; of a stored index only those lists' folders are read)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import cells, map_matrix, packed_by
from ..functions.kernels import assign, exact_distances, nearest
from ..functions.vec import l2
from ..plans.params import IvfParams, KMeansParams
from ..plans.sizes import broadcast_if_small
from .base import Index
from .kmeans import SAMPLE_ROWS, KMeans, assigned, fit_all, sampled, spark_centres
from .search import KNN, top_n
from .silhouette import Silhouette


def sweep(vectors: DataFrame, ks: list[int], params: KMeansParams, local_rows: int = 0) -> list[tuple[int, float]]:
    """(k, mean silhouette) of a clustering for each k. Rows are labelled for all k at once, and one pass over
    their distances scores all clusterings. ``local_rows`` is that of ``KMeans``, for samples of bounded size."""
    by = [means.labelling_centres() for means in fit_all(vectors, ks, params, local_rows)]

    def work(columns, x):
        return {**columns, "cids": np.stack([assign(x, centres)[0] for centres in by], axis=1).tolist()}

    if not ks:
        return []
    typed = f"id long, vec {vectors.schema['vec'].dataType.simpleString()}, cids array<int>"
    labelled = map_matrix(vectors.select(F.col("id").cast("long").alias("id"), "vec"), "vec", typed, work)
    scores = {r["which"]: r["silhouette"] for r in Silhouette().compute_all(labelled, len(ks)).collect()}  # a row a k
    return [(k, scores.get(i, 0.0)) for i, k in enumerate(ks)]


def choose_k(vectors: DataFrame, params: IvfParams) -> int:
    """The k from 2 to min(10, floor(sqrt(n))) with the best silhouette, the smallest of equals; 2
    where there is none to try."""
    n = vectors.count()
    ks = list(range(2, min(10, math.isqrt(n)) + 1))
    scores = sweep(vectors, ks, KMeansParams(2, params.max_iters, params.tol, seed=params.seed, empty=params.empty))
    return max(scores, key=lambda s: (s[1], -s[0]))[0] if scores else 2


class CoarseQuantizer:
    """Centres from a seeded subset of max(k, floor(sqrt(n))) rows; lists of all rows."""

    def __init__(self, params: IvfParams):
        self.params = params
        self.centres: np.ndarray | None = None

    def train(self, vectors: DataFrame) -> None:
        p = self.params
        n = vectors.count()
        if not n:
            self.centres = np.zeros((0, 0))
            return
        k = p.clusters if p.clusters > 0 else choose_k(vectors, p)
        if k > n:
            raise ValueError(f"{k} clusters need at least as many rows; there are {n}")
        means = KMeans(KMeansParams(k, p.max_iters, p.tol, seed=p.seed, empty=p.empty), SAMPLE_ROWS)
        means.fit(sampled(vectors, max(k, math.isqrt(n)), p.seed))
        self.centres = means.centroids()

    def lists(self, vectors: DataFrame) -> DataFrame:
        """(cid, id, vec)"""
        if not len(self.centres):
            return vectors.select(F.lit(0).alias("cid"), "id", "vec")
        return assigned(vectors, self.centres).select("cid", "id", "vec")

    def probes(self, queries: DataFrame) -> DataFrame:
        """(qid, qvec, cid): the nprobe nearest centres by (distance to nine digits, cid)."""
        centres, nprobe = self.centres, self.params.nprobe
        if not len(centres):
            return queries.select("qid", "qvec", F.lit(0).alias("cid")).limit(0)

        def work(columns, x):
            d = np.round(exact_distances(x, centres), 9)
            return {**columns, "cids": np.argsort(d, axis=1, kind="stable")[:, :nprobe].tolist()}

        typed = f"qid long, qvec {queries.schema['qvec'].dataType.simpleString()}, cids array<int>"
        near = map_matrix(queries.select(F.col("qid").cast("long").alias("qid"), "qvec"), "qvec", typed, work)
        return near.select("qid", "qvec", F.explode("cids").alias("cid"))


class IVFFlat(Index):
    def __init__(self, params: IvfParams = IvfParams()):
        self.params = params
        self.rows: DataFrame | None = None

    def build_index(self, vectors: DataFrame) -> "IVFFlat":
        self.vectors = vectors
        self.coarse = CoarseQuantizer(self.params)
        self.coarse.train(vectors)
        self.rows = self.coarse.lists(vectors)
        return self

    @property
    def nlist(self) -> int:
        return len(self.coarse.centres)

    @property
    def nprobe(self) -> int:
        return self.params.nprobe

    def centroids(self) -> DataFrame:
        """(cid, c)"""
        return spark_centres(self.vectors.sparkSession, self.coarse.centres)

    def candidates(self, queries: DataFrame) -> DataFrame:
        probes = self.coarse.probes(queries).select("qid", "cid")
        return self.named(probes).join(broadcast_if_small(probes), "cid").select("qid", "id", "vec")

    def _cells(self, queries: DataFrame, work) -> DataFrame:
        """Blocks of lists against blocks of the queries that read them. A row is in one list, so no
        pair repeats."""
        probes = self.coarse.probes(queries)
        return cells(packed_by(self.named(probes), "id", "vec", "cid"), packed_by(probes, "qid", "qvec", "cid"), KNN, work, "cid")

    def measured(self, queries: DataFrame, exclude_self: bool = False) -> DataFrame:
        if self.distance is not l2:
            return super().measured(queries, exclude_self)

        def work(q_ids, q, ids, x):
            for i, dist in zip(q_ids.tolist(), exact_distances(q, x).tolist()):
                for j, d in zip(ids.tolist(), dist):
                    if not exclude_self or i != j:
                        yield i, j, d

        return self._cells(queries, work)

    def knn_query(self, queries: DataFrame, n: int, exclude_self: bool = False) -> DataFrame:
        """(qid, rank, id, dist); a list hands on n rows a query and block."""
        if self.distance is not l2:
            return super().knn_query(queries, n, exclude_self)

        def work(q_ids, q, ids, x):
            for i, places, dist in nearest(q, ids, x, n, q_ids if exclude_self else None):
                yield from zip([int(q_ids[i])] * len(places), ids[places].tolist(), dist.tolist())

        return top_n(self._cells(queries, work), n)

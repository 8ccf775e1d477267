"""Exact search that leaves lists out by the triangle inequality.

Rows lie in lists by their nearest centre, each cut by a k-d tree of sampled rows into lists of about LIST_ROWS rows, so that
a query reads as many rows in a large table as in a small one. A list has a covering radius: no row of it is nearer to a query than
the query's distance from the centre less that radius. A search asks each query's own list first, which gives a
distance that the n-th neighbour does not exceed, and then only those lists whose bound does not exceed it. Within
a list the same test is made for each block of rows, whose own centre and radius are tighter. The answer is
that of the exhaustive scan. What the driver and the tasks hold is one centre and radius a list.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import cells, map_matrix, packed_by
from ..functions.kernels import assign, exact_distances, nearest
from ..plans.params import IvfParams
from ..plans.session import materialised
from .ivf import CoarseQuantizer
from .kmeans import sampled
from .search import KNN, top_n

#: Room for rounding in the comparison of bounds; distances are ranked at nine digits.
SLACK = 1e-8
#: Rows of a list, about; lists at most about; sampled rows a list, by which lists are cut.
LIST_ROWS = 4096
MAX_LISTS = 4096
LIST_SAMPLE = 8


def _cut(x: np.ndarray, leaves: list[np.ndarray]):
    """A k-d tree over x down to LIST_SAMPLE rows: (axis, value, low, high), or the number of a leaf, whose centre goes to ``leaves``."""
    axis = int((x.max(axis=0) - x.min(axis=0)).argmax()) if len(x) else 0
    if len(x) <= LIST_SAMPLE or x[:, axis].min() == x[:, axis].max():
        leaves.append(x.mean(axis=0))
        return len(leaves) - 1
    value = np.sort(x[:, axis])[(len(x) - 1) // 2]
    if value == x[:, axis].max():
        value = x[x[:, axis] < value, axis].max()
    low = x[:, axis] <= value
    return axis, float(value), _cut(x[low], leaves), _cut(x[~low], leaves)


def _placed(tree, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
    """Leaf numbers of the given rows of x."""
    if not len(rows):
        return
    if isinstance(tree, int):
        out[rows] = tree
        return
    axis, value, low, high = tree
    below = x[rows, axis] <= value
    _placed(low, x, rows[below], out)
    _placed(high, x, rows[~below], out)


class BoundedSearch:
    """Lists of (id, vec) with their covering radii."""

    def __init__(self, params: IvfParams = IvfParams(nprobe=1)):
        self.params = params

    def build_index(self, vectors: DataFrame) -> "BoundedSearch":
        self.vectors = vectors
        self.coarse = CoarseQuantizer(self.params)
        self.coarse.train(vectors)
        self.centres, trees = self._trees(vectors)
        self.radii, self.sizes = np.zeros(len(self.centres)), np.zeros(len(self.centres), dtype=np.int64)
        if len(self.radii):
            shared = vectors.sparkSession.sparkContext.broadcast((self.coarse.centres, self.centres, trees))

            def work(columns, x):
                coarse, centres, by = shared.value
                label, leaf = assign(x, coarse)[0], np.zeros(len(x), dtype=np.int64)
                for c in np.unique(label).tolist():
                    _placed(by[c], x, np.flatnonzero(label == c), leaf)
                return {**columns, "cid": leaf, "d2": ((x - centres[leaf]) ** 2).sum(axis=1)}

            typed = f"id long, vec {vectors.schema['vec'].dataType.simpleString()}, cid int, d2 double"
            near = map_matrix(vectors.select(F.col("id").cast("long").alias("id"), "vec"), "vec", typed, work)
            self.rows = materialised(near.repartitionByRange("cid").sortWithinPartitions("cid"), "bounded")
            for r in self.rows.groupBy("cid").agg(F.max("d2").alias("far"), F.count(F.lit(1)).alias("n")).collect():  # a row a list
                self.radii[r["cid"]], self.sizes[r["cid"]] = np.sqrt(r["far"]), r["n"]
        return self

    def _trees(self, vectors: DataFrame) -> tuple[np.ndarray, list]:
        """The lists' centres, and the tree by which each centre's rows go to lists, of a bounded sample."""
        coarse, leaves = self.coarse.centres, []
        if not len(coarse):
            return coarse, []
        wanted = min(MAX_LISTS, -(-vectors.count() // LIST_ROWS))
        rows = sampled(vectors, LIST_SAMPLE * wanted, self.params.seed).select(F.col("vec").cast("array<double>").alias("vec")).collect() if wanted > len(coarse) else []
        x = np.array([r["vec"] for r in rows]).reshape(len(rows), coarse.shape[1])
        label = assign(x, coarse)[0]
        trees = []
        for c, centre in enumerate(coarse):
            mine = x[label == c]
            trees.append(_cut(mine if len(mine) > LIST_SAMPLE else centre[None], leaves))
        return np.array(leaves), trees

    def _own(self, queries: DataFrame) -> DataFrame:
        """(qid, qvec, cid): each query with the list that it lies in."""
        return self._probes(queries.select("qid", F.concat(F.array(F.lit(float("inf"))), F.col("qvec").cast("array<double>")).alias("qvec")), True)

    def _probes(self, limited: DataFrame, own: bool) -> DataFrame:
        """(qid, qvec, cid) of queries whose first component is what the n-th neighbour does not exceed: their own
        list, or all others that may hold a nearer row."""
        centres, radii, sizes = self.centres, self.radii, self.sizes

        def work(columns, x):
            d = np.where(sizes > 0, exact_distances(x[:, 1:], centres), np.inf)
            home = d.argmin(axis=1)
            if own:
                return {**columns, "cids": home[:, None].tolist()}
            reach = (d - radii <= x[:, :1] + SLACK * (1 + d)) & (sizes > 0)
            reach[np.arange(len(x)), home] = False
            return {**columns, "cids": [np.flatnonzero(r).tolist() for r in reach]}

        found = map_matrix(limited.select(F.col("qid").cast("long").alias("qid"), "qvec"), "qvec", "qid long, qvec array<double>, cids array<int>", work)
        return found.select("qid", "qvec", F.explode("cids").alias("cid"))

    def _search(self, probes: DataFrame, n: int, exclude_self: bool) -> DataFrame:
        def work(q_ids, q, ids, x):
            limit, q = q[:, 0], q[:, 1:]
            x = x[:, 1:]
            centre = x.mean(axis=0)
            radius = exact_distances(centre[None], x).max()
            to_centre = exact_distances(centre[None], q)[0]
            alive = np.flatnonzero(to_centre - radius <= limit + SLACK * (1 + to_centre))
            for i, places, dist in nearest(q[alive], ids, x, n, q_ids[alive] if exclude_self else None):
                yield from zip([int(q_ids[alive[i]])] * len(places), ids[places].tolist(), dist.tolist())

        # Both sides have a leading component, the queries' limits.
        held = self.rows.select("cid", "id", F.concat(F.array(F.lit(0.0)), F.col("vec").cast("array<double>")).alias("vec"))
        # Written, as cells() counts them before it searches.
        asked = materialised(probes.repartition("cid").sortWithinPartitions("cid", "qid"), "bounded-asked")
        return cells(packed_by(held, "id", "vec", "cid"), packed_by(asked, "qid", "qvec", "cid"), KNN, work, "cid")

    def _limited(self, queries: DataFrame, first: DataFrame, n: int) -> DataFrame:
        """Queries with the distance of their n-th neighbour so far as first component."""
        kth = top_n(first, n).groupBy("qid").agg(F.max("dist").alias("dist"), F.count(F.lit(1)).alias("found"))
        limit = F.when(F.col("found") == n, F.col("dist")).otherwise(float("inf"))
        return queries.select("qid", "qvec").join(kth, "qid", "left").select("qid", F.concat(F.array(limit), F.col("qvec").cast("array<double>")).alias("qvec"))

    def knn_query(self, queries: DataFrame, n: int, exclude_self: bool = False) -> DataFrame:
        """(qid, rank, id, dist): the n nearest of all rows, as the exhaustive scan gives them. Query ids must differ."""
        if not len(self.radii):
            return queries.select(F.col("qid").cast("long").alias("qid"), F.lit(1).cast("long").alias("rank"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("dist")).limit(0)
        first = materialised(self._search(self._own(queries), n, exclude_self), "bounded-first")
        more = self._search(self._probes(self._limited(queries, first, n), False), n, exclude_self)
        return top_n(first.unionByName(more), n)

    def share_read(self, queries: DataFrame, n: int, exclude_self: bool = False) -> float:
        """Of all pairs of a query and a row, the share in lists that the search reads."""
        first = materialised(self._search(self._own(queries), n, exclude_self), "bounded-first")
        both = self._own(queries).select("cid").unionByName(self._probes(self._limited(queries, first, n), False).select("cid"))
        read = sum(r["n"] * int(self.sizes[r["cid"]]) for r in both.groupBy("cid").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a list
        return read / max(1, queries.count() * int(self.sizes.sum()))

"""Random-projection cube: rows sit on vertices, and a query probes vertices in the order of a
breadth-first walk from its own. Probing is an equi-join on generated vertices."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import cells, gathered, map_matrix, packed
from ..functions.hashing import sign_bits, twister_bits, vertex
from ..functions.vec import floor_hash, l2
from ..plans.draws import CubeDraws, cube_draws, probe_masks
from ..plans.params import CubeParams
from ..plans.session import materialised
from ..plans.sizes import broadcast_if_small
from .base import Index, dimension
from .lsh import COMMON, literal
from .search import KNN, nearest_allowed, top_n, within_allowed

#: Vertices of more bits do not travel as components of vectors.
EXACT_BITS = 52


class Hypercube(Index):
    def __init__(self, dim: int | None = None, params: CubeParams = CubeParams()):
        self.dim, self.params = dim, params
        self.rows: DataFrame | None = None

    @property
    def draws(self) -> CubeDraws:
        return cube_draws(self.dim, self.params)

    def placed(self, rows: DataFrame, id_col: str, vec_col: str, engine: str = "arrow") -> DataFrame:
        """``rows`` with column vertex."""
        p, d = self.params, self.draws
        if p.bits == "twister":
            # The bits are NumPy work whatever the engine.
            directions, offsets = np.array(d.directions), np.array(d.offsets)

            def placed(columns, x):
                bits = twister_bits(np.floor((x @ directions.T + offsets) / p.width).astype(np.int64), p.seed)
                return {**columns, "vertex": bits @ (np.int64(1) << np.arange(p.projections, dtype=np.int64))}

            typed = f"{id_col} long, {vec_col} {rows.schema[vec_col].dataType.simpleString()}, vertex long"
            return map_matrix(rows.select(F.col(id_col).cast("long").alias(id_col), vec_col), vec_col, typed, placed)
        if engine == "columns":
            hashed = rows.select(id_col, vec_col, F.array(*[floor_hash(F.col(vec_col), literal(v), F.lit(t), p.width) for v, t in zip(d.directions, d.offsets)]).alias("h"))
        else:
            directions, offsets = np.array(d.directions), np.array(d.offsets)

            def work(columns, x):
                return {**columns, "h": np.floor((x @ directions.T + offsets) / p.width).astype(np.int64).tolist()}

            typed = f"{id_col} long, {vec_col} {rows.schema[vec_col].dataType.simpleString()}, h array<long>"
            hashed = map_matrix(rows.select(F.col(id_col).cast("long").alias(id_col), vec_col), vec_col, typed, work)
        at = vertex(sign_bits(F.col("h"), literal(d.factors), literal(d.shifts)))
        return hashed.select(id_col, vec_col, at.alias("vertex"))

    def build_index(self, vectors: DataFrame, engine: str = "arrow") -> "Hypercube":
        """One row per vector: id, vec, vertex; to be clustered by vertex on disk."""
        self.dim = self.dim or dimension(vectors)
        self.vectors, self.engine = vectors, engine
        self.rows = self.placed(vectors, "id", "vec", engine) if self.dim else vectors.withColumn("vertex", F.lit(0).cast("long"))
        return self

    def fill(self) -> DataFrame:
        """(vertex, n): the number of rows on each vertex that has any."""
        return self.rows.groupBy("vertex").agg(F.count(F.lit(1)).alias("n")) if self.stored is None else self.stored.fill()

    def probes(self, queries: DataFrame) -> DataFrame:
        """(qid, probe_no, vertex) that each query visits: at most ``max_probes`` vertices, and none
        once the vertices before it hold ``max_candidates`` rows (so the last one may overshoot)."""
        p = self.params
        masks = literal(probe_masks(p.projections, p.max_probes))
        own = self.placed(queries.select("qid", "qvec"), "qid", "qvec", self.engine)
        steps = own.select("qid", F.col("vertex").alias("own"), F.posexplode(masks).alias("probe_no", "mask"))
        steps = steps.select("qid", "probe_no", F.col("own").bitwiseXOR(F.col("mask").cast("long")).alias("vertex"))
        before = Window.partitionBy("qid").orderBy("probe_no").rowsBetween(Window.unboundedPreceding, -1)
        counted = steps.join(self.fill(), "vertex", "left").withColumn("seen", F.coalesce(F.sum("n").over(before), F.lit(0)))
        return counted.where(F.col("seen") < p.max_candidates).select("qid", "probe_no", "vertex")

    def candidates(self, queries: DataFrame) -> DataFrame:
        if not self.dim:
            return queries.select("qid").limit(0).crossJoin(self.vectors.select("id", "vec"))
        probes = self.probes(queries).select("qid", "vertex")
        probes = probes if self.stored is None else materialised(probes, "cube-probes")
        return self.named(probes).join(broadcast_if_small(probes), "vertex").select("qid", "id", "vec")

    def _visited(self, queries: DataFrame) -> DataFrame | None:
        """(qid, own, visits) where pairs of a query and a row on a vertex that it visits are more than COMMON of all pairs: the visits
        are the first of the walk from its own vertex. None elsewhere."""
        if not self.dim or self.distance is not l2 or self.params.projections > EXACT_BITS:
            return None
        probes = materialised(self.probes(queries), "cube-probes")
        met = self.fill().join(probes.groupBy("vertex").agg(F.count(F.lit(1)).alias("q_n")), "vertex").agg(F.coalesce(F.sum(F.col("n") * F.col("q_n")), F.lit(0))).first()[0]
        if met <= COMMON * queries.count() * self.vectors.count():
            return None
        return probes.groupBy("qid").agg(F.min_by("vertex", "probe_no").alias("own"), F.count(F.lit(1)).alias("visits"), F.collect_list("vertex").alias("vertices"))

    def _blocks(self, queries: DataFrame, visited: DataFrame, work) -> DataFrame:
        """``work(q_ids, q, ids, x, allowed)`` over blocks of queries and of vectors, ``allowed`` telling which rows lie on vertices that a
        query visits. A row is on one vertex, so no pair repeats, and none leaves a task but what ``work`` takes."""
        masks = np.array(probe_masks(self.params.projections, self.params.max_probes), dtype=np.int64)

        def pair(q_ids, q, ids, x):
            vertices, at = np.unique(x[:, 0].astype(np.int64), return_inverse=True)
            walk = q[:, :1].astype(np.int64) ^ masks
            place = np.minimum(np.searchsorted(vertices, walk), len(vertices) - 1)
            r, c = np.nonzero((vertices[place] == walk) & (np.arange(len(masks)) < q[:, 1:2]))
            on = np.zeros((len(q), len(vertices)), dtype=bool)
            on[r, place[r, c]] = True
            if len(r):
                yield from work(q_ids, q[:, 2:], ids, x[:, 2:], on[:, at])

        held = self.rows if self.stored is None else self.named(visited.select(F.explode("vertices").alias("vertex")))
        asked = queries.select("qid", "qvec").join(broadcast_if_small(visited.drop("vertices")), "qid")
        # Vertex and visits travel as leading components of the vectors.
        marked = [t.select(i, F.concat(F.array(F.col(a).cast("double"), b), F.col(v).cast("array<double>")).alias("vec"))
                  for t, i, v, a, b in ((held, "id", "vec", "vertex", F.lit(0.0)), (asked, "qid", "qvec", "own", F.col("visits").cast("double")))]
        return cells(packed(marked[0], "id", "vec"), gathered(marked[1], "qid", "vec"), KNN, pair)

    def knn_query(self, queries: DataFrame, n: int, exclude_self: bool = False) -> DataFrame:
        """(qid, rank, id, dist). Where queries visit many rows, a block hands on n rows a query."""
        visited = self._visited(queries)
        return super().knn_query(queries, n, exclude_self) if visited is None else top_n(self._blocks(queries, visited, nearest_allowed(n, exclude_self)), n)

    def range_search(self, queries: DataFrame, radius: float, exclude_self: bool = False) -> DataFrame:
        visited = self._visited(queries)
        return super().range_search(queries, radius, exclude_self) if visited is None else self._blocks(queries, visited, within_allowed(radius, exclude_self))

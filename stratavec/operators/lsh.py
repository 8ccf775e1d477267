"""Locality-sensitive hashing: the index is a table, probing is an equi-join on (table, identifier)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import cells, gathered, map_matrix, packed
from ..functions.hashing import bucket, composite
from ..functions.vec import floor_hash, l2
from ..plans.draws import LshDraws, lsh_draws
from ..plans.params import LshParams
from ..plans.session import materialised
from ..plans.sizes import broadcast_if_small, is_small
from .base import Index, dimension
from .search import KNN, nearest_allowed, top_n, within_allowed

#: Candidate pairs beyond this share of all pairs are found block by block.
COMMON = 1 / 32


def literal(values) -> Column:
    """A nested list of numbers as a constant column."""
    return F.array(*[literal(v) for v in values]) if isinstance(values, list) else F.lit(values)


class LSH(Index):
    """``tables`` hash tables of ``hashes`` p-stable hashes each. A row's key in a table is its whole
    composite identifier; the slot ``bucket`` of the hash table never changes an answer."""

    def __init__(self, dim: int | None = None, params: LshParams = LshParams()):
        self.dim, self.params = dim, params
        self.rows: DataFrame | None = None
        self.count = 0

    @property
    def draws(self) -> LshDraws:
        return lsh_draws(self.dim, self.params)

    def hashes(self, rows: DataFrame, id_col: str, vec_col: str, engine: str = "arrow") -> DataFrame:
        """``rows`` with column hashes: for each table the array of its integer hashes."""
        p, d = self.params, self.draws
        if engine == "columns":
            per_table = [F.array(*[floor_hash(F.col(vec_col), literal(v), F.lit(t), p.width) for v, t in zip(vs, ts)]) for vs, ts in zip(d.directions, d.offsets)]
            return rows.select(id_col, vec_col, F.array(*per_table).alias("hashes"))
        directions = np.array(d.directions).reshape(-1, self.dim)
        offsets = np.array(d.offsets).reshape(-1)
        shape = (p.tables, p.hashes)

        def work(columns, x):
            h = np.floor((x @ directions.T + offsets) / p.width).astype(np.int64).reshape(len(x), *shape)
            return {**columns, "hashes": h.tolist()}

        typed = f"{id_col} long, {vec_col} {rows.schema[vec_col].dataType.simpleString()}, hashes array<array<long>>"
        return map_matrix(rows.select(F.col(id_col).cast("long").alias(id_col), vec_col), vec_col, typed, work)

    def identified(self, rows: DataFrame, id_col: str, vec_col: str, engine: str = "arrow") -> DataFrame:
        """``rows`` with column hids: the composite identifier in each table."""
        weights = literal(self.draws.weights)
        with_hashes = self.hashes(rows, id_col, vec_col, engine)
        pairs = F.arrays_zip(F.col("hashes").alias("h"), weights.alias("r"))
        return with_hashes.select(id_col, vec_col, F.transform(pairs, lambda x: composite(x["h"], x["r"])).alias("hids"))

    def build_index(self, vectors: DataFrame, engine: str = "arrow") -> "LSH":
        """One row per vector: id, vec, hids. Nothing is shuffled; persist or write it to reuse it."""
        self.dim = self.dim or dimension(vectors)
        self.engine = engine
        self.vectors = vectors
        self.rows = self.identified(vectors, "id", "vec", engine) if self.dim else vectors.withColumn("hids", F.array().cast("array<long>"))
        return self

    def entries(self) -> DataFrame:
        """(tbl, hid, id), the index in long form, as it lies on disk."""
        if self.stored is not None:
            return self.rows
        return self.rows.select(F.posexplode("hids").alias("tbl", "hid"), "id").select("tbl", "hid", "id")

    def buckets(self) -> DataFrame:
        """(tbl, bucket, n): the fill of the hash tables' slots for as many slots as rows / 4."""
        slots = self.rows.count()
        return self.entries().groupBy("tbl", bucket(F.col("hid"), slots).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))

    def query_candidates(self, queries: DataFrame) -> DataFrame:
        """(qid, id) of rows that share an identifier with the query in any table: only identifiers
        are joined."""
        if not self.dim:
            return queries.select("qid").limit(0).crossJoin(self.vectors.select("id"))
        asked = self.identified(queries.select("qid", "qvec"), "qid", "qvec", self.engine)
        probes = asked.select("qid", F.posexplode("hids").alias("tbl", "hid"))
        held = self.entries() if self.stored is None else self.stored.rows_of(probes)
        return held.join(broadcast_if_small(probes), ["tbl", "hid"]).select("qid", "id").distinct()

    def candidates(self, queries: DataFrame) -> DataFrame:
        """(qid, id, vec) of the pairs. Small probes are broadcast to the vectors, which stay where
        they are, and a pair comes once a table; beyond that identifiers meet first, and a vector is
        shuffled once, however many tables find it. Of a stored index the vectors of hits are fetched."""
        if not self.dim:
            return queries.select("qid").limit(0).crossJoin(self.vectors.select("id", "vec"))
        if self.stored is not None:
            pairs = materialised(self.query_candidates(queries), "lsh-pairs")
            return self.stored.rows_of(pairs, "vectors").join(broadcast_if_small(pairs), "id").select("qid", "id", "vec")
        asked = self.identified(queries.select("qid", "qvec"), "qid", "qvec", self.engine)
        probes = asked.select("qid", F.posexplode("hids").alias("tbl", "hid"))
        if is_small(probes):
            entries = self.rows.select("id", "vec", F.posexplode("hids").alias("tbl", "hid"))
            return entries.join(F.broadcast(probes), ["tbl", "hid"]).select("qid", "id", "vec")
        pairs = self.entries().join(probes, ["tbl", "hid"]).select("qid", "id").distinct()
        return pairs.join(self.vectors.select("id", "vec"), "id").select("qid", "id", "vec")

    def _common(self, queries: DataFrame) -> bool:
        """Whether pairs that share an identifier (a pair counts once a table) are more than COMMON of all pairs."""
        asked = self.identified(queries.select("qid", "qvec"), "qid", "qvec", self.engine)
        probes = asked.select(F.posexplode("hids").alias("tbl", "hid")).groupBy("tbl", "hid").agg(F.count(F.lit(1)).alias("q_n"))
        held = (self.entries() if self.stored is None else self.stored.rows_of(probes)).groupBy("tbl", "hid").agg(F.count(F.lit(1)).alias("n"))
        met = held.join(probes, ["tbl", "hid"]).agg(F.coalesce(F.sum(F.col("n") * F.col("q_n")), F.lit(0))).first()[0]
        return met > COMMON * queries.count() * self.vectors.count()

    def _blocks(self, queries: DataFrame, work) -> DataFrame:
        """``work(q_ids, q, ids, x, allowed)`` over blocks of queries and of vectors, ``allowed`` telling which share an
        identifier. A pair comes once, and none leaves a task but what ``work`` takes. Of a stored index the vectors of hits are read."""
        tables = self.params.tables
        asked = self.identified(queries.select("qid", "qvec"), "qid", "qvec", self.engine)
        held = self.rows
        if self.stored is not None:
            probes = asked.select(F.posexplode("hids").alias("tbl", "hid")).distinct()
            hits = materialised(self.stored.rows_of(probes).join(broadcast_if_small(probes), ["tbl", "hid"], "left_semi").select("id").distinct(), "lsh-hits")
            held = self.identified(self.stored.rows_of(hits, "vectors").join(broadcast_if_small(hits), "id", "left_semi"), "id", "vec", self.engine)

        def pair(q_ids, q, ids, x):
            allowed = np.zeros((len(q), len(x)), dtype=bool)
            for t in range(tables):
                allowed |= q[:, t, None] == x[None, :, t]
            if allowed.any():
                yield from work(q_ids, q[:, tables:], ids, x[:, tables:], allowed)

        # Identifiers, below 2^53, travel as leading components of the vectors.
        marked = [t.select(i, F.concat(F.col("hids").cast("array<double>"), F.col(v).cast("array<double>")).alias("vec")) for t, i, v in ((held, "id", "vec"), (asked, "qid", "qvec"))]
        return cells(packed(marked[0], "id", "vec"), gathered(marked[1], "qid", "vec"), KNN, pair)

    def knn_query(self, queries: DataFrame, n: int, exclude_self: bool = False) -> DataFrame:
        """(qid, rank, id, dist). Where many pairs share an identifier, a block hands on n rows a query."""
        if not self.dim or self.distance is not l2 or not self._common(queries):
            return super().knn_query(queries, n, exclude_self)

        return top_n(self._blocks(queries, nearest_allowed(n, exclude_self)), n)

    def range_search(self, queries: DataFrame, radius: float, exclude_self: bool = False) -> DataFrame:
        if not self.dim or self.distance is not l2 or not self._common(queries):
            return super().range_search(queries, radius, exclude_self)

        return self._blocks(queries, within_allowed(radius, exclude_self))

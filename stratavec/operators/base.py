"""What all indexes share: searches over their candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vec import Distance, l2
from .search import eps_nearest, measured, top_n, within


def dimension(vectors: DataFrame) -> int | None:
    """The dimension of the first vector; None for an empty table."""
    row = vectors.select(F.size("vec").alias("dim")).first()
    return None if row is None else row["dim"]


class Index:
    """Subclasses keep ``vectors`` (id, vec) and give ``candidates(queries)`` -> (qid, id, vec), in
    which a pair may repeat."""

    vectors: DataFrame
    distance: Distance = staticmethod(l2)
    measure = "dist"
    #: The tables on disk that a stored index is read from (``sources.indexes.Stored``).
    stored = None

    def candidates(self, queries: DataFrame) -> DataFrame:
        raise NotImplementedError

    def named(self, probes: DataFrame) -> DataFrame:
        """The rows that ``probes`` may name, which a join sorts out: of a stored index those in the folders of
        the probes, of any other all."""
        return self.rows if self.stored is None else self.stored.rows_of(probes)

    def query_candidates(self, queries: DataFrame) -> DataFrame:
        """(qid, id)"""
        return self.candidates(queries).select("qid", "id").distinct()

    def measured(self, queries: DataFrame, exclude_self: bool = False) -> DataFrame:
        """(qid, id, dist) of all candidates; ``exclude_self`` leaves a query's own row out."""
        found = self.candidates(queries)
        return measured(found.where("id != qid") if exclude_self else found, queries, self.distance)

    def knn_query(self, queries: DataFrame, n: int, exclude_self: bool = False) -> DataFrame:
        """(qid, rank, id, dist)"""
        return top_n(self.measured(queries, exclude_self), n)

    def query(self, queries: DataFrame, n: int = 10) -> DataFrame:
        """(qid, rank, id)"""
        return self.knn_query(queries, n).select("qid", "rank", "id")

    def range_search(self, queries: DataFrame, radius: float, exclude_self: bool = False) -> DataFrame:
        """(qid, id, dist)"""
        return within(self.measured(queries, exclude_self), radius)

    def nn_query(self, queries: DataFrame, epsilon: float = 0.1) -> DataFrame:
        """(qid, id): the relaxed nearest neighbour, -1 without candidates."""
        return eps_nearest(self.vectors, queries, self.knn_query(queries, 1).select("qid", "id", "dist"), epsilon)

    def persist(self) -> "Index":
        self.rows = self.rows.persist()
        return self

    def clear_index(self) -> None:
        if getattr(self, "rows", None) is not None:
            self.rows.unpersist()
        self.rows = None

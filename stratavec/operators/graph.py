"""The k-nearest-neighbour graph of a dataset over any index: every row is a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Index


def knn_graph(index: Index, k: int = 4, exclude_self: bool = False) -> DataFrame:
    """(src, rank, dst): a row's own id is among its neighbours unless left out."""
    queries = index.vectors.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    return index.knn_query(queries, k, exclude_self).select(F.col("qid").alias("src"), "rank", F.col("id").alias("dst"))


def graph_lines(edges: DataFrame) -> DataFrame:
    """(line): ``src,dst1,..,dstk`` for each row of the graph."""
    neighbours = F.transform(F.array_sort(F.collect_list(F.struct("rank", "dst"))), lambda e: e["dst"].cast("string"))
    lines = edges.groupBy("src").agg(neighbours.alias("d"))
    return lines.select(F.concat_ws(",", F.col("src").cast("string"), F.col("d")).alias("line"))

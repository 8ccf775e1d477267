"""Queries that arrive as a stream, answered against a built index (an extension: the batch searches
applied to each micro-batch)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.base import Index


def answer_stream(queries: DataFrame, index: Index, n: int, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append (qid, rank, id, dist) for each micro-batch of ``queries`` (qid, qvec) to Parquet at
    ``path``, a folder for each batch, so that a batch that is run again replaces its own answers."""

    def answer(batch: DataFrame, number: int) -> None:
        index.knn_query(batch.select("qid", "qvec"), n).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()

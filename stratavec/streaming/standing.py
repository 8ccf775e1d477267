"""Vectors that arrive as a stream, kept as standing answers: the n nearest so far of each registered query
(an extension).

Each task of a micro-batch packs its arrivals into blocks and hands on n rows a query and block, as the batch
search does; what is shuffled is keyed by query. The state of a query is its list of n neighbours, whatever
has arrived. It lies in Spark's state store under the checkpoint folder, so a stream that is started again goes
on where it stopped.

* Ties in distance (after rounding to nine digits) go to the smaller id, so the answers do not depend on the order of arrival.
* An id that arrives again is the same vector and is counted once. Vectors are not taken back.
* Null vectors, vectors with null components and vectors of another dimension stop the stream with an error.
* A query of which nothing has arrived has no answer rows; an empty stream has none at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.blocks import SMALL_BLOCKS, SMALL_BYTES, gathered, packed, paired
from ..functions.kernels import nearest
from ..operators.search import KNN

ANSWERS = "qid long, rank long, id long, dist double"
HELD = "ids array<long>, dists array<double>"


def arrived(vectors: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """(qid, id, dist): of each block of arriving (id, vec) the n nearest of each query (qid, qvec).

    A small query side is broadcast in blocks. A larger one is dealt out over lanes, and the blocks of
    arrivals, which cannot be counted, are copied to each lane and joined on it.
    """
    asked = gathered(queries, "qid", "qvec")
    number, size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("vectors")), F.lit(0))).first()
    asked = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])
    blocks = packed(vectors, "id", "vec")
    if number <= SMALL_BLOCKS and size <= SMALL_BYTES:
        pairs = blocks.crossJoin(F.broadcast(asked))
    else:
        lanes = max(number // SMALL_BLOCKS, size // SMALL_BYTES) + 1
        copied = blocks.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(int(lanes) - 1))))
        pairs = copied.join(asked.withColumn("lane", F.pmod(F.xxhash64("q_ids"), F.lit(int(lanes))).cast("int")), "lane").drop("lane")

    def work(q_ids, q, ids, x):
        for i, places, dist in nearest(q, ids, x, n):
            yield from zip([int(q_ids[i])] * len(places), ids[places].tolist(), dist.tolist())

    return paired(pairs, KNN, work)


def merged(ids: np.ndarray, dists: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n nearest of rows in which an id may repeat."""
    order = np.lexsort((ids, np.round(dists, 9)))
    order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:n]
    return ids[order], dists[order]


def standing(vectors: DataFrame, queries: DataFrame, n: int) -> DataFrame:
    """A streaming (qid, rank, id, dist): for each query that a micro-batch changed, its whole new list."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [])
        ids, dists = np.array(held[0], dtype=np.int64), np.array(held[1], dtype=np.float64)
        before = ids.tolist()
        for part in parts:
            ids, dists = merged(np.concatenate((ids, part["id"].to_numpy())), np.concatenate((dists, part["dist"].to_numpy())), n)
        if ids.tolist() != before:
            state.update((ids.tolist(), dists.tolist()))
            yield pd.DataFrame({"qid": key[0], "rank": np.arange(1, len(ids) + 1), "id": ids, "dist": dists})

    found = arrived(vectors, queries, n)
    return found.groupBy("qid").applyInPandasWithState(update, ANSWERS, HELD, "update", GroupStateTimeout.NoTimeout)


def keep_standing(vectors: DataFrame, queries: DataFrame, n: int, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Run ``standing`` and write each micro-batch's changed lists to a folder of its own below ``path``, so that
    a batch that is run again replaces what it wrote."""

    def write(changed: DataFrame, number: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = standing(vectors, queries, n).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def current(changes: DataFrame) -> DataFrame:
    """(qid, rank, id, dist): the last list of each query, of what ``keep_standing`` wrote (with column batch)."""
    last = Window.partitionBy("qid")
    return changes.withColumn("last", F.max("batch").over(last)).where("batch = last").select("qid", "rank", "id", "dist")

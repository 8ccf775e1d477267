"""Searches written in SQL: table functions over a stored inverted-file index (an extension).

``register_search(spark, "emb", path)`` makes temporary functions for the session:

* ``emb_lists(asked)``: the lists that a query reads, nearest first, as the index would choose them;
* ``emb_distance(a, b)``: the distance of two vectors;
* ``emb_candidates(list)``: a table function, called LATERAL, of the rows (id, vec) in such a list;
* ``emb_shards(list)``: the number of shards of a list, of about SHARD_ROWS rows each;
* ``emb_blocks(list, shard)``: a table function, called LATERAL, of a shard's rows as one array;
* ``emb_nearest(asked, block, n)``, ``emb_within(asked, block, radius)``: the answers (qid, id, dist) of an array of queries in such a block;

and the view ``emb_rows`` of the live rows. All but the last two are SQL all through. The table functions refer to their caller by the list
and shard alone, so Catalyst turns the lateral call into an equi-join on it (with the query in it, every query would meet
every row first). The n nearest are a window over the answers of blocks, n rows a query and block, of which Spark keeps n rows a query and task before it
shuffles; ``nearest_sql`` and ``within_sql`` write the statements.

The centres are literals of ``emb_lists``, as many as the index has lists, within CENTRE_NUMBERS. A query that is null, or whose
dimension differs, gets null distances, which the statements leave out. An index of an empty table has no lists and gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.ivf import IVFFlat
from ..operators.search import nearest_allowed, within_allowed
from .indexes import read_index

#: Numbers that the centres of a registered index may hold.
CENTRE_NUMBERS = 1_000_000
#: Rows of a shard and queries of an array, about.
SHARD_ROWS = 1024
ASKED_ROWS = 1024
FOUND = "array<struct<qid: bigint, id: bigint, dist: double>>"


def _held(rows) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of an array of (id, vector), without null, other than most long and incomplete vectors."""
    ids, vectors = rows.flatten()
    whole = [v for v in zip(ids.to_pylist(), vectors.to_pylist()) if v[1] is not None and None not in v[1]] if vectors.null_count or vectors.flatten().null_count else None
    if whole is None:
        lengths = np.asarray(vectors.value_lengths())
        if len(lengths) and (lengths == lengths[0]).all():
            return np.asarray(ids, dtype=np.int64), np.asarray(vectors.flatten(), dtype=np.float64).reshape(len(ids), lengths[0])
        whole = list(zip(ids.to_pylist(), vectors.to_pylist()))
    dim = max((sum(len(v) == d for _, v in whole), d) for d in {len(v) for _, v in whole})[1] if whole else 0
    whole = [v for v in whole if len(v[1]) == dim]
    return np.array([v[0] for v in whole], dtype=np.int64), np.array([v[1] for v in whole], dtype=np.float64).reshape(len(whole), dim)


def _answered(work_of):
    """A function over columns of queries, blocks and a number, by which ``work_of`` makes the work on two blocks."""

    def answered(asked: pa.Array, blocks: pa.Array, number: pa.Array) -> pa.Array:
        found, offsets = [[], [], []], [0]
        for i in range(len(asked)):
            (q_ids, q), (ids, x) = _held(asked[i].values), _held(blocks[i].values)
            if len(q) and len(ids) and q.shape[1] == x.shape[1]:
                for row in work_of(number[i].as_py())(q_ids, q, ids, x, np.ones((len(q), len(x)), dtype=bool)):
                    for column, value in zip(found, row):
                        column.append(value)
            offsets.append(len(found[0]))
        rows = pa.StructArray.from_arrays([pa.array(c, type=t) for c, t in zip(found, (pa.int64(), pa.int64(), pa.float64()))], ["qid", "id", "dist"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return answered


def register_search(spark: SparkSession, name: str, path: str) -> None:
    """Register the functions of the IVF-Flat index stored at ``path`` as ``name``_*. Insertions and deletions after
    that are seen when it is registered again."""
    if not name.isidentifier():
        raise ValueError("the name must be an identifier")
    index = read_index(spark, path)
    if not isinstance(index, IVFFlat):
        raise ValueError("searches in SQL need a stored IVF-Flat index")
    centres = index.coarse.centres
    if centres.size > CENTRE_NUMBERS:
        raise ValueError("the centres are too many to be literals of a function")
    # Lists are named by the folder, so that joins on the list prune folders.
    rows = index.stored.table("rows", also=("folder",))
    rows.selectExpr("folder AS cid", "id", "CAST(vec AS array<double>) AS vec").createOrReplaceTempView(f"{name}_rows")
    listed = ", ".join(f"struct({i} AS cid, array({', '.join(f'{float(x)!r}D' for x in c)}) AS c)" for i, c in enumerate(centres))
    some = f"array({listed})" if len(centres) else "cast(array() AS array<struct<cid: int, c: array<double>>>)"
    vector = "ARRAY<DOUBLE>"
    counts = {r["cid"]: r["n"] for r in rows.groupBy(F.col("folder").alias("cid")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a list
    shards = f"element_at(array({', '.join(str(-(-counts.get(i, 1) // SHARD_ROWS)) for i in range(max(1, len(centres))))}), %s + 1)"
    spark.udf.register(f"{name}_nearest", F.arrow_udf(_answered(lambda n: nearest_allowed(n, False)), FOUND))
    spark.udf.register(f"{name}_within", F.arrow_udf(_answered(lambda radius: within_allowed(radius, False)), FOUND))
    spark.sql(f"""SELECT cid, shard, collect_list(struct(id, vec)) AS block FROM (SELECT *, CAST(pmod(xxhash64(id), {shards % 'cid'}) AS INT) AS shard FROM {name}_rows)
        GROUP BY cid, shard""").createOrReplaceTempView(f"{name}_packed")
    for statement in (
        f"{name}_distance(a {vector}, b {vector}) RETURNS DOUBLE RETURN sqrt(aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x))",
        f"""{name}_lists(asked {vector}) RETURNS ARRAY<INT> RETURN transform(slice(array_sort(transform({some},
            p -> struct(round(sqrt(aggregate(zip_with(asked, p.c, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)), 9) AS d, p.cid AS cid))), 1, {index.params.nprobe}), p -> p.cid)""",
        f"{name}_candidates(list INT) RETURNS TABLE (id BIGINT, vec {vector}) RETURN SELECT r.id, r.vec FROM {name}_rows r WHERE r.cid = {name}_candidates.list",
        f"{name}_shards(list INT) RETURNS INT RETURN {shards % f'{name}_shards.list'}",
        f"""{name}_blocks(list INT, shard INT) RETURNS TABLE (block ARRAY<STRUCT<id: BIGINT, vec: {vector}>>)
            RETURN SELECT p.block FROM {name}_packed p WHERE p.cid = {name}_blocks.list AND p.shard = {name}_blocks.shard""",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {statement}")


def _measured(name: str, asked: str, found: str) -> str:
    """(qid, id, dist) that ``found`` gives of arrays of queries and blocks. Queries are copied to the shards of their lists."""
    return f"""SELECT inline({found}) FROM (
    SELECT list, shard, collect_list(struct(qid, qvec)) AS asked FROM (
      SELECT list, qid, qvec, pack, explode(sequence(0, shards - 1)) AS shard FROM (
        SELECT list, qid, qvec, pack, {name}_shards(list) AS shards FROM (SELECT qid, qvec, explode(lists) AS list, pmod(xxhash64(qid), packs) AS pack FROM (
          SELECT CAST(qid AS BIGINT) AS qid, CAST(qvec AS ARRAY<DOUBLE>) AS qvec, {name}_lists(qvec) AS lists, (SELECT CAST(greatest(1, ceil(count(*) / {ASKED_ROWS})) AS INT) FROM {asked}) AS packs FROM {asked} WHERE qvec IS NOT NULL))))
    GROUP BY list, shard, pack) q, LATERAL {name}_blocks(q.list, q.shard) c"""


def within_sql(name: str, asked: str, radius: float) -> str:
    """The statement that gives (qid, id, dist) at a distance of at most ``radius`` for the view ``asked`` (qid, qvec)."""
    return _measured(name, asked, f"{name}_within(q.asked, c.block, {float(radius)!r}D)")


def nearest_sql(name: str, asked: str, n: int) -> str:
    """The statement that gives (qid, rank, id, dist) of the ``n`` nearest for the view ``asked`` (qid, qvec)."""
    return f"""SELECT qid, CAST(rank AS BIGINT) AS rank, id, dist FROM (
  SELECT qid, id, dist, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), id) AS rank
  FROM ({_measured(name, asked, f"{name}_nearest(q.asked, c.block, {n})")})) WHERE rank <= {n}"""

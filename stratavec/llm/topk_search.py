"""Exact top-k inner products by best-first search of a distributed M-tree.

An inner product is bounded through the Euclidean metric: with a routing object c and a covering
radius r, every x below it has q.x <= q.c + |q| r, and with the parent p at distance d(p, c) already
q.x <= q.p + |q| (d(p, c) + r), which spares the computation of q.c. These are the M-tree's two
tests. The tree has three levels: routing objects fitted on a bounded sample give the subtrees
(cut into shards of a bounded size, so that copies of one vector cannot fill a task), each shard has
a root with paged nodes below it, and each page holds its vectors with a covering radius and its
distance to the parent. Every row is indexed, and the search is exact: what is left out has a bound
below the current k-th score of every query of the block.

Queries are a stated set. They go through the tree with the data, so a block holds queries of one
subtree, and are searched best-first in two passes. The first sends each block to a shard of its own
subtree, the most promising one, which gives every query a k-th score to beat. The second sends it
to the shards of those subtrees whose bound (routing object and covering radius, a table of at most
``max_routes`` rows a dimension) can beat the k-th score of any of its queries, and of those only. So
pairs of blocks and shards are pruned before any vector moves: the trees are shuffled once a pass,
and the blocks once for each pair that survives. In a shard the pages are visited best-first, too.
"""

from __future__ import annotations

import io
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .arrow import map_rows
from .common import discard, written


@dataclass(frozen=True)
class TreeSettings:
    """sample_rows: at most about so many vectors are seen when routing objects are chosen."""

    k: int = 20
    scale: int = 64
    query_modulus: int = 20
    sample_rows: int = 4096
    max_routes: int = 512
    shard_rows: int = 8192
    page_rows: int = 256
    query_block: int = 1024


def quantised(vector: list | None, scale: int) -> np.ndarray | None:
    """floor(scale * x) of every component, or None for vectors that take no part."""
    if vector is None or any(x is None for x in vector):
        return None
    v = np.array(vector, dtype=np.float64)
    return np.floor(scale * v) if np.isfinite(v).all() else None


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of a and b: in floating point where that is exact."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2**53:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a @ b.T).astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def spread(points: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first routing objects: each is the point farthest from those chosen before."""
    chosen, far = [0], distances(points, points[:1])[:, 0]
    while len(chosen) < count and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


def build_subtree(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, page_rows: int) -> bytes:
    """One shard: a root, and pages with routing object, covering radius and parent distance."""
    root = vectors.mean(axis=0) if len(vectors) else np.zeros(vectors.shape[1])
    step = max(1, len(vectors) // 1024)
    pivots = spread(vectors[::step], max(1, math.ceil(len(vectors) / page_rows)))
    gaps = distances(vectors, pivots)
    nearest = gaps.argmin(axis=1)
    order = np.lexsort((gaps[np.arange(len(vectors)), nearest], nearest))
    bounds = [0]
    for i in range(1, len(order)):
        if nearest[order[i]] != nearest[order[i - 1]] or i - bounds[-1] >= page_rows:
            bounds.append(i)
    bounds.append(len(order))
    rows, ids, vectors = rows[order], ids[order], vectors[order]
    centres = np.array([vectors[a:b].mean(axis=0) for a, b in zip(bounds, bounds[1:])])
    radii = np.array([distances(vectors[a:b], c[None])[:, 0].max() for a, b, c in zip(bounds, bounds[1:], centres)])
    out = io.BytesIO()
    np.savez(out, root=root, centres=centres, radii=radii, to_parent=distances(centres, root[None])[:, 0], bounds=np.array(bounds), rows=rows, ids=ids, vectors=vectors)
    return out.getvalue()


class BlockSearch:
    """The best k of a block of queries in the shards that it visits. ``rows`` are the queries' row
    numbers (a query is no candidate of its own), ``least`` what a score must reach, if known."""

    def __init__(self, rows: np.ndarray, vectors: np.ndarray, k: int, least: np.ndarray | None = None):
        self.rows, self.q, self.k = rows, vectors, k
        self.norm = np.sqrt((vectors * vectors).sum(axis=1))
        self.row = np.zeros(0, dtype=np.int64)
        self.score = np.zeros(0, dtype=np.int64)
        self.other = np.zeros(0, dtype=np.int64)
        self.least = np.full(len(rows), -np.inf) if least is None else least.copy()  # k-th score so far

    def _merge(self, row: np.ndarray, score: np.ndarray, other: np.ndarray) -> None:
        row, score, other = np.concatenate((self.row, row)), np.concatenate((self.score, score)), np.concatenate((self.other, other))
        order = np.lexsort((other, -score, row))
        row, score, other = row[order], score[order], other[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.row, self.score, self.other = row[kept], score[kept], other[kept]
        last = place[kept] == self.k - 1
        self.least[self.row[last]] = np.maximum(self.least[self.row[last]], self.score[last])

    def visit(self, tree) -> None:
        """Best-first over the pages of a shard."""
        slack = 1e-6 * (1 + self.norm)
        at_root = self.q @ tree["root"]
        loose = at_root[:, None] + self.norm[:, None] * (tree["to_parent"] + tree["radii"])[None, :] + slack[:, None]
        open_pages = np.flatnonzero((loose >= self.least[:, None]).any(axis=0))
        if not len(open_pages):
            return
        tight = self.q @ tree["centres"][open_pages].T + self.norm[:, None] * tree["radii"][open_pages][None, :] + slack[:, None]
        bounds, rows, ids, vectors = tree["bounds"], tree["rows"], tree["ids"], tree["vectors"]
        for i in np.argsort(-tight.max(axis=0), kind="stable"):
            alive = np.flatnonzero(tight[:, i] >= self.least)
            if not len(alive):
                continue
            a, b = bounds[open_pages[i]], bounds[open_pages[i] + 1]
            found = products(self.q[alive], vectors[a:b])
            good = (found >= self.least[alive][:, None]) & (rows[a:b][None, :] != self.rows[alive][:, None])
            r, c = np.nonzero(good)
            if len(r):
                self._merge(alive[r], found[r, c], ids[a:b][c])

    def results(self) -> list[np.ndarray]:
        """Row number of the query, id found, score."""
        return [self.rows[self.row], self.other, self.score]


def _grouped(df: DataFrame, keys: list[str], schema: str, work) -> DataFrame:
    """One output row per run of equal keys: ``work(key, rows, ids, vectors)`` on numpy arrays."""
    arranged = df.repartition(*keys).sortWithinPartitions(*keys, "vec_id", "row")
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        at, rows, ids, blobs = None, [], [], []

        def row():
            found = work(at, np.array(rows, dtype=np.int64), np.array(ids, dtype=np.int64), np.frombuffer(b"".join(blobs)).reshape(len(ids), -1))
            return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(found, out)], schema=out)

        for batch in batches:
            for *key, r, i, v in zip(*[batch.column(c).to_pylist() for c in [*keys, "row", "vec_id", "v"]]):
                if key != at:
                    if ids:
                        yield row()
                    at, rows, ids, blobs = key, [], [], []
                rows.append(r)
                ids.append(i)
                blobs.append(v)
        if ids:
            yield row()

    return arranged.mapInArrow(run, schema)


def _visited(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(dim, route, block, row, vec_id, score): the best k of every block of ``asked`` (dim, route,
    salt, home, block, queries, least) in the shard (dim, route, salt) that it names; ``home`` is the
    subtree of its queries. Blocks are shuffled to the trees, one tree at a time is held. Trees of copies are small as
    files and large in memory, so their size as files must not make them a broadcast."""
    pairs = asked.join(index.hint("merge"), ["dim", "route", "salt"]).select("dim", "home", "block", "queries", "least", "tree")
    schema = "dim int, home int, block int, row long, vec_id long, score long"
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                dim, home, block, queries, least, tree = (batch.column(c)[i].as_py() for c in range(6))
                q = np.load(io.BytesIO(queries))
                search = BlockSearch(q["rows"], q["vectors"], k, None if least is None else np.frombuffer(least))
                with np.load(io.BytesIO(tree)) as pages:
                    search.visit({name: pages[name] for name in pages.files})
                found = search.results()
                same = [np.full(len(found[0]), x, dtype=np.int32) for x in (dim, home, block)]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip([*same, *found], out)], schema=out)

    return pairs.mapInArrow(run, schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    by_score = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, settings: TreeSettings = TreeSettings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``query_modulus`` the k
    highest integer inner products with other rows, ties to the smaller id (all rows, where there
    are fewer).

    Vectors that are null or hold null or non-finite components take no part, nor do rows without
    an id. Rows that repeat an id are rows like any other: each is indexed, and each asks if its id
    does. Vectors are compared with those of their own dimension. Empty input gives an empty result.
    """
    s = settings

    def read(ids, vectors):
        for i, vector in zip(ids, vectors):
            v = quantised(vector, s.scale)
            if v is not None and len(v):
                yield i, len(v), v.tobytes()

    parsed = map_rows(rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), vector_col), "vec_id long, dim int, v binary", read)
    base = written(parsed.select(F.monotonically_increasing_id().alias("row"), "vec_id", "dim", "v"), "vectors")
    sizes = {r["dim"]: r["n"] for r in base.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())

    # Routing objects: farthest-first on a bounded sample, at most max_routes a dimension.
    point = F.pmod(F.xxhash64("vec_id", F.lit("routes")), F.lit(1 << 30))
    sample: dict[int, list] = {}
    for r in base.where(point < int(min(1.0, s.sample_rows / max(1, total)) * (1 << 30))).orderBy("vec_id", "row").limit(2 * s.sample_rows).collect():
        sample.setdefault(r["dim"], []).append(np.frombuffer(r["v"]))
    routes = {d: spread(np.array(v), min(s.max_routes, math.ceil(2 * sizes[d] / s.shard_rows))) for d, v in sample.items()}
    shared = rows.sparkSession.sparkContext.broadcast(routes)

    def route(numbers, ids, dims, blobs):
        for n, i, d, blob in zip(numbers, ids, dims, blobs):
            v = np.frombuffer(blob)
            gaps = distances(v[None], shared.value[d] if d in shared.value else np.zeros((1, d)))[0]
            yield n, i, d, blob, int(gaps.argmin()), float(gaps.min()), float(np.sqrt((v * v).sum()))

    routed = written(map_rows(base, "row long, vec_id long, dim int, v binary, route int, gap double, norm double", route), "vectors-routed")
    discard(base)
    asks = F.col("vec_id") % s.query_modulus == 0
    subtrees = routed.groupBy("dim", "route").agg(
        F.ceil(F.count(F.lit(1)) / s.shard_rows).cast("int").alias("parts"),
        F.ceil(F.sum(asks.cast("long")) / s.query_block).cast("int").alias("blocks"),
        F.max("gap").alias("radius")).persist()  # max_routes rows a dimension
    salted = routed.join(F.broadcast(subtrees.select("dim", "route", "parts", "blocks")), ["dim", "route"])
    salt = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("salt")
    page_rows, k = s.page_rows, s.k
    index = written(_grouped(salted.select("dim", "route", salt, "row", "vec_id", "v"), ["dim", "route", "salt"], "dim int, route int, salt int, tree binary",
                             lambda key, numbers, ids, vectors: (*key, build_subtree(numbers, ids, vectors, page_rows))), "m-tree")

    def block_row(key, numbers, ids, vectors):
        out = io.BytesIO()
        np.savez(out, rows=numbers, vectors=vectors)
        return (*key, out.getvalue())

    block = F.pmod(F.xxhash64("row", F.lit("block")), F.greatest("blocks", F.lit(1))).cast("int").alias("block")
    asked = written(_grouped(salted.where(asks).select("dim", "route", block, "row", "vec_id", "v"), ["dim", "route", "block"], "dim int, home int, block int, queries binary", block_row), "queries")
    named = routed.where(asks).select("row", F.col("vec_id").alias("query_id"))

    # First pass: a shard of the block's own subtree.
    parts = F.broadcast(subtrees.select("dim", F.col("route").alias("home"), F.col("parts").alias("own_parts")))
    home = asked.join(parts, ["dim", "home"]).select("dim", F.col("home").alias("route"), F.pmod("block", "own_parts").alias("salt"), "home", "block", "queries", F.lit(None).cast("binary").alias("least"))
    first = written(_visited(index, home, k), "top-k-first")

    # Second pass: every other shard whose subtree can beat a k-th score of the block.
    kth = _best(first, k).where(F.col("rank") == k).groupBy("dim", "home", "block").agg(F.collect_list(F.struct("row", "score")).alias("kth"))  # at most a block's queries
    tables = {d: (centres, np.full(len(centres), -1.0), np.zeros(len(centres), dtype=np.int64)) for d, centres in routes.items()}
    for r in subtrees.collect():
        centres, radii, counts = tables.setdefault(r["dim"], (np.zeros((1, r["dim"])), np.full(1, -1.0), np.zeros(1, dtype=np.int64)))
        radii[r["route"]], counts[r["route"]] = r["radius"], r["parts"]
    known = rows.sparkSession.sparkContext.broadcast(tables)

    def surviving(dims, homes, blocks, queries, scores):
        for d, h, b, blob, found in zip(dims, homes, blocks, queries, scores):
            q = np.load(io.BytesIO(blob))
            centres, radii, counts = known.value[d]
            least = np.full(len(q["rows"]), -np.inf)
            place = {r: i for i, r in enumerate(q["rows"].tolist())}
            for x in found or []:
                least[place[x["row"]]] = x["score"]
            norm = np.sqrt((q["vectors"] ** 2).sum(axis=1))
            reach = (q["vectors"] @ centres.T + norm[:, None] * radii[None, :] - least[:, None] + 1e-6 * (1 + norm[:, None])).max(axis=0)
            for r in np.flatnonzero((radii >= 0) & (reach >= 0)).tolist():
                for part in range(int(counts[r])):
                    if r != h or part != b % int(counts[h]):
                        yield d, r, part, h, b, blob, least.tobytes()

    more = map_rows(asked.join(kth.hint("merge"), ["dim", "home", "block"], "left").select("dim", "home", "block", "queries", "kth"),
                    "dim int, route int, salt int, home int, block int, queries binary, least binary", surviving)
    found = first.unionByName(_visited(index, more, k)).select("row", "vec_id", "score")
    return _best(found, k).join(named.hint("merge"), "row").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

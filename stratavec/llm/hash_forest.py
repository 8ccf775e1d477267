"""Approximate nearest neighbours by largest inner product: a forest of sorted hash strings.

Every distinct vector has one long string of hash bits a tree: signs of random directions, orthogonal within
a tree. Inner products become angles by one further component: with the largest norm m, a vector x is hashed
as (x / m, sqrt(1 - |x|^2 / m^2)) and a query q as (q / |q|, 0). A tree is the sorted array of its strings.
Spark sorts all trees at once by range, so a task holds contiguous runs of them (shards), however many
vectors share their first bits. Queries are strings in the same order, so each lies in the shard that holds its
longest matches.

A search takes two visits. The first descends: for each query and tree, binary searches count the strings that
share each prefix length. These counts meet by query, and all trees ascend synchronously, one prefix length at
a time and tree by tree, until they hold the number of candidates that is wanted. The second visit reads the
ranges of those prefix lengths. An ascent does not leave its shard; a range of more than the wanted candidates
gives those next to the query in the sorted order.

Candidates are pairs of places in blocks of vectors, two bytes each; a block of vectors meets the queries that
have candidates in it, one block at a time, and is scored by matrix products over the rows that any of them
named. Copies are one vector: it keeps the smallest ids that an answer can hold, and rows that repeat a
query's vector share one search.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, types as T
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .arrow import map_rows, trim
from .common import discard, written
from .joins import hot_join

#: A key is the number of a vector's block above these bits and its place in the block below.
PLACE_BITS = 12
BLOCK_ROWS = 1 << PLACE_BITS
#: Blocks of queries that meet a block of vectors in one task.
QUERY_BLOCKS = 64
BITS = 32


@dataclass(frozen=True)
class ForestSettings:
    """A query's candidates, counted once a tree, are at least ``per_row`` times the vectors, or
    ``candidates`` where that is fewer."""

    k: int = 20
    query_modulus: int = 20
    trees: int = 32
    per_row: float = 2.0
    candidates: int = 36_000
    shard_entries: int = 65_536
    seed: int = 13

    def wanted(self, vectors: int) -> int:
        return int(min(self.candidates, self.per_row * vectors))


@functools.lru_cache(maxsize=4)
def directions(dim: int, trees: int, seed: int) -> np.ndarray:
    """(dim + 1) x (trees * BITS): directions that are orthogonal within a tree, as far as ``dim`` allows."""
    rng = np.random.default_rng([seed, dim])
    out = []
    for _ in range(trees):
        parts, left = [], BITS
        while left:
            size = min(left, dim + 1)
            parts.append(np.linalg.qr(rng.standard_normal((dim + 1, size)))[0])
            left -= size
        out.append(np.concatenate(parts, axis=1))
    return np.concatenate(out, axis=1)


def strings(points: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Hash strings of rows (already with their further component): rows x trees, as integers whose order is
    that of the strings."""
    signs = points @ directions(points.shape[1] - 1, trees, seed) >= 0
    packed = np.packbits(signs.reshape(len(points), trees, BITS), axis=2)
    return packed.reshape(len(points), trees, BITS // 8).view(">u4")[:, :, 0].astype(np.int64)


def as_data(x: np.ndarray, longest: float) -> np.ndarray:
    x = x / longest
    return np.concatenate((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]), axis=1)


def as_query(q: np.ndarray) -> np.ndarray:
    return np.concatenate((q / np.sqrt((q * q).sum(axis=1))[:, None], np.zeros((len(q), 1))), axis=1)


def ranges(codes: np.ndarray, asked: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    """The places in sorted ``codes`` of the strings that share their first ``level`` bits with each of ``asked``."""
    low = asked >> (BITS - level) << (BITS - level)
    return np.searchsorted(codes, low), np.searchsorted(codes, low + (np.int64(1) << (BITS - level)))


def ascend(counts: np.ndarray, wanted: int) -> np.ndarray:
    """Prefix length at which each tree stops, of counts by tree and prefix length (which fall with the
    length): the longest at which all together hold ``wanted``; at that length trees go up one by one."""
    total = counts.sum(axis=0)
    enough = np.flatnonzero(total >= wanted)
    level = int(enough[-1]) if len(enough) else 0
    if level == counts.shape[1] - 1:
        return np.full(len(counts), level)
    more = np.cumsum(counts[:, level] - counts[:, level + 1])
    up = 1 + int(np.searchsorted(more, wanted - total[level + 1]))
    return np.where(np.arange(len(counts)) < up, level, level + 1)


def _mapped(df: DataFrame, schema: str, work) -> DataFrame:
    """mapInArrow where ``work(row)`` yields tuples of columns, each a batch of output rows."""
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                for columns in work(*[batch.column(c)[i].as_py() for c in range(batch.num_columns)]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out)
            trim()

    return df.mapInArrow(run, schema)


# ---------------------------------------------------------------- vectors

def _vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, dim, v): those that take part, written once."""

    def read(ids, vectors):
        for i, vector in zip(ids, vectors):
            if vector and not any(x is None for x in vector):
                v = np.array(vector, dtype=np.float64)
                if np.isfinite(v).all() and v.any():
                    yield i, len(v), v.tobytes()

    known = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), vector_col)
    return written(map_rows(known, "vec_id long, dim int, v binary", read).select(F.monotonically_increasing_id().alias("row"), "vec_id", "dim", "v"), "forest-vectors")


BLOCKS = "block long, dim int, vectors binary, asked array<long>, members array<array<struct<vec_id:long,row:long>>>"


def _blocks(base: DataFrame, s: ForestSettings) -> DataFrame:
    """Distinct vectors in blocks of one dimension: their values, how many rows ask with each, and the rows of
    the k + 1 smallest ids of each, which are all that an answer can hold."""
    by_id = Window.partitionBy("dim", "v").orderBy("vec_id", "row")
    few = base.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= s.k + 1)
    members = few.groupBy("dim", "v").agg(F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("members"))
    asks = base.where(F.col("vec_id") % s.query_modulus == 0).groupBy("dim", "v").agg(F.count(F.lit(1)).alias("n"))
    whole = written(members.join(asks, ["dim", "v"], "left").select("dim", "v", F.coalesce("n", F.lit(0)).alias("n"), "members"), "forest-distinct")
    out = to_arrow_schema(T.StructType.fromDDL(BLOCKS))

    def pack(batches):
        task, made, held = TaskContext.get().partitionId(), 0, {}

        def block(dim):
            nonlocal made
            values, asked, found = zip(*held.pop(dim))
            number = task << 20 | made
            made += 1
            columns = ([number], [dim], [b"".join(values)], [list(asked)], [list(found)])
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out)

        for batch in batches:
            for dim, v, n, found in zip(*[batch.column(c) for c in range(4)]):
                dim = dim.as_py()
                held.setdefault(dim, []).append((v.as_py(), n.as_py(), found.as_py()))
                if len(held[dim]) == BLOCK_ROWS:
                    yield block(dim)
        for dim in list(held):
            yield block(dim)

    tasks = max(1, -(-whole.count() // (4 * BLOCK_ROWS)))
    return written(whole.coalesce(tasks).mapInArrow(pack, BLOCKS), "forest-blocks")


def _matrix(values: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(values).reshape(-1, dim)


# ---------------------------------------------------------------- trees

SHARDS = "shard long, dim int, tree int, codes binary, keys binary, q_codes binary, q_keys binary, q_places binary"


def _forest(blocks: DataFrame, longest: dict[int, float], entries: int, s: ForestSettings) -> DataFrame:
    """Shards of the trees: sorted strings with their vectors' keys, and the queries among them with their
    strings and places."""

    def hashed(block, dim, values, asked):
        x = _matrix(values, dim)
        at, numbers = np.flatnonzero(np.array(asked)), np.arange(len(x)) | block << PLACE_BITS
        for keys, points, query in ((numbers, as_data(x, longest[dim]), False), (numbers[at], as_query(x[at]), True)):
            if len(keys):
                codes = strings(points, s.trees, s.seed)
                n = codes.size
                yield np.full(n, dim), np.tile(np.arange(s.trees), len(keys)), codes.ravel(), np.repeat(keys, s.trees), np.full(n, query)

    found = _mapped(blocks.select("block", "dim", "vectors", "asked"), "dim int, tree int, code long, key long, query boolean", hashed)
    # Equal strings lie in another order in each tree, so that ranges cut short differ.
    order = ["dim", "tree", "code", "tie"]
    ordered = found.withColumn("tie", F.hash("key", "tree")).repartitionByRange(max(1, -(-entries // s.shard_entries)), *order).sortWithinPartitions(*order)
    out = to_arrow_schema(T.StructType.fromDDL(SHARDS))

    def cut(batches):
        task, made = TaskContext.get().partitionId(), 0
        at, held = None, []

        def shard():
            nonlocal made
            code, key, query = (np.concatenate(x) for x in zip(*held))
            data = ~query
            places = np.cumsum(data)[query]  # strings before the query
            columns = ([task << 20 | made], [at[0]], [at[1]], *[[x.astype(np.int64).tobytes()] for x in (code[data], key[data], code[query], key[query], places)])
            made += 1
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out)

        for batch in batches:
            dim, tree, code, key, query = (np.asarray(batch.column(c)) if c < 4 else np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in range(5))
            first = 0
            while first < len(code):
                run = (int(dim[first]), int(tree[first]))
                size = sum(len(x[0]) for x in held)
                if held and (run != at or size >= 2 * s.shard_entries):
                    yield shard()
                    held, size = [], 0
                at = run
                last = min(int(np.flatnonzero(np.append((dim[first:] != run[0]) | (tree[first:] != run[1]), True))[0]) + first, first + 2 * s.shard_entries - size)
                held.append((code[first:last], key[first:last], query[first:last]))
                first = last
        if held:
            yield shard()

    return written(ordered.select("dim", "tree", "code", "key", "query").mapInArrow(cut, SHARDS), "forest-shards")


def _stops(shards: DataFrame, wanted: dict[int, int]) -> DataFrame:
    """(shard, stops): for each shard its queries (by their number in it) with the prefix length at which each
    stops."""

    def descend(shard, dim, tree, codes, q_codes, q_keys):
        codes, asked, keys = (np.frombuffer(x, dtype=np.int64) for x in (codes, q_codes, q_keys))
        if len(asked):
            counts = np.stack([np.subtract(*ranges(codes, asked, level)[::-1]) for level in range(BITS + 1)], axis=1)
            yield keys, np.full(len(keys), dim), np.full(len(keys), tree), np.full(len(keys), shard), np.arange(len(keys)), counts.tolist()

    known = _mapped(shards.select("shard", "dim", "tree", "codes", "q_codes", "q_keys"), "key long, dim int, tree int, shard long, number int, counts array<int>", descend)
    of_query = known.groupBy("key", "dim").agg(F.array_sort(F.collect_list(F.struct("tree", "shard", "number", "counts"))).alias("trees"))  # one a tree

    def level(keys, dims, trees):
        for _, dim, found in zip(keys, dims, trees):
            for t, stop in zip(found, ascend(np.array([t["counts"] for t in found]), wanted[dim]).tolist()):
                yield t["shard"], t["number"], stop

    stops = map_rows(of_query, "shard long, number int, level int", level)
    return stops.groupBy("shard").agg(F.collect_list(F.struct("number", "level")).alias("stops"))  # at most the shard's queries


def _candidates(shards: DataFrame, stops: DataFrame, wanted: dict[int, int]) -> DataFrame:
    """(block, q_block, pairs): candidate pairs by block of vectors and block of queries, as places (query's
    above 16 bits), written once."""

    def collect(stops, dim, codes, keys, q_codes, q_keys, q_places):
        codes, keys, asked, q_keys, places = (np.frombuffer(x, dtype=np.int64) for x in (codes, keys, q_codes, q_keys, q_places))
        number, level = np.array([x["number"] for x in stops]), np.array([x["level"] for x in stops])
        low, high = ranges(codes, asked[number], level)
        most = wanted[dim]
        low = np.maximum(low, np.minimum(places[number] - most // 2, high - most))
        high = np.minimum(high, low + most)
        size = high - low
        for part in np.array_split(np.arange(len(number)), max(1, int(size.sum()) >> 22)):
            n = size[part]
            row = np.arange(n.sum()) + np.repeat(low[part] - np.cumsum(n) + n, n)
            found, of = keys[row], np.repeat(q_keys[number[part]], n)
            pairs = ((of & BLOCK_ROWS - 1) << 16 | found & BLOCK_ROWS - 1).astype(np.uint32)
            blocks, at = np.unique(found >> PLACE_BITS, return_inverse=True)
            q_blocks, q_at = np.unique(of >> PLACE_BITS, return_inverse=True)
            cell = at * len(q_blocks) + q_at
            order = np.argsort(cell.astype(np.int32), kind="stable")
            cells, first = np.unique(cell[order], return_index=True)
            pieces = np.split(pairs[order], first[1:]) if len(cells) else []
            yield blocks[cells // len(q_blocks)], q_blocks[cells % len(q_blocks)], [p.tobytes() for p in pieces]

    met = shards.join(stops, "shard").select("stops", "dim", "codes", "keys", "q_codes", "q_keys", "q_places")
    return written(_mapped(met, "block long, q_block long, pairs binary", collect), "forest-candidates")


# ---------------------------------------------------------------- scores

def best_of(q: np.ndarray, x: np.ndarray, named: np.ndarray, first: np.ndarray, n: int):
    """(query, row, score) of the n best rows that each query named, ties to the smaller ``first``. A matrix
    product only shortlists; scores are sums of products in one fixed order."""
    rows = np.flatnonzero(named.any(axis=0))
    rough = np.where(named[:, rows], q @ x[rows].T, -np.inf)
    for i in range(len(q)):
        have = int(named[i].sum())
        if not have:
            continue
        keep = np.flatnonzero(rough[i] > -np.inf)
        if have > n:
            edge = np.partition(rough[i], len(rows) - n)[len(rows) - n]
            slack = 1e-12 * (np.sqrt((q[i] ** 2).sum()) * np.sqrt((x[rows[keep]] ** 2).sum(axis=1)).max() + 1e-300)
            keep = np.flatnonzero(rough[i] >= edge - slack)
        at = rows[keep]
        score = (x[at] * q[i]).sum(axis=1)
        order = np.lexsort((first[at], -score))[:n]
        yield i, at[order], score[order]


def _scored(blocks: DataFrame, cells: DataFrame, s: ForestSettings) -> DataFrame:
    """(q_key, key, first, score): the best k + 1 vectors of each query and block. Rows of a stream: a block of
    vectors, then, for each block of queries, their vectors and the pairs of all trees."""

    def asking(block, dim, values, asked):
        at = np.flatnonzero(np.array(asked))
        if len(at):
            yield [block], [dim], [_matrix(values, dim)[at].tobytes()], [at.astype(np.int64).tobytes()]

    def owning(block, dim, values, members):
        yield [block], [dim], [values], [np.array([m[0]["vec_id"] for m in members], dtype=np.int64).tobytes()]

    typed = "block long, dim int, vectors binary, more binary"
    queries = _mapped(blocks.select("block", "dim", "vectors", "asked"), typed, asking).select(F.col("block").alias("q_block"), "dim", "vectors", "more")
    owners = _mapped(blocks.select("block", "dim", "vectors", "members"), typed, owning)
    lane = F.floor(F.col("q_block") / QUERY_BLOCKS).cast("long").alias("lane")
    keys = cells.select("block", "q_block", lane).distinct()
    none = F.lit(None).cast("binary")
    stream = keys.select("block", "lane").distinct().join(owners, "block").select("block", "lane", F.lit(-1).cast("long").alias("q_block"), F.lit(0).alias("kind"), "dim", "vectors", "more")
    stream = stream.unionByName(keys.join(queries, "q_block").select("block", "lane", "q_block", F.lit(1).alias("kind"), "dim", "vectors", "more"))
    stream = stream.unionByName(cells.select("block", lane, "q_block", F.lit(2).alias("kind"), F.lit(0).alias("dim"), F.col("pairs").alias("vectors"), none.alias("more")))
    stream = stream.repartition("block", "lane").sortWithinPartitions("block", "lane", "q_block", "kind")
    schema = "q_key long, key long, first long, score double"
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def score(batches):
        x = first = q = places = named = block = q_block = None

        def done():
            found = [(places[i] | q_block << PLACE_BITS, at | block << PLACE_BITS, first[at], values) for i, at, values in best_of(q, x, named, first, s.k + 1)]
            columns = [np.concatenate([np.full(len(f[1]), f[0]) for f in found]), *(np.concatenate([f[c] for f in found]) for c in (1, 2, 3))]
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out)

        for batch in batches:
            for now, of, kind, dim, values, more in zip(*[batch.column(c) for c in ("block", "q_block", "kind", "dim", "vectors", "more")]):
                kind, values = kind.as_py(), values.as_py()
                if kind < 2 and named is not None:
                    yield done()
                    named = None
                if kind == 0:
                    block, x, first = now.as_py(), _matrix(values, dim.as_py()), np.frombuffer(more.as_py(), dtype=np.int64)
                elif kind == 1:
                    q_block, q, places = of.as_py(), _matrix(values, dim.as_py()), np.frombuffer(more.as_py(), dtype=np.int64)
                    named = np.zeros((len(q), len(x)), dtype=bool)
                    number = np.zeros(BLOCK_ROWS, dtype=np.int64)
                    number[places] = np.arange(len(places))
                else:
                    pairs = np.frombuffer(values, dtype=np.uint32).astype(np.int64)
                    named[number[pairs >> 16], pairs & 0xFFFF] = True
        if named is not None:
            yield done()
        trim()

    return stream.mapInArrow(score, schema)


def _answers(scored: DataFrame, blocks: DataFrame, s: ForestSettings) -> DataFrame:
    """(q_key, found): the k + 1 best rows of each query's vector, best first."""
    by_score = Window.partitionBy("q_key").orderBy(F.desc("score"), "first")
    best = scored.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= s.k + 1).select("q_key", "key", "score")

    def listed(block, members):
        yield np.arange(len(members)) | block << PLACE_BITS, members

    rows = _mapped(blocks.select("block", "members"), "key long, members array<struct<vec_id:long,row:long>>", listed)
    each = best.join(rows, "key").select("q_key", (-F.col("score")).alias("under"), F.explode("members").alias("m"))
    found = F.slice(F.array_sort(F.collect_list(F.struct("under", "m.vec_id", "m.row"))), 1, s.k + 1)
    return each.groupBy("q_key").agg(found.alias("found"))  # at most (k + 1)^2 rows a query


def nearest(rows: DataFrame, settings: ForestSettings = ForestSettings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by ``query_modulus`` the k other rows of
    largest inner product among its candidates (all candidates, where there are fewer), ties to the smaller id.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id.
    Rows that repeat an id are rows like any other: each is indexed, and each asks if its id does. Vectors are
    compared with those of their own dimension. Every vector is indexed; the hashes are drawn from a seed and
    need no training. Empty input gives an empty result.
    """
    s = settings
    base = _vectors(rows, id_col, vector_col)
    blocks = _blocks(base, s)

    def measure(block, dim, values):
        x = _matrix(values, dim)
        yield [dim], [len(x)], [float(np.sqrt((x * x).sum(axis=1)).max())]

    sizes = _mapped(blocks.select("block", "dim", "vectors"), "dim int, n long, longest double", measure).groupBy("dim").agg(F.sum("n").alias("n"), F.max("longest").alias("longest")).collect()  # a row a dimension
    longest, wanted = {r["dim"]: r["longest"] for r in sizes}, {r["dim"]: s.wanted(r["n"]) for r in sizes}
    shards = _forest(blocks, longest, s.trees * sum(r["n"] for r in sizes), s)
    cells = _candidates(shards, _stops(shards, wanted), wanted)
    answers = written(_answers(_scored(blocks, cells, s), blocks, s), "forest-answers")
    discard(shards, cells)

    def keyed(block, dim, values, asked):
        x = _matrix(values, dim)
        at = np.flatnonzero(np.array(asked))
        if len(at):
            yield np.full(len(at), dim), [x[i].tobytes() for i in at], at | block << PLACE_BITS, np.array(asked)[at]

    # A vector with which very many rows ask has few answers: they are brought to its rows.
    located = _mapped(blocks.select("block", "dim", "vectors", "asked"), "dim int, v binary, q_key long, n long", keyed).join(answers, "q_key").select("dim", "v", "n", "found")
    asks = base.where(F.col("vec_id") % s.query_modulus == 0)
    met = hot_join(asks.select("row", F.col("vec_id").alias("query_id"), "dim", "v"), located, ["dim", "v"], "n", asks.count())
    others = F.slice(F.filter("found", lambda f: f["row"] != F.col("row")), 1, s.k)
    ranked = met.select("query_id", F.posexplode(others).alias("rank", "f"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.under")).alias("score"))

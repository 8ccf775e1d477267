"""The k-nearest-neighbour graph by neighbour descent: a neighbour of a neighbour is likely a neighbour.

The graph begins with the nearest rows within small groups, the leaves of random k-d trees. In a round every row brings together
those that it points to and those that point to it, a bounded sample of each, which meet each other's vectors; a pair
is handed on only to a row for which it is nearer than the k-th neighbour so far. Pairs of which both were
brought together in an earlier round are left out. The rounds end when few edges change. Work in a round grows with the
rows, never with their pairs: the samples bound what meets at a row, also at one to which very many point.

Rows that lie near each other are dealt to cells of about CELL_ROWS rows, by a tree of sampled rows, other ones each round, and carry their
edges along: a round within cells is one shuffle of the rows. What has neighbours in another cell waits for the
next round. Only where cells keep many neighbours apart (in high dimensions) do further rounds bring single rows together by joins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, types as T
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.blocks import map_matrix, matrix
from ..functions.kernels import exact_distances
from ..plans.session import materialised, remove
from .bounded import LIST_SAMPLE, _cut, _placed
from .kmeans import sampled

EDGES = "src long, dst long, dist double, fresh boolean"
#: A row with its edges, nearest first (infinitely far: none); the first row of a cell also has the round's counts.
LISTS = "id long, vec array<double>, dst array<long>, dist array<double>, fresh array<boolean>, changed long, apart long, taken long, cell int"
#: Rows of a cell, about; cells at most about; rows of a cell that meet in one group.
CELL_ROWS = 4096
MAX_CELLS = 4096
MAX_CELL_ROWS = 65_536
#: Rows of a task.
TASK_ROWS = 65_536
#: Rounds within a cell before it is cut anew; rounds by joins follow where more than so many edges were kept apart.
CELL_ROUNDS = 3
APART = 0.1


@dataclass(frozen=True)
class DescentParams:
    """width: edges that a row keeps during the rounds, at least as many as are asked for; group: rows of a group at the start at most, of which there are ``starts`` for each row; sample: of a row's
    fresh edges, and of its older ones, so many go out and as many come in; a round that changes at most
    ``stop`` of all edges is the last."""

    width: int = 10
    group: int = 48
    starts: int = 2
    sample: int = 6
    rounds: int = 12
    stop: float = 0.01
    seed: int = 1

    def __post_init__(self):
        if self.group < 2 or self.starts < 1 or self.sample < 1 or self.rounds < 0 or not 0 <= self.stop < 1:
            raise ValueError("groups need two rows, a start, a sample and a share of edges that stops the rounds")


@dataclass
class Descent:
    """The graph (src, rank, dst, dist), the rounds that ran, and the distances that were taken."""

    edges: DataFrame
    rounds: int
    distances: int


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of each row, each once; an edge that was known stays as it was."""
    once = edges.groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.min("fresh").alias("fresh"))
    w = Window.partitionBy("src").orderBy(F.round("dist", 9), "dst")
    return once.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _met(groups: DataFrame, work) -> DataFrame:
    """Edges of ``work(ids, fresh, limits, x)``, a matrix a row of ``groups`` (members: id, fresh, limit, vec); and in one more row
    a batch, without ends, the number of distances taken."""
    out = to_arrow_schema(T.StructType.fromDDL(EDGES))

    def run(batches):
        for batch in batches:
            taken = 0
            for members in batch.column(0):
                members = members.as_py()
                ids, x = np.array([m["id"] for m in members], dtype=np.int64), np.array([m["vec"] for m in members], dtype=np.float64)
                fresh, limits = np.array([m["fresh"] for m in members], dtype=bool), np.array([m["limit"] for m in members], dtype=np.float64)
                n, src, dst, dist = work(ids, fresh, limits, x)
                taken += n
                if len(src):
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((src, dst, dist, np.ones(len(src), dtype=bool)), out)], schema=out)
            yield pa.RecordBatch.from_arrays([pa.array([c], type=f.type) for c, f in zip((None, None, float(taken), None), out)], schema=out)

    return groups.select("members").mapInArrow(run, EDGES)


def _leaves(x: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """Groups of at most ``size`` rows of x, a row of places each (-1: none): a k-d tree whose cuts lie at random between four and six tenths."""
    cut, group, level = np.zeros(len(x), dtype=np.int64), np.arange(len(x)), None
    while True:
        level, starts, counts = np.unique(cut, return_index=True, return_counts=True)
        if counts.max() <= size:
            break
        wide = (np.maximum.reduceat(x[group], starts) - np.minimum.reduceat(x[group], starts)).argmax(axis=1)
        number = np.repeat(np.arange(len(level)), counts)
        order = np.lexsort((x[group, wide[number]], number))
        group = group[order]
        first = np.where(counts > size, np.round(counts * rng.uniform(0.4, 0.6, len(counts))), counts).astype(np.int64)
        place = np.arange(len(x)) - np.repeat(starts, counts)
        cut = 2 * number + (place >= first[number])
    out = np.full((len(level), counts.max()), -1, dtype=np.int64)
    number = np.repeat(np.arange(len(level)), counts)
    out[number, np.arange(len(x)) - starts[number]] = group
    return out


def _drawn(key: np.ndarray, fresh: np.ndarray, sample: int, rng: np.random.Generator) -> np.ndarray:
    """Places of at most ``sample`` fresh and as many older entries of each key, at random."""
    if not len(key):
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((rng.random(len(key)), fresh, key))
    new = np.concatenate(([True], (np.diff(key[order]) != 0) | (fresh[order][1:] != fresh[order][:-1])))
    start = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return order[np.arange(len(key)) - start < sample]


class _Cell:
    """Rows that lie together, with their edges, of which some lead elsewhere."""

    def __init__(self, ids, x, dst, dist, fresh, rng):
        self.ids, self.x, self.dst, self.dist, self.fresh, self.rng = ids, x, dst, dist, fresh, rng
        self.changed = self.taken = 0

    def here(self) -> np.ndarray:
        """Places of the edges' ends, -1 elsewhere."""
        order = np.argsort(self.ids)
        at = np.minimum(np.searchsorted(self.ids, self.dst, sorter=order), len(self.ids) - 1)
        at = order[at]
        return np.where((self.ids[at] == self.dst) & (self.dist < np.inf), at, -1)

    def meet(self, a: np.ndarray, b: np.ndarray, fresh: bool) -> int:
        """Pairs of places, once each: handed to those whose last edge they beat. The number of edges that changed."""
        one, both = np.minimum(a, b), np.maximum(a, b)
        pairs = np.unique(one * len(self.ids) + both)
        a, b = pairs // len(self.ids), pairs % len(self.ids)
        dist = np.empty(len(a))
        for at in range(0, len(a), 1 << 16):
            d = self.x[a[at:at + (1 << 16)]] - self.x[b[at:at + (1 << 16)]]
            dist[at:at + (1 << 16)] = np.sqrt((d * d).sum(axis=1))
        self.taken += len(a)
        src, to, dist = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((dist, dist))
        beat = dist < self.dist[src, -1]
        src, to, dist = src[beat], to[beat], dist[beat]
        if not len(src):
            return 0
        rows, k = np.unique(src), self.dst.shape[1]
        r, c = np.nonzero(self.dist[rows] < np.inf)
        src = np.concatenate((rows[r], src))
        ends = np.concatenate((self.dst[rows][r, c], self.ids[to]))
        new = np.arange(len(src)) >= len(r)
        state = np.concatenate((self.fresh[rows][r, c], np.full(len(to), fresh)))
        dist = np.concatenate((self.dist[rows][r, c], dist))
        # An edge that was known stays as it was.
        order = np.lexsort((new, ends, src))
        once = np.concatenate(([True], (np.diff(src[order]) != 0) | (np.diff(ends[order]) != 0)))
        order = order[once]
        order = order[np.lexsort((ends[order], np.round(dist[order], 9), src[order]))]
        begin = np.concatenate(([True], np.diff(src[order]) != 0))
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(begin, np.arange(len(order)), 0))
        order, rank = order[rank < k], rank[rank < k]
        self.dst[rows], self.dist[rows], self.fresh[rows] = -1, np.inf, False
        self.dst[src[order], rank], self.dist[src[order], rank], self.fresh[src[order], rank] = ends[order], dist[order], state[order]
        self.changed += (found := int(new[order].sum()))
        return found

    def start(self, turned: np.ndarray, group: int, fresh: bool) -> None:
        leaves = _leaves(turned, group, self.rng)
        i, j = np.triu_indices(leaves.shape[1], 1)
        a, b = leaves[:, i].ravel(), leaves[:, j].ravel()
        self.meet(a[b >= 0], b[b >= 0], fresh)

    def round(self, sample: int) -> int:
        """Edges that changed as the rows brought their neighbours together."""
        here = self.here()
        r, c = np.nonzero(here >= 0)
        to, fresh = here[r, c], self.fresh[r, c]
        out, back = _drawn(r, fresh, sample, self.rng), _drawn(to, fresh, sample, self.rng)
        at, member, state = np.concatenate((r[out], to[back])), np.concatenate((to[out], r[back])), np.concatenate((fresh[out], fresh[back]))
        # Brought together; rows with an edge that leads elsewhere wait for those to be here, too.
        whole = ((here >= 0) | (self.dist == np.inf)).all(axis=1)
        met = out[fresh[out] & whole[r[out]]]
        order = np.lexsort((~state, member, at))
        at, member, state = at[order], member[order], state[order]
        once = np.concatenate(([True], (np.diff(at) != 0) | (np.diff(member) != 0)))[:len(at)]
        at, member, state = at[once], member[once], state[once]
        busy = np.zeros(len(self.ids), dtype=bool)
        busy[at[state]] = True
        at, member, state = at[busy[at]], member[busy[at]], state[busy[at]]
        self.fresh[r[met], c[met]] = False
        if not len(at):
            return 0
        _, starts, counts = np.unique(at, return_index=True, return_counts=True)
        firsts, seconds = [], []
        for low in range(0, len(starts), 1024):
            n, s = counts[low:low + 1024], starts[low:low + 1024]
            place = s[:, None] + np.arange(n.max())
            real = np.arange(n.max()) < n[:, None]
            place = np.where(real, place, 0)
            new = state[place] & real
            ask = np.triu(np.ones((n.max(), n.max()), dtype=bool), 1) & (new[:, :, None] | new[:, None, :]) & real[:, :, None] & real[:, None, :]
            g, i, j = np.nonzero(ask)
            firsts.append(member[place[g, i]])
            seconds.append(member[place[g, j]])
        return self.meet(np.concatenate(firsts), np.concatenate(seconds), True)


def _turned(dim: int, seed: int, number: int) -> np.ndarray:
    """A random rotation, by which the cells and groups of a round are cut."""
    return np.linalg.qr(np.random.default_rng([seed, number]).standard_normal((dim, dim)))[0]


class _Cells:
    """Trees of the rounds over one sample of the rows."""

    def __init__(self, v: DataFrame, n: int, dim: int, p: DescentParams):
        self.cells, self.dim, self.seed = min(MAX_CELLS, -(-n // CELL_ROWS)), dim, p.seed
        rows = sampled(v, 2 * LIST_SAMPLE * self.cells, p.seed).collect() if self.cells > 1 else []  # a bounded number
        self.sample = np.array([r["vec"] for r in rows], dtype=np.float64).reshape(len(rows), dim)

    def tree(self, number: int):
        """The tree of a round, by half of the sample."""
        if self.cells < 2:
            return 0
        half = np.random.default_rng([self.seed, number, 1]).permutation(len(self.sample))[:len(self.sample) // 2]
        return _cut(self.sample[half] @ _turned(self.dim, self.seed, number), [])


def _dealt(tree, x: np.ndarray, seed: int, number: int) -> np.ndarray:
    cell = np.zeros(len(x), dtype=np.int64)
    _placed(tree, x @ _turned(x.shape[1], seed, number), np.arange(len(x)), cell)
    return cell


def _cell_round(lists: DataFrame, n: int, k: int, p: DescentParams, number: int, following) -> DataFrame:
    """LISTS after a round within the cells that ``lists`` names, with the cells of the next round by the tree ``following``."""
    out = to_arrow_schema(T.StructType.fromDDL(LISTS))
    shared = lists.sparkSession.sparkContext.broadcast(following)
    sizes = lists.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / MAX_CELL_ROWS).cast("int").alias("parts")).where("parts > 1")  # few, a row a cell
    part = F.pmod(F.xxhash64("id", F.lit(number)), F.coalesce("parts", F.lit(1)))
    dealt = lists.join(F.broadcast(sizes), "cell", "left").select("id", "vec", "dst", "dist", "fresh", "cell", part.cast("int").alias("part"))
    dealt = dealt.repartition(max(1, -(-n // TASK_ROWS)), "cell", "part").sortWithinPartitions("cell", "part")

    def lists_of(column, kind):
        return np.array(column.flatten(), dtype=kind).reshape(-1, k)

    def work(key, held):
        ids, x, dst, dist, fresh = (np.concatenate(c) for c in zip(*held))
        cell = _Cell(ids, x, dst, dist, fresh, np.random.default_rng([p.seed, number, *key]))
        if number <= p.starts:
            # Rows of a first group have met all others of it: their edges have nothing more to bring together.
            cell.start(x @ _turned(x.shape[1], p.seed, number), p.group, number > 1)
        if number > 1:
            for _ in range(CELL_ROUNDS):
                if cell.round(p.sample) <= p.stop * cell.dst.size:
                    break
        apart = int((cell.fresh & (cell.here() < 0)).sum())
        counts = np.zeros((3, len(ids)), dtype=np.int64)
        counts[:, 0] = cell.changed, apart, cell.taken
        columns = [ids, x, cell.dst, cell.dist, cell.fresh, *counts, _dealt(shared.value, x, p.seed, number + 1)]
        for at in range(0, len(ids), 4096):
            parts = [c[at:at + 4096] for c in columns]
            arrays = [pa.array(c, type=f.type) if c.ndim == 1 else pa.ListArray.from_arrays(np.arange(0, c.size + 1, c.shape[1], dtype=np.int32), pa.array(c.ravel())) for c, f in zip(parts, out)]
            yield pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, out)], schema=out)

    def run(batches):
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(5)), np.asarray(batch.column(6))], axis=1)
            columns = [np.asarray(batch.column(0)), matrix(batch.column(1)), lists_of(batch.column(2), np.int64), lists_of(batch.column(3), np.float64), lists_of(batch.column(4), bool)]
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1).tolist(), len(keys)]
            for low, high in zip(cuts, cuts[1:]):
                mine = tuple(keys[low].tolist())
                if held and mine != key:
                    yield from work(key, held)
                    held = []
                key = mine
                held.append([c[low:high] for c in columns])
        if held:
            yield from work(key, held)

    return dealt.mapInArrow(run, LISTS)


def _across(ids, fresh, limits, x):
    """Pairs of which one at least is fresh, handed to those whose limit they beat."""
    near = exact_distances(x, x)
    ask = (fresh[:, None] | fresh[None, :]) & (ids[:, None] != ids[None, :])
    a, b = np.nonzero(ask & (near < limits[:, None]))
    return int(np.triu(ask).sum()), ids[a], ids[b], near[a, b]


def _split(met: DataFrame) -> tuple[DataFrame, int]:
    taken = met.where(F.col("src").isNull()).agg(F.coalesce(F.sum("dist"), F.lit(0.0))).first()[0]
    return met.where(F.col("src").isNotNull()), int(taken)


def neighbour_descent(vectors: DataFrame, k: int, params: DescentParams = DescentParams()) -> Descent:
    """The graph of (id, vec), without a row's own edge. Ids must differ. A table of at most k rows gives each
    row all others; rounds are written to the shared folder, and the one before is deleted."""
    p, asked_for = params, k
    k = max(k, p.width)
    v = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    n = v.count()
    if not n:
        return Descent(v.select(F.col("id").alias("src"), F.col("id").alias("rank"), F.col("id").alias("dst"), F.lit(0.0).alias("dist")), 0, 0)
    cells = _Cells(v, n, v.select(F.size("vec")).first()[0], p)
    seed, tree = p.seed, v.sparkSession.sparkContext.broadcast(cells.tree(1))
    none = [F.array_repeat(F.lit(x), k).alias(c) for x, c in ((-1, "dst"), (float("inf"), "dist"), (False, "fresh"))]
    first = map_matrix(v, "vec", "id long, vec array<double>, cell int", lambda columns, x: {**columns, "cell": _dealt(tree.value, x, seed, 1)})
    lists = first.select("id", "vec", none[0].cast("array<long>").alias("dst"), none[1], none[2], "cell")
    number = rounds = taken = 0
    while number < p.starts + p.rounds:
        number += 1
        following = materialised(_cell_round(lists, n, k, p, number, cells.tree(number + 1)), "descent-cells")
        changed, apart, more = following.agg(F.sum("changed"), F.sum("apart"), F.sum("taken")).first()
        taken += more
        if number > 1:
            remove(lists)
        lists = following
        # The trees come first; a round with few changes, or one that finds the neighbours apart, is the last within cells.
        rounds += number > 1
        if number >= max(2, p.starts) and (changed <= p.stop * n * k or apart > APART * n * k):
            break
    ends = F.explode(F.arrays_zip("dst", "dist", "fresh")).alias("e")
    edges = lists.select(F.col("id").alias("src"), ends).select("src", "e.dst", "e.dist", "e.fresh").where(F.col("dist") < float("inf"))
    if number < max(2, p.starts) or apart <= APART * n * k:
        return Descent(_nearest(edges, asked_for).select("src", "rank", "dst", "dist"), rounds, taken)
    edges, cut = materialised(_nearest(edges, k), "descent"), lists
    remove(cut)
    while rounds < p.rounds:
        rounds += 1
        joined, asked = _round(edges, v, k, p, rounds)
        pairs, more = _split(joined)
        taken += more
        # What has been brought together is no longer fresh.
        known = edges.join(asked, ["src", "dst"], "left").select("src", "dst", "dist", (F.col("fresh") & F.col("asked").isNull()).alias("fresh"))
        following = materialised(_nearest(known.unionByName(pairs), k).join(edges.select("src", "dst", F.lit(True).alias("old")), ["src", "dst"], "left"), "descent")
        changed = following.where(F.col("old").isNull()).count()
        for table in (edges, joined, asked):
            remove(table)
        edges = following.drop("old")
        edges.path = following.path
        if changed <= p.stop * n * k:
            break
    return Descent(edges.where(F.col("rank") <= asked_for).select("src", "rank", "dst", "dist"), rounds, taken)


def _round(edges: DataFrame, v: DataFrame, k: int, p: DescentParams, number: int) -> tuple[DataFrame, DataFrame]:
    """(edges of the pairs that met, fresh edges that were sampled), both written."""
    lot = F.xxhash64("src", "dst", F.lit(p.seed), F.lit(number))
    out = edges.withColumn("place", F.row_number().over(Window.partitionBy("src", "fresh").orderBy(lot))).where(F.col("place") <= p.sample)
    asked = materialised(out.where("fresh").select("src", "dst", F.lit(True).alias("asked")), "descent-asked")
    back = edges.withColumn("place", F.row_number().over(Window.partitionBy("dst", "fresh").orderBy(lot))).where(F.col("place") <= p.sample)
    meeting = out.select(F.col("src").alias("at"), F.col("dst").alias("id"), "fresh").unionByName(back.select(F.col("dst").alias("at"), F.col("src").alias("id"), "fresh"))
    meeting = meeting.groupBy("at", "id").agg(F.max("fresh").alias("fresh"))
    full = edges.groupBy("src").agg(F.max("dist").alias("limit"), F.count(F.lit(1)).alias("n"))
    limits = v.join(full, F.col("id") == F.col("src"), "left").select("id", "vec", F.when(F.col("n") == k, F.col("limit")).otherwise(float("inf")).alias("limit"))
    members = meeting.join(limits, "id").groupBy("at").agg(F.collect_list(F.struct("id", "fresh", "limit", "vec")).alias("members"))  # four samples at most
    met = _met(members.where(F.exists("members", lambda m: m["fresh"]) & (F.size("members") > 1)), _across)
    return materialised(met, "descent-met"), asked

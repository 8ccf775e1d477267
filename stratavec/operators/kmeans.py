"""k-means with k-means++ or random seeding.

Rows are packed once into blocks in the order of ids and kept. Seeding runs two small jobs a centre: each task
adds up its rows' squared distances from the nearest centre so far, and the task that holds the draw is
searched. Rows keep their running minimum over all but the last few centres. An iteration is one job: a
task adds up its rows' sums per centre, so k rows a task are shuffled, and centres are collected (k x d numbers).

The same way is taken at every size. A caller whose input is a bounded sample may fit it where the driver is
(``local_rows``), with the same clusters.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.blocks import BLOCK, PACKED, map_matrix, packed, unpacked
from ..functions.kernels import assign, lloyd, seed_centres
from ..plans.draws import permutation, uniforms
from ..plans.params import KMeansParams

#: A training sample of at most so many rows is fitted on the driver.
SAMPLE_ROWS = 20_000
#: Centres whose distances are taken anew in each pass of the seeding; older ones are in the running minima.
FRESH = 32
#: Blocks that one task holds.
TASK_BLOCKS = 16
KEPT = f"part int, {PACKED}, low binary"


def spark_centres(spark, centres: np.ndarray) -> DataFrame:
    """(cid, c)"""
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "cid int, c array<double>")


def assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(id, vec, cid, d2): each vector with its nearest centre; no shuffle."""
    shared = vectors.sparkSession.sparkContext.broadcast(np.asarray(centres, dtype=np.float64))

    def work(columns, x):
        label, gap = assign(x, shared.value)
        return {**columns, "cid": label, "d2": gap}

    typed = f"id long, vec {vectors.schema['vec'].dataType.simpleString()}, cid int, d2 double"
    return map_matrix(vectors.select(F.col("id").cast("long").alias("id"), "vec"), "vec", typed, work)


def in_permuted_order(vectors: DataFrame, seed: int):
    """The column that orders ids for sampling without replacement, ties by id."""
    p = permutation(seed)
    return F.pmod(F.pmod(F.col("id"), F.lit(p.prime)) * F.lit(p.factor) + F.lit(p.shift), F.lit(p.prime))


def sampled(vectors: DataFrame, rows: int, seed: int) -> DataFrame:
    """``rows`` distinct vectors by the seeded order; Spark takes them with a bounded top-n per task."""
    return vectors.select("id", "vec").orderBy(in_permuted_order(vectors, seed), "id").limit(rows)


class KMeans:
    def __init__(self, params: KMeansParams = KMeansParams(), local_rows: int = 0):
        self.params, self.local_rows = params, local_rows
        self.clear()

    def clear(self) -> None:
        self._centres: np.ndarray | None = None
        self._assigned_by: np.ndarray | None = None
        self._labels: DataFrame | None = None

    def centroids(self) -> np.ndarray:
        return self._centres

    def labelling_centres(self) -> np.ndarray | None:
        """The centres that the last assignment, labels(), went by."""
        return self._assigned_by

    def labels(self) -> DataFrame:
        """(id, cid) of the last assignment, which precedes the last update of the centres."""
        return self._labels

    def predict(self, vectors: DataFrame) -> DataFrame:
        """(id, cid) by the nearest centre; -1 before fit()."""
        if self._centres is None:
            return vectors.select("id", F.lit(-1).alias("cid"))
        return assigned(vectors, self._centres).select("id", "cid")

    def fit(self, vectors: DataFrame) -> int:
        """Clusters (id, vec); returns the number of iterations that ran."""
        p = self.params
        n = vectors.count()
        if p.k > n:
            raise ValueError(f"k={p.k} is more than the {n} rows")
        if n <= self.local_rows:
            return self._fit_local(vectors)
        blocks = in_blocks(vectors).persist()
        try:
            return self.fit_blocks(vectors, blocks, self.seeds_distributed(vectors, n) if p.init == "random" else self._spread(blocks, n))
        finally:
            blocks.unpersist()

    # ------------------------------------------------------------ bounded samples

    def _fit_local(self, vectors: DataFrame) -> int:
        """The clusters of at most ``local_rows`` rows, which are collected."""
        p = self.params
        rows = vectors.select("id", F.col("vec").cast("array<double>").alias("vec")).orderBy("id").collect()  # at most local_rows
        ids = np.array([r["id"] for r in rows], dtype=np.int64)
        x = np.array([r["vec"] for r in rows])
        start = x[self._seeds_local(ids, x)]
        by: list[np.ndarray] = []
        self._centres, labels, rounds = lloyd(x, start, p.max_iters, p.tol, p.empty, by)
        self._assigned_by = by[0]
        self._labels = vectors.sparkSession.createDataFrame(list(zip(ids.tolist(), labels.tolist())), "id long, cid int")
        return rounds

    def _seeds_local(self, ids: np.ndarray, x: np.ndarray) -> list[int]:
        p = self.params
        if p.init == "random":
            q = permutation(p.seed)
            key = [((i % q.prime) * q.factor + q.shift) % q.prime for i in ids.tolist()]
            return sorted(range(len(ids)), key=lambda j: (key[j], ids[j]))[:p.k]
        return seed_centres(x, uniforms(p.seed, p.k))

    # ------------------------------------------------------------ tables of any size

    def seeds_distributed(self, vectors: DataFrame, n: int) -> np.ndarray:
        """The first centres of (id, vec) of ``n`` rows."""
        p = self.params
        if p.init == "random":
            return np.array([r["vec"] for r in sampled(vectors, p.k, p.seed).collect()], dtype=np.float64)
        blocks = in_blocks(vectors).persist()
        try:
            return self._spread(blocks, n)
        finally:
            blocks.unpersist()

    def _spread(self, blocks: DataFrame, n: int) -> np.ndarray:
        """k-means++ by running sums in the order of ids."""
        centres: list[np.ndarray] = []
        held, done = blocks, 0
        for u in uniforms(self.params.seed, self.params.k):
            fresh = np.array(centres[done:])
            sums = sorted(tuple(r) for r in _each_task(held, "part int, n long, total double", _summed(fresh)).collect())  # a row a task
            total = sum(s[2] for s in sums)
            # Without a centre yet every row weighs one, and the draw names the row floor(u * n).
            even = not centres or total <= 0
            goal, strict = u * (n if even else total), even
            for part, rows, gaps in sums[:-1]:
                weight = float(rows) if even else gaps
                if weight > goal or (not strict and weight >= goal):
                    break
                goal -= weight
            else:
                part = sums[-1][0]
            # Collected, not first(): a limit would stop the Python worker, and the next job would start another.
            (found,) = _each_task(held.where(F.col("part") == part), "v array<double>", _drawn(fresh, goal, even)).collect()
            centres.append(np.array(found["v"]))
            if len(centres) - done >= FRESH and len(centres) < self.params.k:
                lower = _lowered(held, np.array(centres[done:])).persist()
                lower.count()
                if held is not blocks:
                    held.unpersist()
                held, done = lower, len(centres)
        if held is not blocks:
            held.unpersist()
        return np.array(centres)

    def fit_blocks(self, vectors: DataFrame, blocks: DataFrame, centres: np.ndarray) -> int:
        """fit() from the given first centres, over ``in_blocks(vectors)``."""
        p = self.params
        rounds, last = 0, None
        while rounds < p.max_iters:
            rounds += 1
            parts = _each_task(blocks, "cid int, n long, moved long, sums binary", _moved(centres, last))
            totals = parts.groupBy("cid").applyInArrow(_added, "cid int, n long, moved long, sums binary").collect()  # k rows
            new = centres.copy()
            for r in totals:
                new[r["cid"]] = np.frombuffer(r["sums"]) / r["n"]
            bare = sorted(set(range(p.k)) - {r["cid"] for r in totals})
            if p.empty == "farthest" and bare:
                far = _each_task(blocks, "id long, gap double, v array<double>", _farthest(centres, len(bare)))
                for c, r in zip(bare, far.orderBy(F.desc("gap"), "id").limit(len(bare)).collect()):
                    new[c] = r["v"]
            unchanged = last is not None and sum(r["moved"] for r in totals) == 0
            shift = float(np.sqrt(((new - centres) ** 2).sum(axis=1)).sum())
            last, centres = centres, new
            if unchanged or shift < p.tol:
                break
        self._centres, self._assigned_by = centres, last
        self._labels = assigned(vectors, last).select("id", "cid")
        return rounds


def fit_all(vectors: DataFrame, ks: list[int], params: KMeansParams, local_rows: int = 0) -> list[KMeans]:
    """A clustering for each k. The draws of fewer centres are the first of those of more, so one seeding by
    k-means++ and one packing of the rows serve all."""
    every = [KMeans(replace(params, k=k), local_rows) for k in ks]
    n = vectors.count()
    if not ks or params.init == "random" or n <= local_rows or max(ks) > n:
        for means in every:
            means.fit(vectors)
        return every
    blocks = in_blocks(vectors).persist()
    seeds = KMeans(replace(params, k=max(ks)))._spread(blocks, n)
    for means in every:
        means.fit_blocks(vectors, blocks, seeds[:means.params.k].copy())
    blocks.unpersist()
    return every


def in_blocks(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """Blocks of (id, vec) in the order of ids: part (the task that packed them), and low (each row's squared
    distance from the centres so far), which is null at first."""
    tasks = max(1, -(-vectors.count() // (TASK_BLOCKS * block)))
    ordered = vectors.select(F.col("id").cast("long").alias("id"), "vec").repartitionByRange(tasks, "id").sortWithinPartitions("id")
    return packed(ordered, "id", "vec", block).select(F.spark_partition_id().alias("part"), "ids", "vectors", "dim", F.lit(None).cast("binary").alias("low"))


def _each_task(blocks: DataFrame, schema: str, work) -> DataFrame:
    """mapInArrow where ``work`` takes an iterator of (part, ids, x, low) over a task's blocks and yields rows."""
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches):
        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    part, ids, vectors, dim, low = (batch.column(c)[i].as_py() for c in range(5))
                    yield (part, *unpacked(ids, vectors, dim), None if low is None else np.frombuffer(low))

        for row in work(rows()):
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, out)], schema=out)

    return blocks.select("part", "ids", "vectors", "dim", "low").mapInArrow(run, schema)


def _gaps(x: np.ndarray, low: np.ndarray | None, fresh: np.ndarray) -> np.ndarray:
    """Squared distances from the nearest centre: that of the running minima or a fresh one."""
    if not len(fresh):
        return np.ones(len(x)) if low is None else low
    near = assign(x, fresh)[1]
    return near if low is None else np.minimum(low, near)


def _summed(fresh: np.ndarray):
    def work(rows):
        at, n, total = None, 0, 0.0
        for part, _, x, low in rows:
            at, n, total = part, n + len(x), total + float(_gaps(x, low, fresh).sum())
        if at is not None:
            yield at, n, total

    return work


def _drawn(fresh: np.ndarray, goal: float, even: bool):
    """The row at which the running sum reaches ``goal`` (of rows of weight one: passes it)."""

    def work(rows):
        left, found, reached = goal, None, False
        for _, _, x, low in rows:
            if reached:
                continue  # the input is read to its end, so that the worker serves the next job
            running = np.cumsum(np.ones(len(x)) if even else _gaps(x, low, fresh))
            at = int(np.searchsorted(running, left, side="right" if even else "left"))
            found, reached = x[min(at, len(x) - 1)], at < len(x)
            left -= running[-1]
        if found is not None:
            yield (found.tolist(),)

    return work


def _lowered(blocks: DataFrame, fresh: np.ndarray) -> DataFrame:
    """``blocks`` with the fresh centres in the running minima."""

    def work(rows):
        for part, ids, x, low in rows:
            yield part, ids.tobytes(), x.tobytes(), x.shape[1], _gaps(x, low, fresh).tobytes()

    return _each_task(blocks, KEPT, work)


def _moved(now: np.ndarray, old: np.ndarray | None):
    """Per centre of a task: rows, rows that came from another centre, and the sum of their vectors."""

    def work(rows):
        n, moved, sums = np.zeros(len(now), dtype=np.int64), np.zeros(len(now), dtype=np.int64), np.zeros(now.shape)
        for _, _, x, _ in rows:
            label = assign(x, now)[0]
            came = np.ones(len(x), dtype=bool) if old is None else label != assign(x, old)[0]
            n += np.bincount(label, minlength=len(now))
            moved += np.bincount(label[came], minlength=len(now))
            order = np.argsort(label, kind="stable")
            present, first = np.unique(label[order], return_index=True)
            sums[present] += np.add.reduceat(x[order], first, axis=0)
        for c in np.flatnonzero(n).tolist():
            yield c, int(n[c]), int(moved[c]), sums[c].tobytes()

    return work


def _added(parts: pa.Table) -> pa.Table:
    """One centre's rows of all tasks, added up."""
    sums = np.add.reduce([np.frombuffer(s) for s in parts["sums"].to_pylist()])
    columns = {"cid": parts["cid"][:1], "n": [sum(parts["n"].to_pylist())], "moved": [sum(parts["moved"].to_pylist())], "sums": [sums.tobytes()]}
    return pa.table({name: pa.array(v.to_pylist() if name == "cid" else v, type=parts.schema.field(name).type) for name, v in columns.items()})


def _farthest(centres: np.ndarray, rows_wanted: int):
    """The task's rows farthest from their centres, ties to the smaller id."""

    def work(rows):
        ids, gaps, vectors = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, centres.shape[1]))
        for _, i, x, _ in rows:
            ids, gaps, vectors = np.concatenate((ids, i)), np.concatenate((gaps, assign(x, centres)[1])), np.concatenate((vectors, x))
            best = np.lexsort((ids, -gaps))[:rows_wanted]
            ids, gaps, vectors = ids[best], gaps[best], vectors[best]
        yield from zip(ids.tolist(), gaps.tolist(), vectors.tolist())

    return work

"""Silhouette scores from Euclidean distances.

Vectors are packed into blocks, which are dealt to lanes. Every two lanes meet once, in one group, and both sides of a
distance are served by it: a group hands on k numbers per row of its lanes, never a pair of rows. Beyond ``DENSE``
clusters, and for a sample of rows, blocks meet in cells and hand on a row per (row, cluster).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import cells, packed, unpacked
from ..functions.kernels import exact_distances, paired_distances
from ..plans.session import materialised
from .kmeans import sampled

#: Clusters, of all clusterings together, up to which sums are kept as a matrix.
DENSE = 1024
#: Lanes to which blocks are dealt (where there are so many blocks), and blocks of a lane beyond which there are more lanes.
LANES = 16
LANE_BLOCKS = 64
#: The mean distance to other clusters where there are none.
UNBOUNDED = 3.4028234663852886e38


class Silhouette:
    """singleton_zero: score a cluster's only row 0, as textbooks do, in place of 1.

    Scores of all rows need the distances of all pairs, which no plan avoids. ``sample`` scores so
    many rows only, chosen by the seeded order of ids, each by its distances to all rows: the work
    then grows in proportion to the rows.
    """

    def __init__(self, singleton_zero: bool = False, sample: int | None = None, seed: int = 1):
        self.singleton_zero, self.sample, self.seed = singleton_zero, sample, seed

    def sums(self, vectors: DataFrame, labels: DataFrame) -> DataFrame:
        """(id, cid, other, n, total): for each row and cluster the number of the cluster's other
        members and the sum of distances to them."""
        marked = vectors.select("id", "vec").join(labels, "id").select("id", "vec", F.array("cid").alias("cids"))
        return self.sums_of_all(marked, 1).drop("which")

    def sums_of_all(self, labelled: DataFrame, clusterings: int) -> DataFrame:
        """(which, id, cid, other, n, total) of (id, vec, cids): sums() for each of so many clusterings, from one
        pass over the distances."""
        # Labels travel as leading components of the vector, so that blocks stay matrices.
        marked = labelled.select("id", F.concat(F.col("cids").cast("array<double>"), F.col("vec").cast("array<double>")).alias("vec"))
        blocks = packed(marked, "id", "vec").persist()
        scored = blocks if self.sample is None else packed(sampled(marked, self.sample, self.seed), "id", "vec")

        def work(q_ids, q, ids, x):
            dist = exact_distances(q[:, clusterings:], x[:, clusterings:])
            own = q_ids[:, None] == ids[None, :]
            for which in range(clusterings):
                present, place = np.unique(x[:, which].astype(np.int64), return_inverse=True)
                member = np.zeros((len(x), len(present)))
                member[np.arange(len(x)), place] = 1
                totals, counts, same = dist @ member, member.sum(axis=0).astype(np.int64), (own @ member).astype(np.int64)
                for i in range(len(q)):
                    for c, other in enumerate(present.tolist()):
                        yield which, int(q_ids[i]), int(q[i, which]), other, int(counts[c] - same[i, c]), float(totals[i, c])

        parts = cells(blocks, scored, "which int, id long, cid int, other int, n long, total double", work)
        return parts.groupBy("which", "id", "cid", "other").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))

    def compute_all(self, labelled: DataFrame, clusterings: int) -> DataFrame:
        """(which, silhouette) of (id, vec, cids): the mean score of each clustering."""
        return self._scores_of_all(labelled, clusterings).groupBy("which").agg(F.avg("s").alias("silhouette"))

    def compute_per_point(self, vectors: DataFrame, labels: DataFrame) -> DataFrame:
        """(id, cid, s). With one cluster b is taken as unbounded, so s is 1 where a > 0."""
        marked = vectors.select("id", "vec").join(labels, "id").select("id", "vec", F.array("cid").alias("cids"))
        return self._scores_of_all(marked, 1).drop("which")

    def _scores_of_all(self, labelled: DataFrame, clusterings: int) -> DataFrame:
        """(which, id, cid, s) of (id, vec, cids)."""
        counted = labelled.select(F.posexplode("cids").alias("which", "cid")).groupBy("which", "cid").agg(F.count(F.lit(1)).alias("n"))
        sizes = [] if self.sample is not None else sorted(map(tuple, counted.limit(DENSE + 1).collect()))
        if not 0 < len(sizes) <= DENSE:
            return self._scores(self.sums_of_all(labelled, clusterings), "which")
        marked = labelled.select("id", F.concat(F.col("cids").cast("array<double>"), F.col("vec").cast("array<double>")).alias("vec"))
        blocks = materialised(packed(marked, "id", "vec").withColumn("block", F.monotonically_increasing_id()), "silhouette")
        n = blocks.count()
        lanes = max(1, min(n, max(LANES, -(-n // LANE_BLOCKS))))
        lane = F.pmod(F.xxhash64("block"), F.lit(lanes)).cast("int")
        dealt = blocks.withColumn("lane", lane).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
        dealt = dealt.select(F.least("lane", "other").alias("i"), F.greatest("lane", "other").alias("j"), "lane", "block", "ids", "vectors", "dim")
        groups = dealt.repartition(lanes * (lanes + 1) // 2, "i", "j").groupBy("i", "j")
        parts = groups.applyInArrow(_met_lanes([s[:2] for s in sizes], clusterings), "block long, ids binary, labels binary, totals binary")
        return parts.groupBy("block").applyInArrow(_scored(sizes, clusterings, self.singleton_zero), "which int, id long, cid int, s double")

    def _scores(self, sums: DataFrame, *keys: str) -> DataFrame:
        own, far = F.col("other") == F.col("cid"), F.col("other") != F.col("cid")
        mean = F.when(F.col("n") > 0, F.col("total") / F.col("n"))
        ab = sums.groupBy(*keys, "id", "cid").agg(
            F.coalesce(F.max(F.when(own, mean)), F.lit(0.0)).alias("a"),
            F.max(F.when(own, F.col("n"))).alias("peers"),
            F.coalesce(F.min(F.when(far, mean)), F.lit(UNBOUNDED)).alias("b"),
        )
        s = F.when(F.col("a") < F.col("b"), 1 - F.col("a") / F.col("b")).when(F.col("a") > F.col("b"), F.col("b") / F.col("a") - 1).otherwise(0.0)
        if self.singleton_zero:
            s = F.when(F.col("peers") == 0, 0.0).otherwise(s)
        return ab.select(*keys, "id", "cid", s.alias("s"))

    def compute_per_cluster(self, vectors: DataFrame, labels: DataFrame, k: int) -> DataFrame:
        """(cid, s) of clusters 0 to k - 1; NaN for an empty one."""
        per = self.compute_per_point(vectors, labels).groupBy("cid").agg(F.avg("s").alias("s"))
        every = vectors.sparkSession.range(k).select(F.col("id").cast("int").alias("cid"))
        return every.join(per, "cid", "left").select("cid", F.coalesce("s", F.lit(float("nan"))).alias("s"))

    def compute(self, vectors: DataFrame, labels: DataFrame) -> DataFrame:
        """One row (silhouette): the mean score, 0 without rows."""
        return self.compute_per_point(vectors, labels).agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("silhouette"))


def _met_lanes(clusters: list[tuple[int, int]], clusterings: int):
    """Two lanes' blocks (or one lane's among themselves), each pair once: sums of distances of every row to every one of
    ``clusters`` (which, cid) over the rows of the lanes."""
    place = [np.array([c for w, c in clusters if w == which]) for which in range(clusterings)]
    first = np.cumsum([0, *map(len, place)])

    def work(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        held = []
        for row in range(table.num_rows):
            lane, block, ids, vectors, dim = (table[c][row].as_py() for c in ("lane", "block", "ids", "vectors", "dim"))
            x = unpacked(ids, vectors, dim)[1]
            labels = x[:, :clusterings].astype(np.int64)
            member = np.zeros((len(x), len(clusters)))
            for which in range(clusterings):
                member[np.arange(len(x)), first[which] + np.searchsorted(place[which], labels[:, which])] = 1
            held.append((lane, block, ids, labels, member, np.ascontiguousarray(x[:, clusterings:]), np.zeros(member.shape)))
        for a, one in enumerate(held):
            for b, two in enumerate(held):
                if (one[0], two[0]) != (i, j) or (i == j and b < a):
                    continue
                dist = paired_distances(one[5], two[5])
                one[6][:] += dist @ two[4]
                if a != b:
                    two[6][:] += dist.T @ one[4]
        columns = {"block": [h[1] for h in held], "ids": [h[2] for h in held], "labels": [h[3].tobytes() for h in held], "totals": [h[6].tobytes() for h in held]}
        return pa.table({c: pa.array(v, pa.int64() if c == "block" else pa.binary()) for c, v in columns.items()})

    return work


def _scored(sizes: list[tuple[int, int, int]], clusterings: int, singleton_zero: bool):
    """A block's scores of its sums over all lanes."""

    def work(table: pa.Table) -> pa.Table:
        ids = np.frombuffer(table["ids"][0].as_py(), dtype=np.int64)
        labels = np.frombuffer(table["labels"][0].as_py(), dtype=np.int64).reshape(len(ids), clusterings)
        totals = np.zeros((len(ids), len(sizes)))
        for part in table["totals"]:
            totals += np.frombuffer(part.as_py()).reshape(totals.shape)
        rows, out = np.arange(len(ids)), []
        for which in range(clusterings):
            mine = [p for p, s in enumerate(sizes) if s[0] == which]
            counts = np.array([sizes[p][2] for p in mine])
            own = np.searchsorted(np.array([sizes[p][1] for p in mine]), labels[:, which])
            peers, mean = counts[own] - 1, totals[:, mine] / counts
            a = np.where(peers > 0, totals[:, mine][rows, own] / np.maximum(peers, 1), 0.0)
            mean[rows, own] = np.inf
            b = np.minimum(mean.min(axis=1), UNBOUNDED)
            s = np.zeros(len(ids))
            s[a < b] = 1 - a[a < b] / b[a < b]
            s[a > b] = b[a > b] / a[a > b] - 1
            if singleton_zero:
                s[peers == 0] = 0.0
            out.append(pa.table({"which": pa.array(np.full(len(ids), which), pa.int32()), "id": pa.array(ids), "cid": pa.array(labels[:, which], pa.int32()), "s": pa.array(s)}))
        return pa.concat_tables(out)

    return work

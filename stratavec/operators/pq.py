"""Product quantisation, and inverted files of quantised residuals.

A vector's parts are replaced by the nearest codewords of their codebooks. All codebooks are trained
in one job, a group for each part, on a sample of bounded size. A search packs the codes of each list into
blocks of bytes; queries travel as vectors to the lists that they read (a long list is cut into shards) and
make there their tables of squared distances to every codeword. The distance of a row is the sum of the table
entries of its codes, gathered for a whole block at once: squared, and not ranked again by exact vectors
unless a search asks for it (``rerank``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import cells, map_matrix, packed_by, packed_codes
from ..functions.kernels import assign, lloyd, seed_centres
from ..functions.vec import splits
from ..plans.draws import uniforms
from ..plans.params import IvfParams, PqParams
from ..plans.sizes import broadcast_if_small
from .base import Index
from .ivf import CoarseQuantizer
from .kmeans import sampled, spark_centres
from .search import KNN, measured, top_n


def train_part(x: np.ndarray, part: int, p: PqParams) -> np.ndarray:
    """The codebook of one part. Fewer rows than codewords train as many clusters as there are rows
    (two at least), repeated in order up to the number of codewords."""
    k = min(p.codes, max(2, len(x)))
    if len(x) < k:
        x = np.resize(x, (k, x.shape[1]))
    start = x[seed_centres(x, uniforms(p.seed + part, k))]
    words = lloyd(x, start, p.max_iters, p.tol, p.empty)[0]
    return words[np.arange(p.codes) % k]


class ProductQuantizer:
    def __init__(self, params: PqParams = PqParams()):
        self.params = params
        self.codebooks: list[np.ndarray] = []

    def set_dimension_splits(self, dim: int) -> list[tuple[int, int]]:
        """(start, size) of each part."""
        self.splits = splits(dim, self.params.parts)
        return self.splits

    def train(self, residuals: DataFrame) -> "ProductQuantizer":
        """Codebooks from (id, vec): one group per part, of at most ``sample`` rows each."""
        p = self.params
        rows = residuals.count()
        if not rows:
            raise ValueError("a product quantizer needs residuals to train on")
        if rows > p.sample:
            residuals = sampled(residuals, p.sample, p.seed)
        dim = residuals.select(F.size("vec").alias("dim")).first()["dim"]
        cut = self.set_dimension_splits(dim)
        pieces = F.array(*[F.struct(F.lit(m).alias("m"), F.slice(F.col("vec").cast("array<double>"), a + 1, n).alias("sub")) for m, (a, n) in enumerate(cut)])
        parts = residuals.select("id", F.explode(pieces).alias("x")).select("id", "x.m", "x.sub")

        def learn(pdf):
            import pandas as pd

            pdf = pdf.sort_values("id")
            m = int(pdf["m"].iloc[0])
            x = np.array(pdf["sub"].tolist(), dtype=np.float64).reshape(len(pdf), cut[m][1])
            words = train_part(x, m, p)
            return pd.DataFrame({"m": [m] * len(words), "code": range(len(words)), "c": list(words)})

        learnt = parts.groupBy("m").applyInPandas(learn, "m int, code int, c array<double>").collect()  # parts x codes rows
        books: list[list] = [[None] * p.codes for _ in cut]
        for r in learnt:
            books[r["m"]][r["code"]] = r["c"]
        self.codebooks = [np.array(b, dtype=np.float64).reshape(p.codes, cut[m][1]) for m, b in enumerate(books)]
        return self

    def table(self, spark) -> DataFrame:
        """(m, code, c)"""
        return spark.createDataFrame([(m, i, [float(v) for v in c]) for m, b in enumerate(self.codebooks) for i, c in enumerate(b)], "m int, code int, c array<double>")

    def codes_of(self, x: np.ndarray) -> np.ndarray:
        """The nearest codeword of each part (the first of equals) of each row."""
        return np.stack([assign(x[:, a:a + n], b)[0] for (a, n), b in zip(self.splits, self.codebooks)], axis=1)

    def encode(self, residuals: DataFrame) -> DataFrame:
        """(id, codes) of (id, vec)"""
        own = self

        def work(columns, x):
            return {"id": columns["id"], "codes": own.codes_of(x).tolist()}

        return map_matrix(residuals.select(F.col("id").cast("long").alias("id"), "vec"), "vec", "id long, codes array<int>", work)

    def tables_of(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of each row's parts to all codewords: rows x parts x codes."""
        out = np.empty((len(x), len(self.splits), self.params.codes))
        for m, ((a, n), book) in enumerate(zip(self.splits, self.codebooks)):
            for i, word in enumerate(book):
                d = x[:, a:a + n] - word
                out[:, m, i] = (d * d).sum(axis=1)
        return out

    def compute_lut(self, residuals: DataFrame) -> DataFrame:
        """``residuals`` (.., vec) with column lut: for each part the squared distances to its codewords."""
        own = self
        rest = [f for f in residuals.schema if f.name != "vec"]

        def work(columns, x):
            return {**{f.name: columns[f.name] for f in rest}, "lut": own.tables_of(x).tolist()}

        typed = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rest], "lut array<array<double>>"])
        return map_matrix(residuals, "vec", typed, work)

    @staticmethod
    def adc_distance(lut, codes):
        """The squared distance that a table gives to a code, as a column."""
        chosen = F.zip_with(lut, codes, lambda row, code: F.get(row, code))
        return F.aggregate(chosen, F.lit(0.0), lambda s, x: s + x)


class IVFPQ(Index):
    """Distances are squared (column adc); ``range_search`` compares them with the radius as it is,
    or with its square where ``squared_radius`` is set."""

    measure = "adc"

    def __init__(self, params: IvfParams = IvfParams(), pq: PqParams = PqParams()):
        self.params, self.pq_params = params, pq
        self.rows: DataFrame | None = None

    def residuals(self, vectors: DataFrame) -> DataFrame:
        """(id, vec, cid): vec is the residual to the row's centre."""
        centres = self.coarse.centres

        def work(columns, x):
            label = assign(x, centres)[0]
            return {"id": columns["id"], "vec": (x - centres[label]).tolist(), "cid": label}

        return map_matrix(vectors.select(F.col("id").cast("long").alias("id"), "vec"), "vec", "id long, vec array<double>, cid int", work)

    def build_index(self, vectors: DataFrame) -> "IVFPQ":
        self.vectors = vectors
        self.coarse = CoarseQuantizer(self.params)
        self.coarse.train(vectors)
        self.pq = ProductQuantizer(self.pq_params)
        if not len(self.coarse.centres):
            self.rows = vectors.select(F.lit(0).alias("cid"), "id", F.array().cast("array<int>").alias("codes"))
            return self
        self.pq.train(self.residuals(vectors).select("id", "vec"))
        self.rows = self.encoded(vectors)
        return self

    def encoded(self, vectors: DataFrame) -> DataFrame:
        """(cid, id, codes) of (id, vec), by the trained centres and codebooks."""
        pq = self.pq

        def work(columns, x):
            return {"cid": columns["cid"], "id": columns["id"], "codes": pq.codes_of(x).tolist()}

        return map_matrix(self.residuals(vectors), "vec", "cid int, id long, codes array<int>", work)

    @property
    def nlist(self) -> int:
        return len(self.coarse.centres)

    @property
    def nprobe(self) -> int:
        return self.params.nprobe

    def centroids(self) -> DataFrame:
        return spark_centres(self.vectors.sparkSession, self.coarse.centres)

    def candidates(self, queries: DataFrame) -> DataFrame:
        """(qid, id, vec) by the lists alone; the exact vectors come from the data by id."""
        return self.query_candidates(queries).join(self.vectors.select("id", "vec"), "id").select("qid", "id", "vec")

    def query_candidates(self, queries: DataFrame) -> DataFrame:
        probes = self.coarse.probes(queries).select("qid", "cid")
        return self.named(probes).join(broadcast_if_small(probes), "cid").select("qid", "id")

    def lut(self, queries: DataFrame) -> DataFrame:
        """(qid, cid, lut) for every list that a query reads."""
        centres = self.coarse.centres
        if not len(centres):
            return queries.select("qid", F.lit(0).alias("cid"), F.array().cast("array<array<double>>").alias("lut")).limit(0)

        def shift(columns, x):
            cid = np.asarray(columns["cid"], dtype=np.int64)
            return {"qid": columns["qid"], "cid": columns["cid"], "vec": (x - centres[cid]).tolist()}

        moved = map_matrix(self.coarse.probes(queries), "qvec", "qid long, cid int, vec array<double>", shift)
        return self.pq.compute_lut(moved)

    def _tabled(self, queries: DataFrame, pick) -> DataFrame:
        """(qid, id, dist) of what ``pick(own id, ids, distances)`` takes of each query and block of codes."""
        probes = self.coarse.probes(queries)
        if not len(self.coarse.centres):
            return probes.select(F.col("qid").cast("long").alias("qid"), F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("dist")).limit(0)
        pq, centres, code = self.pq, self.coarse.centres, np.dtype(np.uint8 if self.pq_params.bits <= 8 else np.uint16)

        def work(q_ids, q, ids, codes, cid):
            places = np.arange(codes.shape[1])[:, None]
            for i, lut in zip(q_ids.tolist(), pq.tables_of(q - centres[cid])):
                dist = lut[places, codes.T].sum(axis=0)
                at = pick(i, ids, dist)
                yield from zip([i] * len(at), ids[at].tolist(), dist[at].tolist())

        held = packed_codes(self.named(probes), "id", "codes", "cid", code)
        return cells(held, packed_by(probes, "qid", "qvec", "cid"), KNN, work, "cid", code)

    def adc(self, queries: DataFrame, exclude_self: bool = False) -> DataFrame:
        """(qid, id, adc) of all candidates. A row is in one list, so no pair repeats."""
        found = self._tabled(queries, lambda own, ids, dist: np.flatnonzero(ids != own) if exclude_self else np.arange(len(ids)))
        return found.withColumnRenamed("dist", "adc")

    def _short(self, queries: DataFrame, n: int, exclude_self: bool) -> DataFrame:
        """(qid, rank, id, dist): the n nearest by table distance; a block hands on n rows a query."""

        def pick(own, ids, dist):
            order = np.lexsort((ids, np.round(dist, 9)))
            return (order[ids[order] != own] if exclude_self else order)[:n]

        return top_n(self._tabled(queries, pick), n)

    def knn_query(self, queries: DataFrame, n: int, exclude_self: bool = False, rerank: int | None = None) -> DataFrame:
        """(qid, rank, id, dist), dist being the squared table distance. With ``rerank``, the so many
        nearest by table distance are ranked by their exact vectors, and dist is their distance."""
        if rerank is None:
            return self._short(queries, n, exclude_self)
        short = self._short(queries, max(n, rerank), exclude_self).select("qid", "id")
        return top_n(measured(self.vectors.select("id", "vec").join(broadcast_if_small(short), "id"), queries), n)

    def range_search(self, queries: DataFrame, radius: float, exclude_self: bool = False, squared_radius: bool = False) -> DataFrame:
        limit = radius * radius if squared_radius else radius
        return self.adc(queries, exclude_self).where(F.col("adc") <= F.lit(float(limit))).withColumnRenamed("adc", "dist")

"""The cube where queries visit most rows: answers come block by block, no pair is handed on that is not an answer."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavec.operators.base import Index
from stratavec.operators.cube import Hypercube
from stratavec.plans.params import CubeParams
from stratavec.sources import indexes


@pytest.mark.parametrize("kept,cap,bits", [(False, 10**6, "hash"), (True, 30, "hash"), (False, 30, "twister")])
def test_common_vertices_are_searched_by_blocks(spark, tmp_path, monkeypatch, kept, cap, bits):
    x = np.random.default_rng(5).standard_normal((90, 6))
    x[50:60] = x[:10]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    q = v.where("id % 30 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    index = Hypercube(6, CubeParams(4, 4.0, cap, 11, seed=1, bits=bits)).build_index(v)
    base = [sorted(map(tuple, f(index).collect())) for f in (lambda i: Index.knn_query(i, q, 4, True), lambda i: Index.range_search(i, q, 2.5, True))]
    if kept:
        indexes.write_index(index, f"{tmp_path}/i", 2)
        index = indexes.read_index(spark, f"{tmp_path}/i")

    def no_pairs(*_):
        raise AssertionError("pairs were brought together")

    monkeypatch.setattr(Hypercube, "candidates", no_pairs)
    for want, found in zip(base, (index.knn_query(q, 4, True), index.range_search(q, 2.5, True))):
        got = sorted(map(tuple, found.collect()))
        assert len(got) == len(want) > 0
        assert all(a[:-1] == b[:-1] and abs(a[-1] - b[-1]) < 1e-12 for a, b in zip(got, want))
    assert index.nn_query(q).count() == 3

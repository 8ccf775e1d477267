"""Exact search by bounds, and neighbour descent, against all distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavec.functions import blocks
from stratavec.operators.bounded import BoundedSearch
from stratavec.operators.descent import DescentParams, neighbour_descent
from stratavec.operators.search import exact_knn
from stratavec.plans.params import IvfParams


def frame(spark, x):
    return spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "id long, vec array<double>").persist()


def asked(v, every=7):
    return v.where(F.col("id") % every == 0).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


@pytest.mark.parametrize("exclude", [False, True])
def test_bounded_search_equals_the_scan(spark, exclude, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.standard_normal((60, 3)) + 9 * i for i in range(6)] + [np.ones((30, 3))])  # clusters, and copies
    v = frame(spark, x)
    index = BoundedSearch(IvfParams(clusters=8, nprobe=1)).build_index(v)
    want = sorted(map(tuple, exact_knn(v, asked(v), 6, exclude).collect()))
    assert sorted(map(tuple, index.knn_query(asked(v), 6, exclude).collect())) == want
    assert 0 < index.share_read(asked(v), 6, exclude) < 0.6
    monkeypatch.setattr(blocks, "SMALL_BLOCKS", 0)
    assert sorted(map(tuple, index.knn_query(asked(v), 6, exclude).collect())) == want


def test_lists_with_fewer_rows_than_asked_for(spark):
    v = frame(spark, np.array([[0.0], [0.1], [5.0], [50.0], [51.0]]))
    index = BoundedSearch(IvfParams(clusters=4, nprobe=1)).build_index(v)
    for n in (1, 3, 9):
        assert sorted(map(tuple, index.knn_query(asked(v, 1), n).collect())) == sorted(map(tuple, exact_knn(v, asked(v, 1), n).collect()))
    assert BoundedSearch(IvfParams(clusters=4)).build_index(v.limit(0)).knn_query(asked(v), 2).collect() == []


def test_descent_finds_the_graph_below_all_pairs(spark):
    x = np.random.default_rng(8).uniform(0, 100, (1200, 3))
    v = frame(spark, x)
    found = neighbour_descent(v, 6)
    edges = found.edges.collect()
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(near, np.inf)
    true = np.argsort(near, axis=1)[:, :6]
    hits = sum(e["dst"] in true[e["src"]] for e in edges)
    assert len(edges) == 1200 * 6 and hits >= 0.9 * len(edges)
    assert found.distances < 1200 * 1199 / 2
    assert all(e["src"] != e["dst"] and abs(e["dist"] - near[e["src"], e["dst"]]) < 1e-9 for e in edges)
    assert {(e["src"], e["rank"]) for e in edges} == {(i, r) for i in range(1200) for r in range(1, 7)}


def test_descent_of_small_and_hub_like_tables(spark):
    few = frame(spark, np.array([[0.0], [1.0], [3.0]]))
    assert sorted((e["src"], e["rank"], e["dst"]) for e in neighbour_descent(few, 5, DescentParams(group=8)).edges.collect()) == [(0, 1, 1), (0, 2, 2), (1, 1, 0), (1, 2, 2), (2, 1, 1), (2, 2, 0)]
    assert neighbour_descent(few.limit(0), 3).edges.collect() == []
    # One row is the nearest of all others, which are equally far from each other: its in-edges are sampled, so what
    # meets there stays bounded, while most rows get to know of it only by chance.
    star = frame(spark, np.concatenate([np.zeros((1, 300)), np.eye(300)]))
    found = neighbour_descent(star, 1, DescentParams(width=4, rounds=6))
    assert sum(e["dst"] == 0 for e in found.edges.where("src <> 0").collect()) >= 100
    assert found.distances < 301 * 300 / 2
    with pytest.raises(ValueError):
        DescentParams(group=1)


def test_lists_stay_as_small_as_the_table_grows(spark, monkeypatch):
    from stratavec.operators import bounded

    monkeypatch.setattr(bounded, "LIST_ROWS", 50)
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((1500, 2)), 2)
    x[1000:1200] = x[5]  # copies, which no cut parts
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    index = BoundedSearch(IvfParams(clusters=4, nprobe=1)).build_index(v)
    assert len(index.sizes) > 15 and index.sizes.sum() == 1500
    assert sorted(map(tuple, index.knn_query(asked(v), 6, True).collect())) == sorted(map(tuple, exact_knn(v, asked(v), 6, True).collect()))
    assert index.share_read(asked(v), 6, True) < 0.3  # of four lists a query would read one at least, most often two

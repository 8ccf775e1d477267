"""Neighbour descent within cells: rows are shuffled once a round, and single pairs only where cells keep neighbours apart."""

import numpy as np
import pytest

from stratavec.operators import descent


def recall(spark, x, k):
    v = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "id long, vec array<double>").persist()
    found = descent.neighbour_descent(v, k)
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(near, np.inf)
    last = np.sort(near, axis=1)[:, k - 1] + 1e-9
    edges = found.edges.collect()
    assert len({(e["src"], e["dst"]) for e in edges}) == len(edges) == len(x) * k
    assert found.distances < len(x) * (len(x) - 1) / 2
    assert all(abs(e["dist"] - near[e["src"], e["dst"]]) < 1e-9 for e in edges)
    return sum(e["dist"] <= last[e["src"]] for e in edges) / len(edges)


def test_near_rows_meet_without_joins_of_pairs(spark, monkeypatch):
    def no_pairs(*_):
        raise AssertionError("pairs were brought together by joins")

    monkeypatch.setattr(descent, "_round", no_pairs)
    monkeypatch.setattr(descent, "CELL_ROWS", 250, raising=False)
    x = np.random.default_rng(2).uniform(0, 100, (1500, 2)) * [1, 30]
    x[1200:1400] = x[:40].repeat(5, axis=0)  # copies
    assert recall(spark, x, 5) >= 0.95


@pytest.mark.parametrize("most", [65_536, 40])
def test_rows_that_cells_keep_apart_meet_by_joins(spark, monkeypatch, most):
    called = []
    inner = descent._round
    monkeypatch.setattr(descent, "CELL_ROWS", 60)
    monkeypatch.setattr(descent, "MAX_CELL_ROWS", most)  # larger cells are parted
    monkeypatch.setattr(descent, "_round", lambda *a: called.append(1) or inner(*a))
    x = np.random.default_rng(2).standard_normal((1500, 6))
    assert recall(spark, x, 4) >= 0.9 and called

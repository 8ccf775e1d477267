"""Nearest neighbours by the forest: exact where every candidate is wanted, recall where not, copies and odd rows."""

import math
import random

import numpy as np
import pytest

from stratavec.llm import hash_forest
from stratavec.llm.hash_forest import ForestSettings, ascend, nearest, ranges

EVERY = ForestSettings(k=4, query_modulus=3, trees=2, per_row=10.0)


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, row int, dim string")


def plainly(rows, k, modulus):
    valid = [(n, i, v) for n, (i, v) in enumerate(rows) if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, i, v in valid:
        if i % modulus == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, j, w in valid if m != n and len(w) == len(v))[:k]
            out += [(i, r + 1, j, s) for r, (s, j) in enumerate(found)]
    return sorted((i, r, j, round(-s, 9)) for i, r, j, s in out)


def found(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in df.collect())


def made(seed, count, dim=5):
    draw = random.Random(seed)
    return [(i, [float(draw.randrange(-4, 5)) for _ in range(dim)]) for i in range(count)]


def test_every_candidate_gives_the_exact_answer(spark):
    rows = [(i, v) for i, v in made(1, 160) if any(v)]
    assert found(nearest(table(spark, rows), EVERY)) == plainly(rows, 4, 3)


def test_many_blocks_and_small_shards_lose_no_candidate_of_a_shard(spark, monkeypatch):
    monkeypatch.setattr(hash_forest, "QUERY_BLOCKS", 1)
    rows = made(2, 300)
    settings = ForestSettings(k=3, query_modulus=3, trees=24, per_row=50.0, shard_entries=150)
    got, true = found(nearest(table(spark, rows), settings)), plainly(rows, 3, 3)
    assert len(set(got) & set(true)) >= 0.9 * len(true)


def test_copies_are_one_vector(spark):
    rows = [(i, [1.0, 2.0]) for i in range(90)] + [(i, [2.0, 1.0]) for i in range(90, 100)] + [(3, [1.0, 2.0]), (3, [5.0, 5.0]), (6, [-1.0, -2.0])]
    assert found(nearest(table(spark, rows), EVERY)) == plainly(rows, 4, 3)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (3, []), (6, [None, 1.0]), (9, [nan, 1.0]), (12, [inf, 1.0]), (15, [0.0, 0.0]), (None, [1.0, 1.0]), (18, [1.0, 1.0]), (21, [1.0]), (24, [2.0]),
            (27, [1.0, 1.0, 1.0]), (30, [1e8, 1e8]), (33, [1e-8, 0.0]), (-3, [3.0, -1.0]), (18, [1.0, 1.0])]
    assert found(nearest(table(spark, rows), EVERY)) == plainly(rows, 4, 3)
    assert nearest(table(spark, [])).collect() == []
    assert nearest(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 3.0])]), EVERY).collect() == []
    assert nearest(table(spark, [(3, [1.0, 2.0])]), EVERY).collect() == []


@pytest.mark.parametrize("norms", [(1.0, 1.0), (0.2, 3.0)])
def test_recall_of_near_random_vectors(spark, norms):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((6000, 16))
    x = x / np.linalg.norm(x, axis=1)[:, None] * rng.uniform(*norms, 6000)[:, None]
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    settings = ForestSettings(k=10, query_modulus=40, per_row=0.5)
    got = nearest(table(spark, rows), settings).collect()
    true = {q: set(np.lexsort((np.arange(6000), -np.where(np.arange(6000) == q, -np.inf, x @ x[q])))[:10].tolist()) for q in range(0, 6000, 40)}
    hits = sum(r["vec_id"] in true[r["query_id"]] for r in got)
    assert hits >= 0.9 * 10 * len(true)
    assert all(abs(r["score"] - float(x[r["query_id"]] @ x[r["vec_id"]])) < 1e-12 for r in got)


def test_ascent_stops_at_the_first_length_that_holds_enough():
    counts = np.array([[9, 4, 2, 1], [9, 5, 0, 0], [9, 3, 3, 1]])
    assert ascend(counts, 2).tolist() == [3, 3, 3]
    assert ascend(counts, 5).tolist() == [2, 2, 2]
    assert ascend(counts, 7).tolist() == [1, 2, 2]
    assert ascend(counts, 8).tolist() == [1, 1, 2]
    assert ascend(counts, 100).tolist() == [0, 0, 0]


def test_ranges_hold_equal_prefixes():
    codes = np.sort(np.random.default_rng(3).integers(0, 1 << hash_forest.BITS, 400))
    for level in (0, 1, 3, 8, 32):
        low, high = ranges(codes, codes[::7], level)
        for c, a, b in zip(codes[::7].tolist(), low.tolist(), high.tolist()):
            assert [x for x in codes.tolist() if x >> (32 - level) == c >> (32 - level)] == codes[a:b].tolist()

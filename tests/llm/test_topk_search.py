import random

import numpy as np

from stratavec.llm.topk_search import TreeSettings, top_k


def expected(rows, k=20):
    v = []
    for i, x in rows:
        if i is not None and x and not any(e is None for e in x) and np.isfinite(x).all():
            v.append((i, np.floor(64 * np.array(x, dtype=np.float32).astype(float))))
    out = []
    for n, (i, q) in enumerate(v):
        if i % 20 == 0:
            found = sorted((-int(q @ x), j) for m, (j, x) in enumerate(v) if m != n and len(x) == len(q))[:k]
            out += [(i, rank + 1, j, -s) for rank, (s, j) in enumerate(found)]
    return sorted(out)


def run(spark, rows, settings=TreeSettings()):
    df = spark.createDataFrame([(i, x, "v") for i, x in rows], "vec_id long, embedding array<float>, dim string")
    return sorted(map(tuple, top_k(df, settings).collect()))


def test_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.standard_normal(8) + 4 * (i % 3)).tolist()) for i in range(400)]
    assert run(spark, rows) == expected(rows)
    tight = TreeSettings(shard_rows=40, page_rows=6, query_block=5, sample_rows=100)
    assert run(spark, rows, tight) == expected(rows)


def test_copies_and_ties(spark):
    rng = random.Random(2)
    rows = [(i, [1.0, 0.5] if i % 3 == 0 else [rng.choice([-1.0, 0.0, 1.0]), rng.choice([0.0, 1.0])]) for i in range(300)]
    assert run(spark, rows, TreeSettings(shard_rows=32, page_rows=4)) == expected(rows)


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]), (80, [float("inf"), 1.0]), (None, [1.0, 1.0]), (100, []), (120, [1.0, 2.0, 3.0]),
            (1, [1.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0]), (140, [0.5, 0.5]), (140, [-0.5, 0.5]), (3, [1e6, -1e6])]
    assert run(spark, rows) == expected(rows)
    assert run(spark, []) == []
    assert run(spark, [(20, None)]) == []


def test_blocks_reach_only_shards_that_can_beat_their_scores(spark, monkeypatch):
    """Well separated subtrees: the second pass sends a block nowhere but to its own subtree."""
    from stratavec.llm import topk_search

    rng = np.random.default_rng(3)
    axes = 40 * np.eye(8)
    rows = [(i, (axes[i % 8] + rng.standard_normal(8)).tolist()) for i in range(1600)]
    pairs, visited = [], topk_search._visited

    def counted(index, asked, k):
        pairs.append({(r["route"], r["home"]) for r in asked.select("route", "home").collect()})
        return visited(index, asked, k)

    monkeypatch.setattr(topk_search, "_visited", counted)
    settings = TreeSettings(k=5, shard_rows=50, page_rows=10, query_block=4, sample_rows=800)
    assert run(spark, rows, settings) == expected(rows, 5)
    all_pairs = len({r for r, _ in pairs[1]}) * len({h for _, h in pairs[0]})
    assert len(pairs[1]) < 0.5 * all_pairs


def test_trees_are_never_broadcast(spark):
    """Copies make files of trees small and the trees themselves large; a broadcast would pass them through the driver."""
    rows = [(i, [1.0, 0.5] if i % 3 else [float(i % 7), 1.0]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    plan = top_k(df, TreeSettings(shard_rows=32, page_rows=4))._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan

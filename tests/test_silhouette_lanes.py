"""Silhouette sums by lanes: each pair of blocks once, by matrix products."""

import numpy as np
from pyspark.sql import functions as F

from stratavec.functions.kernels import exact_distances, paired_distances
from stratavec.operators.silhouette import Silhouette


def test_matrix_products_keep_copies_and_near_rows_apart():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 8)) + 1000
    q = np.concatenate((x[:10], x[10:20] + 1e-7, rng.standard_normal((5, 8))))
    want = exact_distances(q, x)
    got = paired_distances(q, x)
    assert (got[np.arange(10), np.arange(10)] == 0).all()
    assert np.allclose(got, want, rtol=1e-9, atol=0)


def test_scores_over_many_lanes(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((120, 4))
    x[60:80] = x[:20]
    labels = rng.integers(0, 5, 120)
    labels[7] = 9  # alone
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels))]
    table = spark.createDataFrame(rows, "id long, vec array<double>, cid int").repartition(20, "id")
    scored = Silhouette().compute_per_point(table.select("id", "vec"), table.select("id", "cid"))
    plan = scored._jdf.queryExecution().sparkPlan().toString()
    assert "FlatMapGroupsInArrow" in plan  # sums come as matrices, not as a row per row and cluster
    dist = exact_distances(x, x)
    for r in scored.collect():
        mine = labels == labels[r["id"]]
        a = dist[r["id"], mine].sum() / max(1, mine.sum() - 1)
        b = min(dist[r["id"], labels == c].mean() for c in set(labels.tolist()) - {labels[r["id"]]})
        assert abs(r["s"] - (1 - a / b if a < b else b / a - 1)) < 1e-12
    both = table.select("id", "vec", F.array("cid", F.lit(0)).alias("cids"))
    means = {r["which"]: r["silhouette"] for r in Silhouette().compute_all(both, 2).collect()}
    assert abs(means[0] - np.mean([r["s"] for r in scored.collect()])) < 1e-12 and means[1] == 1.0

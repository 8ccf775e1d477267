"""k-means by tasks: many blocks, running minima, and the assignment's shortlist."""

import numpy as np
import pytest

from stratavec.functions import kernels
from stratavec.operators import kmeans
from stratavec.operators.kmeans import KMeans
from stratavec.plans.draws import uniforms
from stratavec.plans.params import KMeansParams


def plain(x, centres):
    d = ((x[:, None, :] - centres[None]) ** 2).sum(axis=2)
    return d.argmin(axis=1), d.min(axis=1)


def test_assignment_equals_all_distances():
    rng = np.random.default_rng(2)
    for scale, shift in ((1, 0), (1e-6, 1e6), (3, -50)):
        x = rng.integers(-2, 3, (300, 3)) * scale + shift
        centres = rng.integers(-2, 3, (40, 3)) * scale + shift  # many centres repeat: the first of equals
        label, gap = kernels.assign(x, centres)
        want, best = plain(x, centres)
        assert np.array_equal(label, want) and np.allclose(gap, best)
    x = rng.standard_normal((500, 8))
    assert np.array_equal(kernels.assign(x, x[:60])[0], plain(x, x[:60])[0])
    assert [len(r) for r in kernels.assign(x[:0], x[:5])] == [0, 0] and kernels.assign(x, x[:0])[1].sum() == 0


def test_seeding_over_many_blocks_with_running_minima(spark, monkeypatch):
    x = np.random.default_rng(7).standard_normal((400, 4))
    df = spark.createDataFrame([(i * 3, r) for i, r in enumerate(x.tolist())], "id long, vec array<double>").repartition(5)
    own = kmeans.in_blocks
    monkeypatch.setattr(kmeans, "in_blocks", lambda v: own(v, 16))
    for fresh in (1, 3, 32):
        monkeypatch.setattr(kmeans, "FRESH", fresh)
        means = KMeans(KMeansParams(k=12, seed=5, max_iters=6, tol=0.0))
        assert np.array_equal(means.seeds_distributed(df, 400), x[kernels.seed_centres(x, uniforms(5, 12))])
    rounds = means.fit(df)
    centres, labels, want = kernels.lloyd(x, x[kernels.seed_centres(x, uniforms(5, 12))], 6, 0.0, "farthest")
    assert rounds == want and np.allclose(means.centroids(), centres)
    assert [r["cid"] for r in means.labels().orderBy("id").collect()] == labels.tolist()
    assert [r["cid"] for r in means.predict(df).orderBy("id").collect()] == plain(x, centres)[0].tolist()


def test_one_way_at_every_size(spark):
    """Without ``local_rows`` nothing is fitted on the driver."""
    df = spark.createDataFrame([(i, [float(i % 5)]) for i in range(40)], "id long, vec array<double>")
    means = KMeans(KMeansParams(k=5, seed=2))
    means._fit_local = None
    assert means.fit(df) >= 1
    assert sorted(means.centroids().ravel().tolist()) == [0.0, 1.0, 2.0, 3.0, 4.0]


@pytest.mark.parametrize("ks, local_rows", [([2, 5, 10], 0), ([2, 5, 10, 50, 100, 200, 500], 1000)])
def test_a_sweep_scores_all_k_from_one_pass(spark, monkeypatch, ks, local_rows):
    """The whole sweep on a small table, against plain code; distances are taken once."""
    from stratavec.operators import silhouette
    from stratavec.operators.ivf import sweep

    x = np.concatenate([np.random.default_rng(s).standard_normal((180, 3)) + 8 * s for s in range(3)])
    df = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "id long, vec array<double>")
    passes = []
    own = silhouette.cells
    monkeypatch.setattr(silhouette, "cells", lambda *a, **b: passes.append(1) or own(*a, **b))
    got = sweep(df, ks, KMeansParams(k=2, max_iters=4, tol=0.0, seed=42), local_rows)
    assert len(passes) == 1 and [k for k, _ in got] == ks
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for k, score in got:
        _, labels, _ = kernels.lloyd(x, x[kernels.seed_centres(x, uniforms(42, k))], 4, 0.0, "farthest")
        member = np.eye(k)[labels]
        size = member.sum(axis=0)
        total = near @ member
        others = size[labels] - 1
        a = np.where(others > 0, total[np.arange(len(x)), labels] / np.maximum(others, 1), 0)
        mean = np.where(size > 0, total / np.maximum(size, 1), np.inf)
        mean[np.arange(len(x)), labels] = np.inf
        b = mean.min(axis=1)
        s = np.where(a < b, 1 - a / b, np.where(a > b, b / np.maximum(a, 1e-300) - 1, 0))
        assert abs(s.mean() - score) < 1e-9, k

"""Indexes, clustering, evaluation and reports on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavec import cli
from stratavec.operators import evaluate, search, summary
from stratavec.operators.cube import Hypercube
from stratavec.operators.graph import graph_lines, knn_graph
from stratavec.operators.ivf import IVFFlat, choose_k
from stratavec.operators.kmeans import KMeans
from stratavec.operators.lsh import LSH
from stratavec.operators.pq import IVFPQ, ProductQuantizer
from stratavec.operators.silhouette import Silhouette
from stratavec.plans.params import CubeParams, IvfParams, KMeansParams, LshParams, PqParams
from stratavec.sources import reports

RNG = np.random.default_rng(11)
X = np.concatenate([RNG.standard_normal((40, 6)) + 6 * i for i in range(3)]).astype(np.float32)


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, vec array<float>").persist()


@pytest.fixture(scope="module")
def asked(data):
    return data.where("id % 10 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def pairs(df):
    return {(r["qid"], r["id"]) for r in df.collect()}


def indexes(data):
    return {
        "lsh": LSH(params=LshParams(3, 2, 4.0)).build_index(data),
        "cube": Hypercube(params=CubeParams(5, 4.0, 1000, 6)).build_index(data),
        "ivf": IVFFlat(IvfParams(4, 2)).build_index(data),
    }


def test_exact_engines_agree(data, asked):
    for own in (False, True):
        a = search.exact_knn(data, asked, 7, own).orderBy("qid", "rank").collect()
        b = search.exact_knn(data, asked, 7, own, engine="columns").orderBy("qid", "rank").collect()
        assert [(r["qid"], r["rank"], r["id"]) for r in a] == [(r["qid"], r["rank"], r["id"]) for r in b]
        assert np.allclose([r["dist"] for r in a], [r["dist"] for r in b])
    assert search.exact_knn(data, asked, 1000).count() == 12 * 120


def test_many_query_blocks_meet_by_lane(data, asked, monkeypatch):
    from stratavec.functions import blocks

    want = sorted(map(tuple, search.exact_knn(data, asked, 3).collect()))
    monkeypatch.setattr(blocks, "SMALL_BLOCKS", 0)
    assert sorted(map(tuple, search.exact_knn(data, asked, 3).collect())) == want


def test_hash_engines_agree(data):
    lsh = LSH(6, LshParams(3, 2, 1.0))
    cube = Hypercube(6, CubeParams(7, 1.0, 10, 4))
    for a, b in ((lsh.identified(data, "id", "vec"), lsh.identified(data, "id", "vec", "columns")), (cube.placed(data, "id", "vec"), cube.placed(data, "id", "vec", "columns"))):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_candidates_hold_answers_and_ranges_are_exact(data, asked):
    exact = pairs(search.exact_range(data, asked, 2.5))
    for index in indexes(data).values():
        candidates = pairs(index.query_candidates(asked))
        assert pairs(index.knn_query(asked, 5)) <= candidates
        assert pairs(index.range_search(asked, 2.5)) == exact & candidates


def test_full_probing_is_exact(data, asked):
    full = IVFFlat(IvfParams(4, 4)).build_index(data)
    want = search.exact_knn(data, asked, 5).select("qid", "rank", "id").collect()
    assert sorted(full.knn_query(asked, 5).select("qid", "rank", "id").collect()) == sorted(want)


def test_recall_does_not_fall_with_more_probes(data, asked):
    def recall(index):
        truth = search.exact_knn(data, asked, 5)
        return evaluate.quality(evaluate.per_query(index.knn_query(asked, 5), truth, asked, 5)).first()["recall_at_n"]

    values = [recall(IVFFlat(IvfParams(6, n)).build_index(data)) for n in (1, 3, 6)]
    assert values == sorted(values) and values[-1] == 1.0
    values = [recall(Hypercube(params=CubeParams(5, 4.0, 10**6, n)).build_index(data)) for n in (1, 6, 32)]
    assert values == sorted(values) and values[-1] == 1.0


def test_cube_stops_after_the_vertex_that_fills_up(data, asked):
    cube = Hypercube(params=CubeParams(4, 4.0, 5, 16)).build_index(data)
    fill = {r["vertex"]: r["count"] for r in cube.rows.groupBy("vertex").count().collect()}
    own = {r["qid"]: r["vertex"] for r in cube.placed(asked, "qid", "qvec").collect()}
    got: dict = {}
    for r in cube.probes(asked).orderBy("qid", "probe_no").collect():
        got.setdefault(r["qid"], []).append(r["vertex"])
    from stratavec.plans.draws import probe_masks

    for qid, at in own.items():
        want, total = [], 0
        for m in probe_masks(4, 16):
            if total >= 5:
                break
            want.append(at ^ m)
            total += fill.get(at ^ m, 0)
        assert got[qid] == want


def test_relaxed_nearest(data, asked):
    lsh = LSH(params=LshParams(2, 4, 0.5)).build_index(data)
    found = {r["qid"]: r["id"] for r in lsh.nn_query(asked, 0.1).collect()}
    far = data.limit(0).select(F.col("id").alias("qid"), "id", F.lit(0.0).alias("dist"))
    none = search.eps_nearest(data, asked, far).collect()
    assert {r["id"] for r in none} == {-1} and len(none) == len(found) == 12
    start = asked.select("qid", F.lit(119).cast("long").alias("id"), F.lit(1e9).alias("dist"))
    for r in search.eps_nearest(data, asked, start, 0.1).collect():
        d = np.sqrt(((X.astype(float) - X[r["qid"]].astype(float)) ** 2).sum(1))
        best, at = 1e9, 119
        for i, x in enumerate(d):
            if x < best / 1.1:
                best, at = x, i
        assert r["id"] == at


def test_kmeans_ways_agree(data):
    for init in ("k-means++", "random"):
        p = KMeansParams(5, 20, 1e-6, init, 3)
        near, far = KMeans(p), KMeans(p, local_rows=0)
        assert near.fit(data) == far.fit(data)
        assert np.allclose(near.centroids(), far.centroids())
        assert sorted(near.labels().collect()) == sorted(far.labels().collect())
    assert KMeans(p).predict(data).select("cid").distinct().first()["cid"] == -1
    with pytest.raises(ValueError):
        KMeans(KMeansParams(121)).fit(data)


def test_empty_clusters(spark):
    twins = spark.createDataFrame([(i, [float(i // 5), 0.0]) for i in range(10)], "id long, vec array<float>")
    for rows in (20_000, 0):
        means = KMeans(KMeansParams(4, 5, 0.0, empty="keep"), local_rows=rows)
        means.fit(twins)
        assert means.centroids().shape == (4, 2)


def test_empty_clusters_take_distinct_rows_both_ways(spark):
    points = [[0.0, 0.0]] * 60 + [[float(3 * i * i + 5), float(i)] for i in range(6)]
    copies = spark.createDataFrame(list(enumerate(points)), "id long, vec array<float>").persist()
    for rounds in (1, 10):
        p = KMeansParams(5, rounds, 0.0, "random", 1)
        near, far = KMeans(p), KMeans(p, local_rows=0)
        assert near.fit(copies) == far.fit(copies)
        assert np.allclose(near.centroids(), far.centroids())
        assert len(np.unique(far.centroids(), axis=0)) == 5


def test_silhouette_matches_definition(spark, data):
    labels = np.array([i // 40 for i in range(119)] + [3])
    frame = spark.createDataFrame([(i, int(c)) for i, c in enumerate(labels)], "id long, cid int")
    d = np.sqrt(((X[:, None].astype(float) - X[None].astype(float)) ** 2).sum(2))

    def score(i, singleton):
        mine = (labels == labels[i]) & (np.arange(120) != i)
        a = d[i, mine].mean() if mine.any() else 0.0
        b = min(d[i, labels == c].mean() for c in set(labels) - {labels[i]})
        if singleton and not mine.any():
            return 0.0
        return 1 - a / b if a < b else b / a - 1 if a > b else 0.0

    for zero in (False, True):
        got = {r["id"]: r["s"] for r in Silhouette(zero).compute_per_point(data, frame).collect()}
        assert np.allclose([got[i] for i in range(120)], [score(i, zero) for i in range(120)])
    per = Silhouette().compute_per_cluster(data, frame, 5).collect()
    assert len(per) == 5 and np.isnan({r["cid"]: r["s"] for r in per}[4])
    assert Silhouette().compute(data, frame.limit(0)).first()["silhouette"] == 0.0
    assert choose_k(data, IvfParams(0, max_iters=20)) == 3


def test_product_quantizer(data, asked):
    pq = ProductQuantizer(PqParams(3, 7)).train(data)
    x = X[::10].astype(float)
    codes, tables = pq.codes_of(x), pq.tables_of(x)
    adc = tables[np.arange(12)[:, None], np.arange(3), codes].sum(axis=1)
    assert (adc <= tables.min(axis=2).sum(axis=1) + 1e-12).all() and adc.max() < 1e-9  # a codeword for every row
    few = ProductQuantizer(PqParams(2, 3)).train(data.limit(3))
    assert len(few.codebooks[0]) == 8 and np.array_equal(few.codebooks[0][0], few.codebooks[0][3])
    index = IVFPQ(IvfParams(3, 3), PqParams(3, 7)).build_index(data)
    exact = {(r["qid"], r["id"]): r["dist"] for r in search.exact_knn(data, asked, 120).collect()}
    got = index.adc(asked).collect()
    assert len(got) == 12 * 120
    assert np.mean([abs(r["adc"] - exact[r["qid"], r["id"]] ** 2) for r in got]) < 0.5
    assert pairs(index.range_search(asked, 2.0, squared_radius=True)) == pairs(index.range_search(asked, 4.0))


def test_empty_data(spark, asked):
    nothing = spark.createDataFrame([], "id long, vec array<float>")
    for index in (LSH().build_index(nothing), Hypercube().build_index(nothing), IVFFlat().build_index(nothing), IVFPQ().build_index(nothing)):
        assert index.knn_query(asked, 3).count() == 0
    assert search.exact_knn(nothing, asked, 3).count() == 0


def test_scores_count_missing_answers(spark, asked, data):
    truth = search.exact_knn(data, asked, 2, exclude_self=True)
    got = search.top_n(truth.where("qid < 60").select("qid", "id", "dist"), 2)
    q = evaluate.quality(evaluate.per_query(got, truth, asked, 2)).first()
    assert q["avg_af"] == q["recall_at_n"] == 0.5 and q["af_found"] == 1.0 and q["n_found"] == 6


def test_graph(data):
    edges = knn_graph(IVFFlat(IvfParams(3, 3)).build_index(data), 3)
    lines = [r["line"].split(",") for r in graph_lines(edges).collect()]
    assert len(lines) == 120 and all(len(x) == 4 and x[0] == x[1] for x in lines)


def test_report_round_trip(spark, data, asked, tmp_path):
    index = indexes(data)["lsh"]
    run = evaluate.run_queries(index, data, asked, 3, 2.5, "lsh", "sift")
    hits = evaluate.with_true_distance(run.knn, data, asked)
    path = str(tmp_path / "results_lsh_sift_true.txt")
    reports.write_report(path, "LSH", reports.query_blocks(hits, asked, run.ranges), run.metrics)
    text = "".join(p.read_text() for p in sorted((tmp_path / "results_lsh_sift_true.txt").glob("part-*")))
    assert text.startswith("LSH\nQuery: 0\nNearest neighbor-1: 0\ndistanceApproximate: 0.000000\n") and text.count("R-near neighbors:") == 12
    m = run.metrics.first()
    rows = summary.parse_reports(spark.createDataFrame([("results_LSH_sift_true.txt", text), ("other.txt", "QPS: inf")], "name string, text string")).collect()
    assert rows[0][:3] == ("LSH", "SIFT", "True") and rows[0]["recall_at_n"] == pytest.approx(m["recall_at_n"], abs=1e-6)
    assert tuple(rows[1]) == ("Unknown", "Unknown", "Unknown", None, None, None, None, None)


def test_sweep_files(spark, tmp_path):
    scores = spark.createDataFrame([(2, 0.5), (5, 0.25)], "k int, silhouette double")
    for kind in ("sift", "mnist"):
        reports.write_sweep(scores, str(tmp_path / f"silhouette_results_{kind}.txt"))
    got = reports.read_sweeps(spark, [str(tmp_path / f"silhouette_results_{k}.txt") for k in ("sift", "mnist")])
    assert sorted(map(tuple, got.collect())) == [(2, 0.5, "mnist"), (2, 0.5, "sift"), (5, 0.25, "mnist"), (5, 0.25, "sift")]


def test_command_line(spark, tmp_path, caplog):
    import struct

    f = tmp_path / "sift.fvecs"
    rows = np.random.default_rng(4).standard_normal((60, 128)).astype("<f4")
    f.write_bytes(b"".join(struct.pack("<i", 128) + r.tobytes() for r in rows))
    out = str(tmp_path / "results_ivfflat_sift_true.txt")
    args = ["-d", str(f), "-q", str(f), "-type", "sift", "-o", out, "-kclusters", "4", "-nprobe", "4", "-N", "2", "-R", "1.5", "-what"]
    assert cli.search(spark, args) == 1
    assert cli.search(spark, [*args, "-ivfflat"]) == 0
    text = reports.read_reports(spark, out + "/part-*").first()["text"]
    assert "Recall@N: 1.000000" in text and "unknown flag -what" in caplog.text
    p = cli.parse_search(["-M", "8", "-ivfpq", "-lsh", "-w", "0.5"])
    assert p.method == "lsh" and p.cube.max_candidates == p.pq.parts == 8 and p.lsh.width == 0.5
    graph = str(tmp_path / "graph.csv")
    assert cli.search(spark, ["-d", str(f), "-type", "sift", "-o", graph, "-ivfflat", "-kclusters", "4", "-knngraph"]) == 0
    assert spark.read.text(graph).count() == 60


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("init", ["k-means++", "random"])
@pytest.mark.parametrize("points, k", [([i % 5 for i in range(150)], 7), ([i % 5 for i in range(150)], 8), ([i * i for i in range(30)] + [0] * 30, 12)])
def test_kmeans_ways_agree_on_empty_clusters(spark, points, k, init, seed):
    """More clusters than distinct rows and many copies, by the default rule: the farthest rows."""
    df = spark.createDataFrame([(i, [float(x)]) for i, x in enumerate(points)], "id long, vec array<double>")
    found = []
    for rows in (20_000, 0):
        means = KMeans(KMeansParams(k=k, init=init, seed=seed, max_iters=4), local_rows=rows)
        means.fit(df)
        found.append((means.centroids().tolist(), sorted(map(tuple, means.labels().collect()))))
    assert found[0] == found[1]


def test_stored_indexes_answer_as_built_ones(data, asked, spark, tmp_path):
    from stratavec.sources.indexes import read_index, write_index

    built = {**indexes(data), "ivfpq": IVFPQ(IvfParams(4, 2), PqParams(3, 3)).build_index(data)}
    for name, index in built.items():
        write_index(index, f"{tmp_path}/{name}")
        read = read_index(spark, f"{tmp_path}/{name}")
        assert type(read) is type(index) and read.params == index.params
        for ask in (lambda i: i.knn_query(asked, 5), lambda i: i.range_search(asked, 2.5), lambda i: i.nn_query(asked, 0.1), lambda i: i.query_candidates(asked)):
            assert sorted(map(tuple, ask(read).collect())) == sorted(map(tuple, ask(index).collect())), name


def test_reranked_codes_give_exact_distances(data, asked):
    index = IVFPQ(IvfParams(4, 4), PqParams(3, 3)).build_index(data)
    exact = search.exact_knn(data, asked, 5).select("qid", "rank", "id").collect()
    assert sorted(index.knn_query(asked, 5, rerank=120).select("qid", "rank", "id").collect()) == sorted(exact)


def test_lists_are_cut_into_shards(data, asked, monkeypatch):
    from stratavec.functions import blocks

    index = IVFFlat(IvfParams(3, 2)).build_index(data)
    want = sorted(map(tuple, index.knn_query(asked, 4).collect()))
    monkeypatch.setattr(blocks, "SMALL_BLOCKS", 0)
    monkeypatch.setattr(blocks, "TASK_PAIRS", 1)
    assert sorted(map(tuple, index.knn_query(asked, 4).collect())) == want


def test_lanes_follow_from_counts():
    from stratavec.functions.blocks import TASK_PAIRS, grid

    for d, q in ((1, 1), (8, 8), (1000, 40), (100_000, 5_000), (3, 10_000)):
        x, y = grid(d, q)
        assert 1 <= x <= d and 1 <= y <= q and d * q / (x * y) <= 2 * TASK_PAIRS


def test_what_is_small_counts_bytes(spark):
    from stratavec.plans.sizes import is_small

    wide = spark.createDataFrame([(i, [[0.0] * 50] * 20) for i in range(10)], "id long, lut array<array<double>>")
    assert is_small(wide) and not is_small(wide, rows=9) and not is_small(wide, size=10 * 8 * 1001 - 1) and is_small(wide, size=10 * 8 * 1001)


def test_query_cap_is_a_flag():
    assert cli.parse_search(["-lsh"]).max_queries == 100
    assert cli.parse_search(["-lsh", "-maxq", "-1"]).max_queries is None
    assert cli.parse_search(["-lsh", "-maxq", "250"]).max_queries == 250


def test_sampled_silhouette_scores_rows_as_the_whole_one(data):
    labels = data.selectExpr("id", "cast(id div 40 as int) AS cid")
    whole = {r["id"]: r["s"] for r in Silhouette().compute_per_point(data, labels).collect()}
    some = {r["id"]: r["s"] for r in Silhouette(sample=25).compute_per_point(data, labels).collect()}
    assert len(some) == 25 and all(abs(whole[i] - s) < 1e-12 for i, s in some.items())


def test_lsh_beyond_the_broadcast_finds_the_same(data, asked, monkeypatch):
    from stratavec.operators import lsh

    index = LSH(params=LshParams(3, 2, 4.0)).build_index(data)
    want = sorted(map(tuple, index.knn_query(asked, 5).collect()))
    monkeypatch.setattr(lsh, "is_small", lambda df: False)
    assert sorted(map(tuple, index.knn_query(asked, 5).collect())) == want

"""Registered queries of the vector engine and their SQL oracles.

Data is the whole ``embeddings`` table; searches ask with every row whose id is divisible by 100.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vec import residual, scaled
from .cli import parse_search
from .operators import evaluate, graph, search, summary
from .operators.base import Index
from .operators.bounded import BoundedSearch
from .operators.cube import Hypercube
from .operators.descent import neighbour_descent
from .operators.ivf import IVFFlat, choose_k, sweep
from .operators.kmeans import SAMPLE_ROWS, KMeans, assigned
from .operators.lsh import LSH
from .operators.pq import IVFPQ
from .operators.silhouette import Silhouette
from .plans import oracle as O
from .plans.params import CubeParams, IvfParams, KMeansParams, LshParams, PqParams
from .plans.session import work_path
from .sources import formats, indexes, reports, sql
from .sources.vectors import load_vectors, read_fvecs, read_idx3, read_parquet, write_fvecs, write_idx3
from .streaming import standing

DIM = 64
N = 5
RADIUS = 1.2
EPSILON = 0.1
GRAPH_K = 4
DESCENT_K = 5
BOUNDED_P = IvfParams(clusters=32, nprobe=1, seed=1, max_iters=20)
LSH_P = LshParams(tables=5, hashes=4, width=2.0, seed=1)
CUBE_P = CubeParams(projections=8, width=2.0, max_candidates=100, max_probes=6, seed=1)
TWISTER_P = CubeParams(projections=8, width=2.0, max_candidates=100, max_probes=6, seed=1, bits="twister")
KMEANS_P = KMeansParams(k=8, max_iters=3, tol=0.0, seed=1, empty="keep")
IVF_P = IvfParams(clusters=8, nprobe=2, seed=1, max_iters=3, tol=0.0, empty="keep")
PQ_P = PqParams(parts=4, bits=3, max_iters=3, tol=0.0, empty="keep")
SWEEP_KS = [2, 5, 10]
#: Settings that find at least nine in ten of the 5 nearest of near-random vectors.
HIGH = {
    "lsh": LshParams(tables=16, hashes=3, width=2.0, seed=1),
    "cube": CubeParams(projections=6, width=2.0, max_candidates=1_000_000_000, max_probes=42, seed=1),
    "ivf": IvfParams(clusters=8, nprobe=6, seed=1, max_iters=3, tol=0.0, empty="keep"),
    "ivfpq": (IvfParams(clusters=8, nprobe=7, seed=1, max_iters=3, tol=0.0, empty="keep"), PqParams(parts=32, bits=3, max_iters=3, tol=0.0, empty="keep")),
}
RERANK = 200
#: k-means on few distinct points, in which clusters run empty.
EMPTY_P = KMeansParams(k=12, max_iters=2, tol=0.0, init="random", seed=3, empty="farthest")
FLAGS = "-d base.fvecs -q query.fvecs -type sift -hypercube -kproj 10 -w 2 -M 50 -probes 4 -N 3 -R 1.5 -range true -maxq -1"

Query = Callable[[SparkSession, str], DataFrame]


def data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/embeddings.parquet")


def asked(vectors: DataFrame) -> DataFrame:
    return vectors.where(F.col("id") % 100 == 0).select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


# ---------------------------------------------------------------- expressions and exact search

def exact_knn(spark, sf_dir):
    v = data(spark, sf_dir)
    return rounded(search.exact_knn(v, asked(v), N), "dist")


def exact_range(spark, sf_dir):
    v = data(spark, sf_dir)
    return rounded(search.exact_range(v, asked(v), RADIUS), "dist")


def exact_knn_part(spark, sf_dir):
    """In two dimensions bounds leave almost all pairs out; the scan would take them all."""
    return exact_knn_part_bounded(spark, sf_dir)


def part_vectors(spark, sf_dir) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select(F.col("p_partkey").cast("long").alias("id"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice").cast("double")).alias("vec"))


def order_vectors(spark, sf_dir) -> DataFrame:
    """Price in hundreds and days since the first of 1995 of every order."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    days = F.datediff("o_orderdate", F.lit("1995-01-01")).cast("double")
    return rows.select(F.col("o_orderkey").cast("long").alias("id"), F.array(F.col("o_totalprice") / 100, days).alias("vec"))


def exact_knn_part_bounded(spark, sf_dir):
    """exact_knn_part by lists with covering radii."""
    v = part_vectors(spark, sf_dir)
    return rounded(BoundedSearch(BOUNDED_P).build_index(v).knn_query(asked(v), N), "dist", digits=4)


def exact_knn_orders_bounded(spark, sf_dir):
    v = order_vectors(spark, sf_dir)
    return rounded(BoundedSearch(BOUNDED_P).build_index(v).knn_query(asked(v), N), "dist", digits=4)


def distances(spark, sf_dir):
    v = data(spark, sf_dir)
    return search.distance_table(v, asked(v), 6)


def scaled_vectors(spark, sf_dir):
    v = data(spark, sf_dir).select("id", F.posexplode(scaled(F.col("vec"), 255)).alias("pos", "value"))
    return long(rounded(v, "value", digits=9), "pos")


# ---------------------------------------------------------------- indexes

def lsh(spark, sf_dir) -> tuple[LSH, DataFrame, DataFrame]:
    v = data(spark, sf_dir)
    return LSH(DIM, LSH_P).build_index(v), v, asked(v)


def cube(spark, sf_dir) -> tuple[Hypercube, DataFrame, DataFrame]:
    v = data(spark, sf_dir)
    return Hypercube(DIM, CUBE_P).build_index(v), v, asked(v)


def ivf(spark, sf_dir) -> tuple[IVFFlat, DataFrame, DataFrame]:
    v = data(spark, sf_dir)
    return IVFFlat(IVF_P).build_index(v), v, asked(v)


def ivfpq(spark, sf_dir) -> tuple[IVFPQ, DataFrame, DataFrame]:
    v = data(spark, sf_dir)
    return IVFPQ(IVF_P, PQ_P).build_index(v), v, asked(v)


BUILDERS = {"lsh": lsh, "cube": cube, "ivf": ivf, "ivfpq": ivfpq}


def searches(name: str) -> dict[str, Query]:
    """The queries that every index has."""

    def candidates(spark, sf_dir):
        index, _, q = BUILDERS[name](spark, sf_dir)
        return index.query_candidates(q)

    def knn(spark, sf_dir):
        index, _, q = BUILDERS[name](spark, sf_dir)
        return rounded(index.knn_query(q, N), "dist")

    def near(spark, sf_dir):
        index, _, q = BUILDERS[name](spark, sf_dir)
        return rounded(index.range_search(q, RADIUS), "dist")

    def eps_nn(spark, sf_dir):
        index, _, q = BUILDERS[name](spark, sf_dir)
        return index.nn_query(q, EPSILON)

    def scores(spark, sf_dir):
        index, v, q = BUILDERS[name](spark, sf_dir)
        return measured(index, v, q)

    return {f"{name}_candidates": candidates, f"{name}_knn": knn, f"{name}_range": near, f"{name}_eps_nn": eps_nn, f"eval_af_recall_{name}": scores}


def measured(index: Index, v: DataFrame, q: DataFrame) -> DataFrame:
    truth = search.exact_knn(v, q, N, exclude_self=True)
    found = index.knn_query(q, N, exclude_self=True)
    return rounded(evaluate.quality(evaluate.per_query(found, truth, q, N)), "avg_af", "af_found", "recall_at_n")


def lsh_hashes(spark, sf_dir):
    index, v, _ = lsh(spark, sf_dir)
    per_table = index.hashes(v, "id", "vec").select("id", F.posexplode("hashes").alias("tbl", "hs"))
    return long(per_table.select("id", "tbl", F.posexplode("hs").alias("j", "h")), "tbl", "j")


def lsh_ids(spark, sf_dir):
    return long(lsh(spark, sf_dir)[0].entries(), "tbl")


def lsh_buckets(spark, sf_dir):
    return long(lsh(spark, sf_dir)[0].buckets(), "tbl")


def cube_vertices(spark, sf_dir):
    return cube(spark, sf_dir)[0].rows.select("id", "vertex")


def cube_twister_vertices(spark, sf_dir):
    return Hypercube(DIM, TWISTER_P).build_index(data(spark, sf_dir)).rows.select("id", "vertex")


def cube_twister_knn(spark, sf_dir):
    v = data(spark, sf_dir)
    return rounded(Hypercube(DIM, TWISTER_P).build_index(v).knn_query(asked(v), N), "dist")


# ---------------------------------------------------------------- clustering

def kmeans_pp_init(spark, sf_dir):
    v = data(spark, sf_dir)
    means = KMeans(KMEANS_P)
    centres = means.seeds_distributed(v, v.count())
    rows = [(i, j, float(x)) for i, c in enumerate(centres) for j, x in enumerate(c)]
    return rounded(spark.createDataFrame(rows, "cid long, pos long, value double"), "value")


def fitted(spark, sf_dir) -> tuple[KMeans, DataFrame]:
    v = data(spark, sf_dir)
    means = KMeans(KMEANS_P)
    means.fit(v)
    return means, v


def kmeans_lloyd(spark, sf_dir):
    centres = fitted(spark, sf_dir)[0].centroids()
    rows = [(i, j, float(x)) for i, c in enumerate(centres) for j, x in enumerate(c)]
    return rounded(spark.createDataFrame(rows, "cid long, pos long, value double"), "value")


def kmeans_assign(spark, sf_dir):
    means, v = fitted(spark, sf_dir)
    near = assigned(v, means.centroids()).select("id", "cid", F.sqrt("d2").alias("dist"))
    return long(rounded(near, "dist"), "cid")


def residuals(spark, sf_dir):
    means, v = fitted(spark, sf_dir)
    near = assigned(v, means.centroids())
    centres = [[float(x) for x in c] for c in means.centroids()]
    table = F.broadcast(spark.createDataFrame(list(enumerate(centres)), "cid int, c array<double>"))  # k rows
    left = near.join(table, "cid").select("id", F.posexplode(residual(F.col("vec"), F.col("c"))).alias("pos", "value"))
    return long(rounded(left, "value"), "pos")


def labelled(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return data(spark, sf_dir), rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("int").alias("cid"))


def silhouette_points(spark, sf_dir):
    return long(rounded(Silhouette().compute_per_point(*labelled(spark, sf_dir)), "s"), "cid")


def silhouette_clusters(spark, sf_dir):
    v, labels = labelled(spark, sf_dir)
    k = labels.agg(F.max("cid")).first()[0] + 1
    return long(rounded(Silhouette().compute_per_cluster(v, labels, k), "s"), "cid")


def silhouette_mean(spark, sf_dir):
    return rounded(Silhouette().compute(*labelled(spark, sf_dir)), "silhouette")


def best_k_sweep(spark, sf_dir):
    scores = sweep(data(spark, sf_dir), SWEEP_KS, KMEANS_P)
    return rounded(spark.createDataFrame(scores, "k long, silhouette double"), "silhouette")


AUTO_P = IvfParams(clusters=0, nprobe=2, seed=1, max_iters=2, tol=0.0, empty="keep")


def auto_k(spark, sf_dir):
    return spark.createDataFrame([(choose_k(data(spark, sf_dir), AUTO_P),)], "k long")


# ---------------------------------------------------------------- inverted files and codes

def ivf_build(spark, sf_dir):
    return long(ivf(spark, sf_dir)[0].rows.select("cid", "id"), "cid")


def pq_codebooks(spark, sf_dir):
    table = ivfpq(spark, sf_dir)[0].pq.table(spark)
    return long(rounded(table.select("m", "code", F.posexplode("c").alias("pos", "value")), "value"), "m", "code", "pos")


def pq_encode(spark, sf_dir):
    rows = ivfpq(spark, sf_dir)[0].rows
    return long(rows.select("id", "cid", F.posexplode("codes").alias("m", "code")), "cid", "m", "code")


def pq_lut(spark, sf_dir):
    index, _, q = ivfpq(spark, sf_dir)
    per_part = index.lut(q).select("qid", "cid", F.posexplode("lut").alias("m", "row"))
    return long(rounded(per_part.select("qid", "cid", "m", F.posexplode("row").alias("code", "d2")), "d2"), "cid", "m", "code")


def pq_adc(spark, sf_dir):
    index, _, q = ivfpq(spark, sf_dir)
    return rounded(index.adc(q), "adc")


# ---------------------------------------------------------------- reports

def knn_graph_csv(spark, sf_dir):
    return graph.graph_lines(graph.knn_graph(ivf(spark, sf_dir)[0], GRAPH_K))


def graph_descent(spark, sf_dir):
    """The graph of all orders by neighbour descent: its edges, whether recall against the exact graph, asked
    for every hundredth order by bounds, is at least 0.9, and whether fewer distances were taken than there are pairs."""
    v = order_vectors(spark, sf_dir).persist()
    n = v.count()
    found = neighbour_descent(v, DESCENT_K)
    q = asked(v)
    truth = BoundedSearch(BOUNDED_P).build_index(v).knn_query(q, DESCENT_K, exclude_self=True).persist()
    # Orders at the same distance as the last true neighbour are as good.
    last = truth.groupBy("qid").agg((F.max("dist") + 1e-9).alias("last"))
    hits = found.edges.join(last, found.edges["src"] == last["qid"]).where("dist <= last").count()
    recall = hits / max(1, truth.count())
    return spark.createDataFrame([(found.edges.count(), recall >= 0.9, found.distances < n * (n - 1) // 2)], "edges long, recall_reached boolean, below_all_pairs boolean")


def report_blocks(spark, sf_dir):
    index, v, q = lsh(spark, sf_dir)
    hits = evaluate.with_true_distance(index.knn_query(q, N), v, q)
    return reports.query_blocks(hits, q, index.range_search(q, RADIUS))


def _reports(spark, sf_dir) -> DataFrame:
    """Footers of runs of three indexes, named as result files are; times are left at zero."""
    parts = []
    for name, file in (("lsh", "results_lsh_sift_false.txt"), ("cube", "results_hypercube_sift_false.txt"), ("ivf", "results_ivfflat_mnist_true.txt")):
        index, v, q = BUILDERS[name](spark, sf_dir)
        found = measured(index, v, q)
        timed = found.select("avg_af", "recall_at_n", F.lit(1.0).alias("qps"), F.lit(0.0).alias("t_approx_ms"), F.lit(0.0).alias("t_true_ms"))
        parts.append(reports.footer(timed).select(F.lit(file).alias("name"), "text"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def results_parse(spark, sf_dir):
    return summary.parse_reports(_reports(spark, sf_dir))


def metrics_summary(spark, sf_dir):
    return rounded(summary.summarised(summary.parse_reports(_reports(spark, sf_dir))), *summary.METRICS.values())


def metrics_table(spark, sf_dir):
    """The summary written as CSV and read again."""
    path = work_path(spark, "summary")
    reports.write_table(summary.summarised(summary.parse_reports(_reports(spark, sf_dir))), path)
    columns = ", ".join(f"{c} double" for c in summary.METRICS.values())
    return rounded(spark.read.csv(path, header=True, schema=f"dataset string, method string, {columns}"), *summary.METRICS.values())


def trade_off(spark, sf_dir):
    return summary.trade_off(summary.parse_reports(_reports(spark, sf_dir)))


def report_blocks_ivfpq(spark, sf_dir):
    """Distances by table beside true ones, which differ."""
    index, v, q = ivfpq(spark, sf_dir)
    return reports.query_blocks(evaluate.with_true_distance(index.knn_query(q, N), v, q), q, index.range_search(q, RADIUS))


def results_files(spark, sf_dir):
    """Whole reports of three indexes written as files, read by a pattern and parsed."""
    folder = work_path(spark, "results")
    for name, file in (("lsh", "results_lsh_sift_false.txt"), ("cube", "results_hypercube_sift_false.txt"), ("ivf", "results_ivfflat_mnist_true.txt")):
        index, v, q = BUILDERS[name](spark, sf_dir)
        hits = evaluate.with_true_distance(index.knn_query(q, N), v, q)
        timed = measured(index, v, q).select("avg_af", "recall_at_n", F.lit(1.0).alias("qps"), F.lit(0.0).alias("t_approx_ms"), F.lit(0.0).alias("t_true_ms"))
        reports.write_report(f"{folder}/{file}", name, reports.query_blocks(hits, q), timed)
    return summary.parse_reports(reports.read_reports(spark, f"{folder}/*"))


def sweep_files(spark, sf_dir):
    folder = work_path(spark, "sweeps")
    scores = sweep(data(spark, sf_dir), SWEEP_KS[:2], KMEANS_P)
    reports.write_sweep(spark.createDataFrame(scores, "k int, silhouette double"), f"{folder}/silhouette_results_sift.txt")
    return long(rounded(reports.read_sweeps(spark, f"{folder}/*"), "silhouette"), "k")


def timed_run(spark, sf_dir):
    """The harness over an index; of its times only whether they were taken."""
    index, v, q = ivf(spark, sf_dir)
    run = evaluate.run_queries(index, v, q, N, RADIUS, "ivf", "embeddings", exclude_self=True)
    m = rounded(run.metrics, "avg_af", "recall_at_n")
    taken = [(F.col(c) > 0).alias(c) for c in ("qps", "t_approx_ms", "t_true_ms")]
    return m.select("method", "dataset", "range_search", "avg_af", "n_found", "recall_at_n", *taken)


def parameter_echo(spark, sf_dir):
    """The parameters of a command line, and how many vectors and answers a search by them over the table has."""
    run = parse_search(FLAGS.split())
    v = data(spark, sf_dir)
    found = Hypercube(DIM, run.cube).build_index(v).knn_query(asked(v), run.n)
    counted = [t.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(name).alias("name"), "value") for name, t in (("vectors", v), ("answers", found))]
    return spark.createDataFrame(run.echo(), "name string, value string").unionByName(counted[0]).unionByName(counted[1])


# ---------------------------------------------------------------- files of vectors

def fvecs_scan(spark, sf_dir):
    path = work_path(spark, "fvecs")
    write_fvecs(data(spark, sf_dir), path)
    rows = read_fvecs(spark, path, None, DIM).select("id", F.posexplode("vec").alias("pos", "value"))
    return long(rounded(rows.withColumn("value", F.col("value").cast("double")), "value"), "pos")


def pixels(spark, sf_dir) -> DataFrame:
    """The vectors as images of 8 x 8 pixels."""
    return data(spark, sf_dir).select("id", F.transform("vec", lambda x: F.floor((x.cast("double") + 1) * 127.5).cast("int")).alias("vec"))


def idx3_scan(spark, sf_dir):
    path = work_path(spark, "idx3")
    write_idx3(pixels(spark, sf_dir), path, 8, 8)
    return long(read_idx3(spark, path, None).select("id", F.posexplode("vec").alias("pos", "pixel")), "pos", "pixel")


def idx3_first_rows(spark, sf_dir):
    """The first 100 images only, with pixels from 0 to 1."""
    path = work_path(spark, "idx3")
    write_idx3(pixels(spark, sf_dir), path, 8, 8)
    rows = read_idx3(spark, path, 100, normalise=True).select("id", F.posexplode("vec").alias("pos", "value"))
    return long(rounded(rows.withColumn("value", F.col("value").cast("double")), "value"), "pos")


def fvecs_files(spark, sf_dir):
    """A folder of files read by the format's name, in slices of 50 vectors; ids count on over the files."""
    path = work_path(spark, "fvecs-files")
    write_fvecs(data(spark, sf_dir).repartitionByRange(4, "id"), path)
    formats.register(spark)
    v = spark.read.format("fvecs").options(dim=DIM, split_bytes=50 * (4 + 4 * DIM)).load(path)
    return rounded(search.exact_knn(v, asked(v), N), "dist")


def idx3_files(spark, sf_dir):
    """Images in two files, read as one sequence in slices of 100; the last three are asked for."""
    folder = work_path(spark, "idx3-files")
    every = pixels(spark, sf_dir)
    n = every.count()
    for name, low, high in (("a.idx3", 0, n // 3), ("b.idx3", n // 3, n)):
        write_idx3(every.where(F.col("id").between(low, high - 1)), f"{folder}/{name}", 8, 8)
    formats.register(spark)
    v = spark.read.format("idx3").option("split_bytes", 6400).load(folder)
    return rounded(search.exact_knn(v, v.where(F.col("id") >= n - 3).select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), N), "dist")


def dataset_kinds(spark, sf_dir):
    """Files of three kinds, told apart by their names: rows, dimensions, and rows under a limit of 50."""
    v = data(spark, sf_dir)
    folder = work_path(spark, "kinds")
    write_fvecs(v, f"{folder}/base.fvecs")
    write_idx3(pixels(spark, sf_dir), f"{folder}/images.idx3", 8, 8)
    out = None
    for kind, path, options in (("fvecs", f"{folder}/base.fvecs", {"dim": DIM}), ("idx3", f"{folder}/images.idx3", {}), ("parquet", f"{sf_dir}/embeddings.parquet", {})):
        every, some = (load_vectors(spark, path, limit=limit, **options).select(F.size("vec").alias("dim")) for limit in (None, 50))
        rows = every.agg(F.count(F.lit(1)).alias("n"), F.max("dim").cast("long").alias("dim")).crossJoin(F.broadcast(some.agg(F.count(F.lit(1)).alias("n_limited"))))  # one row each
        rows = rows.select(F.lit(kind).alias("kind"), "n", "dim", "n_limited")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---------------------------------------------------------------- further searches and clusterings

def lsh_query(spark, sf_dir):
    index, _, q = lsh(spark, sf_dir)
    return index.query(q, N)


def clear_index(spark, sf_dir):
    """Entries of an index that is built, cleared, and built again from other draws."""
    index, v, _ = lsh(spark, sf_dir)
    steps = [("built", index.persist().entries().count())]
    index.clear_index()
    steps.append(("cleared", 0 if index.rows is None else index.entries().count()))
    steps.append(("built again", index.build_index(v).entries().count()))
    return spark.createDataFrame(steps, "step string, entries long")


def stored(name: str) -> Query:
    """The index written, read and searched."""

    def run(spark, sf_dir):
        index, _, q = BUILDERS[name](spark, sf_dir)
        path = work_path(spark, f"index-{name}")
        indexes.write_index(index, path)
        return rounded(indexes.read_index(spark, path).knn_query(q, N), "dist")

    return run


def updated(name: str) -> Query:
    """The index written; some rows deleted; half of these inserted again; compacted, read and searched."""

    def run(spark, sf_dir):
        index, v, q = BUILDERS[name](spark, sf_dir)
        path = work_path(spark, f"updated-{name}")
        indexes.write_index(index, path)
        indexes.delete(spark, path, v.where("id % 7 = 3").select("id"))
        indexes.insert(spark, path, v.where("id % 14 = 3"))
        indexes.compact(spark, path, f"{path}-compact")
        return rounded(indexes.read_index(spark, f"{path}-compact").knn_query(q, N), "dist")

    return run


def _registered_ivf(spark, sf_dir) -> None:
    """Table functions emb_* over a stored index, and the view emb_asked of the queries."""
    index, _, q = ivf(spark, sf_dir)
    path = work_path(spark, "index-sql")
    indexes.write_index(index, path)
    sql.register_search(spark, "emb", path)
    q.select("qid", F.col("qvec").cast("array<double>").alias("qvec")).createOrReplaceTempView("emb_asked")


def sql_ivf_knn(spark, sf_dir):
    """The stored index searched by a statement in SQL."""
    _registered_ivf(spark, sf_dir)
    return rounded(spark.sql(sql.nearest_sql("emb", "emb_asked", N)), "dist")


def sql_ivf_range(spark, sf_dir):
    _registered_ivf(spark, sf_dir)
    return rounded(spark.sql(sql.within_sql("emb", "emb_asked", RADIUS)), "dist")


def standing_knn(spark, sf_dir):
    """All vectors arrive as a stream of three micro-batches; the queries' standing answers at its end."""
    v = data(spark, sf_dir)
    folder = work_path(spark, "standing")
    v.repartition(3, "id").write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema(v.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    standing.keep_standing(arriving, asked(v), N, f"{folder}/out", f"{folder}/check").awaitTermination()
    changes = spark.read.schema(f"{standing.ANSWERS}, batch long").parquet(f"{folder}/out")
    return rounded(standing.current(changes), "dist")


#: Indexes whose updates have an oracle; the cube's soft cap follows the fill, which the tests compare with a rebuild.
UPDATED = ["lsh", "ivf", "ivfpq"]


def high_index(name: str, v: DataFrame) -> Index:
    """An index at the settings of high recall."""
    p = HIGH[name]
    if name == "lsh":
        return LSH(DIM, p).build_index(v)
    if name == "cube":
        return Hypercube(DIM, p).build_index(v)
    return IVFFlat(p).build_index(v) if name == "ivf" else IVFPQ(*p).build_index(v)


def high_answers(name: str, index: Index, q: DataFrame) -> DataFrame:
    return index.knn_query(q, N, True, RERANK) if name == "ivfpq" else index.knn_query(q, N, True)


def high_recall(name: str) -> Query:
    """Measures at the settings of high recall."""

    def run(spark, sf_dir):
        v = data(spark, sf_dir)
        q = asked(v)
        truth = search.exact_knn(v, q, N, exclude_self=True)
        found = high_answers(name, high_index(name, v), q)
        return rounded(evaluate.quality(evaluate.per_query(found, truth, q, N)), "avg_af", "af_found", "recall_at_n")

    return run


def kmeans_distributed(spark, sf_dir):
    """The fit of kmeans_lloyd under its earlier name; both go by tasks."""
    means = KMeans(KMEANS_P)
    means.fit(data(spark, sf_dir))
    return _centre_rows(spark, means)


def _centre_rows(spark, means: KMeans) -> DataFrame:
    rows = [(i, j, float(x)) for i, c in enumerate(means.centroids()) for j, x in enumerate(c)]
    return rounded(spark.createDataFrame(rows, "cid long, pos long, value double"), "value")


def kmeans_random_init(spark, sf_dir):
    v = data(spark, sf_dir)
    seeds = KMeans(KMeansParams(k=KMEANS_P.k, init="random", seed=KMEANS_P.seed)).seeds_distributed(v, v.count())
    return rounded(spark.createDataFrame([(i, j, float(x)) for i, c in enumerate(seeds) for j, x in enumerate(c)], "cid long, pos long, value double"), "value")


def kmeans_empty(spark, sf_dir):
    """Clusters that run empty take the farthest rows: fitted as a bounded sample and by tasks."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    v = part.select(F.col("p_partkey").cast("long").alias("id"), F.array((F.col("p_size") % 5).cast("double"), (F.col("p_partkey") % 2).cast("double")).alias("vec"))
    out = None
    for way, rows in (("one task", SAMPLE_ROWS), ("many tasks", 0)):
        means = KMeans(EMPTY_P, local_rows=rows)
        means.fit(v)
        found = _centre_rows(spark, means).withColumn("way", F.lit(way))
        out = found if out is None else out.unionByName(found)
    return out


def kmeans_predict(spark, sf_dir):
    means, v = fitted(spark, sf_dir)
    return long(means.predict(v), "cid")


def queries() -> dict[str, Query]:
    plain = [exact_knn, exact_range, exact_knn_part, exact_knn_part_bounded, exact_knn_orders_bounded, distances, scaled_vectors, lsh_hashes, lsh_ids, lsh_buckets, cube_vertices, cube_twister_vertices,
             cube_twister_knn, sql_ivf_knn, sql_ivf_range, standing_knn, kmeans_pp_init, kmeans_lloyd, kmeans_assign, residuals, silhouette_points, silhouette_clusters, silhouette_mean,
             best_k_sweep, auto_k, ivf_build, pq_codebooks, pq_encode, pq_lut, pq_adc, knn_graph_csv, graph_descent, report_blocks, results_parse, metrics_summary,
             metrics_table, trade_off, report_blocks_ivfpq, results_files, sweep_files, timed_run, parameter_echo, fvecs_scan, fvecs_files, idx3_scan, idx3_files, idx3_first_rows,
             dataset_kinds, lsh_query, clear_index, kmeans_distributed, kmeans_random_init, kmeans_empty, kmeans_predict]
    out = {f.__name__: f for f in plain}
    for name in BUILDERS:
        out.update(searches(name))
        out[f"stored_{name}_knn"] = stored(name)
        out[f"high_recall_{name}"] = high_recall(name)
    for name in UPDATED:
        out[f"updated_{name}_knn"] = updated(name)
    return out


# ---------------------------------------------------------------- oracles

def oracle_sql() -> dict[str, str]:
    lsh_c, cube_c, ivf_c, pq_c = O.lsh(LSH_P, DIM), O.cube(CUBE_P, DIM), O.ivf(IVF_P), O.ivfpq(IVF_P, PQ_P, DIM)
    k_c, t, pt = O.whole_kmeans(KMEANS_P), KMEANS_P.max_iters, PQ_P.max_iters
    near = f"k_near AS MATERIALIZED (SELECT id, any_value(v) AS v, min_by(cid, struct_pack(d := list_distance(v, c), i := cid)) AS cid, min(list_distance(v, c)) AS d FROM v, k_g{t} GROUP BY id)"
    twister_c = O.cube(TWISTER_P, DIM)
    by_label = ["lab AS (SELECT id, v, label AS cid FROM v)", *O.silhouette("s", "lab")]
    out = {
        "exact_knn": O.query(["d AS (SELECT qid, id, list_distance(qv, v) AS d FROM q, v)"], O.ranked("d", N)),
        "exact_range": O.query([], f"SELECT qid, id, round(list_distance(qv, v), 6) AS dist FROM q, v WHERE list_distance(qv, v) <= {O.number(RADIUS)}"),
        "exact_knn_part": "WITH v AS (SELECT p_partkey::BIGINT AS id, [p_size::DOUBLE, p_retailprice::DOUBLE] AS v FROM part), "
                          "d AS (SELECT a.id AS qid, b.id, list_distance(a.v, b.v) AS d FROM v a, v b WHERE a.id % 100 = 0) " + O.ranked("d", N, digits=4),
        "exact_knn_orders_bounded": "WITH v AS (SELECT o_orderkey AS id, [o_totalprice / 100, datediff('day', TIMESTAMP '1995-01-01', o_orderdate)::DOUBLE] AS v FROM orders), "
                                    "d AS (SELECT a.id AS qid, b.id, list_distance(a.v, b.v) AS d FROM v a, v b WHERE a.id % 100 = 0) " + O.ranked("d", N, digits=4),
        "distances": O.query([], "SELECT qid, id, round(list_distance(qv, v), 6) AS l2, round(pow(list_distance(qv, v), 2), 6) AS l2sq, round(list_inner_product(qv, v), 6) AS dot FROM q, v"),
        "scaled_vectors": O.query([], "SELECT id, pos, round(x / 255, 9) AS value FROM (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM v)"),
        "lsh_hashes": O.query(lsh_c, "SELECT id, tbl, j, h FROM lh"),
        "lsh_ids": O.query(lsh_c, "SELECT tbl, hid, id FROM li"),
        "lsh_buckets": O.query(lsh_c, "SELECT tbl, hid % greatest(1, (SELECT count(*) FROM v) // 4) AS bucket, count(*) AS n FROM li GROUP BY 1, 2"),
        "cube_vertices": O.query(cube_c, "SELECT id, vertex FROM cv"),
        "cube_twister_vertices": O.query(twister_c, "SELECT id, vertex FROM cv"),
        "cube_twister_knn": O.query(twister_c, O.ranked("cd", N)),
        "kmeans_pp_init": O.query(k_c, "SELECT i::BIGINT AS cid, pos::BIGINT AS pos, round(x, 6) AS value FROM (SELECT i, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM k_s)"),
        "kmeans_lloyd": O.query(k_c, f"SELECT cid::BIGINT AS cid, pos::BIGINT AS pos, round(x, 6) AS value FROM (SELECT cid, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS pos FROM k_g{t})"),
        "kmeans_assign": O.query([*k_c, near], "SELECT id, cid::BIGINT AS cid, round(d, 6) AS dist FROM k_near"),
        "residuals": O.query([*k_c, near], f"SELECT id, pos::BIGINT AS pos, round(x, 6) AS value FROM (SELECT id, unnest(r) AS x, generate_subscripts(r, 1) - 1 AS pos FROM "
                             f"(SELECT id, list_transform(list_zip(v, c), lambda z: z[1] - z[2]) AS r FROM k_near JOIN k_g{t} USING (cid)))"),
        "silhouette_points": O.query(by_label, "SELECT id, cid::BIGINT AS cid, round(s, 6) AS s FROM s_p"),
        "silhouette_clusters": O.query(by_label, "SELECT cid::BIGINT AS cid, round(coalesce(s, 'NaN'::DOUBLE), 6) AS s FROM (SELECT unnest(range((SELECT max(label) + 1 FROM v))) AS cid) LEFT JOIN (SELECT cid, avg(s) AS s FROM s_p GROUP BY cid) USING (cid)"),
        "silhouette_mean": O.query(by_label, "SELECT round(avg(s), 6) AS silhouette FROM s_p"),
        "ivf_build": O.query(ivf_c, "SELECT cid::BIGINT AS cid, id FROM fl"),
        "pq_codebooks": O.query(pq_c, f"SELECT m::BIGINT AS m, cid::BIGINT AS code, pos::BIGINT AS pos, round(x, 6) AS value FROM (SELECT m, cid, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS pos FROM b_g{pt})"),
        "pq_encode": O.query(pq_c, "SELECT id, cid::BIGINT AS cid, m::BIGINT AS m, code::BIGINT AS code FROM pe"),
        "pq_lut": O.query(pq_c, "SELECT qid, cid::BIGINT AS cid, m::BIGINT AS m, code::BIGINT AS code, round(d2, 6) AS d2 FROM pl"),
        "pq_adc": O.query(pq_c, "SELECT qid, id, round(d, 6) AS adc FROM pd"),
        "knn_graph_csv": O.query([*ivf_c, "ga AS (SELECT qid AS src, fl.id AS dst, list_distance(a.v, b.v) AS d FROM fp_all JOIN fl USING (cid) JOIN v a ON a.id = qid JOIN v b ON b.id = fl.id)",
                                  f"gr AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY round(d, 9), dst) AS rank FROM ga QUALIFY rank <= {GRAPH_K})"],
                                 "SELECT concat_ws(',', src::VARCHAR, string_agg(dst::VARCHAR, ',' ORDER BY rank)) AS line FROM gr GROUP BY src"),
        "graph_descent": f"SELECT {DESCENT_K} * count(*) AS edges, true AS recall_reached, true AS below_all_pairs FROM orders",
        "report_blocks": O.query([*lsh_c, f"rk AS (SELECT qid, id, d, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) AS rank FROM ld QUALIFY rank <= {N})",
                                  "rl AS (SELECT qid, string_agg(printf('Nearest neighbor-%d: %d' || chr(10) || 'distanceApproximate: %.6f' || chr(10) || 'distanceTrue: %.6f' || chr(10), rank, id, d, d), '' ORDER BY rank) AS t FROM rk GROUP BY qid)",
                                  f"rr AS (SELECT qid, string_agg(id::VARCHAR || chr(10), '' ORDER BY id) AS t FROM ld WHERE d <= {O.number(RADIUS)} GROUP BY qid)"],
                                 "SELECT qid, 'Query: ' || qid || chr(10) || coalesce(rl.t, '') || 'R-near neighbors:' || chr(10) || coalesce(rr.t, '') || chr(10) AS text FROM q LEFT JOIN rl USING (qid) LEFT JOIN rr USING (qid)"),
    }
    for name, ctes, table, pairs in (("lsh", lsh_c, "ld", "lc"), ("cube", cube_c, "cd", "cc"), ("ivf", ivf_c, "fd", "fc"), ("ivfpq", pq_c, "pd", "fc")):
        out[f"{name}_candidates"] = O.query(ctes, f"SELECT qid, id FROM {pairs}")
        out[f"{name}_knn"] = O.query(ctes, O.ranked(table, N))
        out[f"{name}_range"] = O.query(ctes, f"SELECT qid, id, round(d, 6) AS dist FROM {table} WHERE d <= {O.number(RADIUS)}")
        out[f"{name}_eps_nn"] = O.query(ctes, O.relaxed("fd" if name == "ivfpq" else table, EPSILON))
        out[f"eval_af_recall_{name}"] = O.query([*ctes, *O.truth(N), *O.scored(table, N)], "SELECT round(avg_af, 6) AS avg_af, round(af_found, 6) AS af_found, n_found, round(recall_at_n, 6) AS recall_at_n FROM e")
    per_k = []
    for k in SWEEP_KS:
        p = KMeansParams(k, KMEANS_P.max_iters, 0.0, seed=KMEANS_P.seed, empty="keep")
        per_k += [*O.whole_kmeans(p, f"k{k}"), *O.silhouette(f"s{k}", f"k{k}_a{p.max_iters}")]
    out["best_k_sweep"] = O.query(per_k, " UNION ALL ".join(f"SELECT {k}::BIGINT AS k, (SELECT round(avg(s), 6) FROM s{k}_p) AS silhouette" for k in SWEEP_KS))
    auto = []
    for k in range(2, 11):
        auto += [*O.whole_kmeans(KMeansParams(k, AUTO_P.max_iters, 0.0, seed=AUTO_P.seed, empty="keep"), f"k{k}"), *O.silhouette(f"s{k}", f"k{k}_a{AUTO_P.max_iters}")]
    scores = " UNION ALL ".join(f"SELECT {k}::BIGINT AS k, avg(s) AS s FROM s{k}_p" for k in range(2, 11))
    out["auto_k"] = O.query([*auto, f"a AS ({scores})"], "SELECT arg_max(k, struct_pack(s := s, k := -k)) AS k FROM a WHERE k <= (SELECT floor(sqrt(count(*))) FROM v)")
    runs = [("lsh", lsh_c, "ld", "LSH", "SIFT", "False"), ("cube", cube_c, "cd", "HYPERCUBE", "SIFT", "False"), ("ivf", ivf_c, "fd", "IVFFLAT", "MNIST", "True")]
    ctes = [*O.truth(N)]
    for name, c, table, *_ in runs:
        ctes += [*c, *O.scored(table, N, f"e_{name}")]
    parsed = " UNION ALL ".join(f"SELECT '{m}' AS method, '{d}' AS dataset, '{r}' AS range_search, round(avg_af, 6) AS avg_af, round(recall_at_n, 6) AS recall_at_n, 1.0::DOUBLE AS qps, 0.0::DOUBLE AS t_approx_ms, 0.0::DOUBLE AS t_true_ms FROM e_{name}" for name, _, _, m, d, r in runs)
    out["results_parse"] = out["results_files"] = O.query(ctes, parsed)
    out["trade_off"] = O.query([*ctes, f"p AS ({parsed})"], "SELECT method, dataset, qps, avg_af FROM p")
    out["metrics_summary"] = O.query([*ctes, f"p AS ({parsed})"], "SELECT dataset, method, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in summary.METRICS.values()) + " FROM p GROUP BY dataset, method")
    out["metrics_table"] = out["metrics_summary"]
    out["exact_knn_part_bounded"] = out["exact_knn_part"]
    out["sql_ivf_knn"], out["sql_ivf_range"], out["standing_knn"] = out["ivf_knn"], out["ivf_range"], out["exact_knn"]
    out |= further_sql(lsh_c, ivf_c, pq_c, k_c, near)
    for name in BUILDERS:
        out[f"stored_{name}_knn"] = out[f"{name}_knn"]
    for name, ctes, table in (("lsh", lsh_c, "ld"), ("ivf", ivf_c, "fd"), ("ivfpq", pq_c, "pd")):
        out[f"updated_{name}_knn"] = O.query([*ctes, f"live AS (SELECT * FROM {table} WHERE id % 14 <> 10)"], O.ranked("live", N))
    return out


def further_sql(lsh_c: list[str], ivf_c: list[str], pq_c: list[str], k_c: list[str], near: str) -> dict[str, str]:
    t = KMEANS_P.max_iters
    places = "unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos"
    pixel = "floor((x + 1) * 127.5)"
    out = {
        "report_blocks_ivfpq": O.query([*pq_c, f"rk AS (SELECT qid, id, d, list_distance(qv, v) AS td, row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) AS rank FROM pd JOIN q USING (qid) JOIN v USING (id) QUALIFY rank <= {N})",
                                        "rl AS (SELECT qid, string_agg(printf('Nearest neighbor-%d: %d' || chr(10) || 'distanceApproximate: %.6f' || chr(10) || 'distanceTrue: %.6f' || chr(10), rank, id, d, td), '' ORDER BY rank) AS t FROM rk GROUP BY qid)",
                                        f"rr AS (SELECT qid, string_agg(id::VARCHAR || chr(10), '' ORDER BY id) AS t FROM pd WHERE d <= {O.number(RADIUS)} GROUP BY qid)"],
                                       "SELECT qid, 'Query: ' || qid || chr(10) || coalesce(rl.t, '') || 'R-near neighbors:' || chr(10) || coalesce(rr.t, '') || chr(10) AS text FROM q LEFT JOIN rl USING (qid) LEFT JOIN rr USING (qid)"),
        "timed_run": O.query([*ivf_c, *O.truth(N), *O.scored("fd", N)], "SELECT 'ivf' AS method, 'embeddings' AS dataset, true AS range_search, round(avg_af, 6) AS avg_af, n_found, round(recall_at_n, 6) AS recall_at_n, true AS qps, true AS t_approx_ms, true AS t_true_ms FROM e"),
        "parameter_echo": O.query([*O.cube(ECHO_P, DIM), f"r AS ({O.ranked('cd', 3)})"],
                                  "SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{v}')" for n, v in ECHO.items()) + ") AS t(name, value) "
                                  "UNION ALL SELECT 'vectors', count(*)::VARCHAR FROM v UNION ALL SELECT 'answers', count(*)::VARCHAR FROM r"),
        "fvecs_scan": O.query([], f"SELECT id, pos, round(x, 6) AS value FROM (SELECT id, {places} FROM v)"),
        "fvecs_files": O.query(["d AS (SELECT qid, id, list_distance(qv, v) AS d FROM q, v)"], O.ranked("d", N)),
        "idx3_files": "WITH v AS MATERIALIZED (SELECT vec_id AS id, list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 127.5)::DOUBLE) AS v FROM embeddings), "
                      "d AS (SELECT a.id AS qid, b.id, list_distance(a.v, b.v) AS d FROM v a, v b WHERE a.id >= (SELECT count(*) FROM v) - 3) " + O.ranked("d", N),
        "idx3_scan": O.query([], f"SELECT id, pos, {pixel}::BIGINT AS pixel FROM (SELECT id, {places} FROM v)"),
        "idx3_first_rows": O.query([], f"SELECT id, pos, round(({pixel} / 255)::FLOAT::DOUBLE, 6) AS value FROM (SELECT id, {places} FROM v) WHERE id < 100"),
        "dataset_kinds": O.query([], "SELECT kind, n, dim, least(n, 50) AS n_limited FROM (SELECT count(*) AS n, max(len(v)) AS dim FROM v), (VALUES ('fvecs'), ('idx3'), ('parquet')) AS t(kind)"),
        "lsh_query": O.query([*lsh_c, f"r AS ({O.ranked('ld', N)})"], "SELECT qid, rank, id FROM r"),
        "clear_index": O.query([], f"SELECT step, (CASE step WHEN 'cleared' THEN 0 ELSE {LSH_P.tables} * (SELECT count(*) FROM v) END)::BIGINT AS entries FROM (VALUES ('built'), ('cleared'), ('built again')) AS t(step)"),
        "kmeans_distributed": O.query(k_c, f"SELECT cid::BIGINT AS cid, pos::BIGINT AS pos, round(x, 6) AS value FROM (SELECT cid, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS pos FROM k_g{t})"),
        "kmeans_random_init": O.query(["z AS (SELECT 0 AS m, id, v FROM v)", O.random_seeds("r", "z", KMEANS_P.k, KMEANS_P.seed)], f"SELECT i::BIGINT AS cid, pos::BIGINT AS pos, round(x, 6) AS value FROM (SELECT i, {places} FROM r_s)"),
        "kmeans_predict": O.query([*k_c, near], "SELECT id, cid::BIGINT AS cid FROM k_near"),
        "kmeans_empty": "WITH " + ",\n".join(["z AS (SELECT 0 AS m, p_partkey::BIGINT AS id, [(p_size % 5)::DOUBLE, (p_partkey % 2)::DOUBLE] AS v FROM part)",
                                              O.random_seeds("r", "z", EMPTY_P.k, EMPTY_P.seed), *O.lloyd("r", "z", EMPTY_P.max_iters, "farthest")])
                        + f" SELECT cid::BIGINT AS cid, pos::BIGINT AS pos, round(x, 6) AS value, way FROM (SELECT cid, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS pos FROM r_g{EMPTY_P.max_iters}), (VALUES ('one task'), ('many tasks')) AS t(way)",
    }
    per_k = []
    for k in SWEEP_KS[:2]:
        p = KMeansParams(k, KMEANS_P.max_iters, 0.0, seed=KMEANS_P.seed, empty="keep")
        per_k += [*O.whole_kmeans(p, f"k{k}"), *O.silhouette(f"s{k}", f"k{k}_a{p.max_iters}")]
    out["sweep_files"] = O.query(per_k, " UNION ALL ".join(f"SELECT {k}::BIGINT AS k, (SELECT round(avg(s), 6) FROM s{k}_p) AS silhouette, 'sift' AS type" for k in SWEEP_KS[:2]))
    high = {
        "lsh": (O.lsh(HIGH["lsh"], DIM), "ld"), "cube": (O.cube(HIGH["cube"], DIM), "cd"), "ivf": (O.ivf(HIGH["ivf"]), "fd"),
        "ivfpq": ([*O.ivfpq(*HIGH["ivfpq"], DIM),
                   f"ps2 AS (SELECT qid, id FROM pd WHERE id <> qid QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(d, 9), id) <= {RERANK})",
                   "px2 AS MATERIALIZED (SELECT qid, ps2.id, list_distance(qv, v) AS d FROM ps2 JOIN q USING (qid) JOIN v ON v.id = ps2.id)"], "px2"),
    }
    for name, (ctes, table) in high.items():
        out[f"high_recall_{name}"] = O.query([*ctes, *O.truth(N), *O.scored(table, N)], "SELECT round(avg_af, 6) AS avg_af, round(af_found, 6) AS af_found, n_found, round(recall_at_n, 6) AS recall_at_n FROM e")
    return out


#: What FLAGS are parsed to, written apart from the parser.
ECHO = {
    "data": "base.fvecs", "queries": "query.fvecs", "output": "results.txt", "kind": "sift", "method": "hypercube", "n": "3", "radius": "1.5", "do_range": "True",
    "graph": "False", "max_data": "10000", "max_queries": "None",
    "lsh.tables": "5", "lsh.hashes": "4", "lsh.width": "2.0", "lsh.seed": "1",
    "cube.projections": "10", "cube.width": "2.0", "cube.max_candidates": "50", "cube.max_probes": "4", "cube.seed": "1", "cube.bits": "hash",
    "ivf.clusters": "50", "ivf.nprobe": "5", "ivf.seed": "1", "ivf.max_iters": "100", "ivf.tol": "0.0001", "ivf.empty": "farthest",
    "pq.parts": "50", "pq.bits": "8", "pq.seed": "1337", "pq.max_iters": "100", "pq.tol": "0.0001", "pq.sample": "20000", "pq.empty": "farthest",
}
ECHO_P = CubeParams(projections=10, width=2.0, max_candidates=50, max_probes=4, seed=1)

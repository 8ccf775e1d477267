"""Command line: ``python -m stratavec.cli search ...``, ``best-k ...`` and ``summary ...``."""

from __future__ import annotations

import logging
import sys
from dataclasses import replace

from pyspark.sql import SparkSession

from .operators.base import Index
from .operators.cube import Hypercube
from .operators.evaluate import run_queries, with_true_distance
from .operators.graph import graph_lines, knn_graph
from .operators.kmeans import SAMPLE_ROWS
from .operators.ivf import IVFFlat, sweep
from .operators.lsh import LSH
from .operators.pq import IVFPQ
from .operators.summary import parse_reports, summarised
from .plans.params import KMeansParams, SearchParams
from .sources import charts, reports
from .sources.vectors import kind_of, load_vectors

log = logging.getLogger("stratavec")

#: The numbers of clusters that a sweep tries.
SWEEP = [2, 5, 10, 50, 100, 200, 500]

METHOD_FLAGS = {"-lsh": "lsh", "-hypercube": "hypercube", "-ivfflat": "ivfflat", "-ivfpq": "ivfpq"}
GRAPH_FLAGS = ("-knngraph", "--knn-graph-mode")


def parse_search(args: list[str]) -> SearchParams:
    """Flags to parameters. Unknown flags are named in a warning and passed over; of several
    methods the first of LSH, cube, IVF-Flat and IVF-PQ is used."""
    p = SearchParams()
    methods, rest = set(), list(args)

    def value() -> str:
        if not rest:
            raise ValueError(f"{flag} needs a value")
        return rest.pop(0)

    while rest:
        flag = rest.pop(0)
        if flag in METHOD_FLAGS:
            methods.add(METHOD_FLAGS[flag])
        elif flag in GRAPH_FLAGS:
            p = replace(p, graph=True)
        elif flag == "-d":
            p = replace(p, data=value())
        elif flag == "-q":
            p = replace(p, queries=value())
        elif flag == "-o":
            p = replace(p, output=value())
        elif flag == "-type":
            p = replace(p, kind=value())
        elif flag == "-N":
            p = replace(p, n=int(value()))
        elif flag == "-R":
            p = replace(p, radius=float(value()))
        elif flag == "-range":
            p = replace(p, do_range=value().lower() == "true")
        elif flag == "-seed":
            s = int(value())
            p = replace(p, lsh=replace(p.lsh, seed=s), cube=replace(p.cube, seed=s), ivf=replace(p.ivf, seed=s))
        elif flag == "-k":
            p = replace(p, lsh=replace(p.lsh, hashes=int(value())))
        elif flag == "-L":
            p = replace(p, lsh=replace(p.lsh, tables=int(value())))
        elif flag == "-w":
            w = float(value())
            p = replace(p, lsh=replace(p.lsh, width=w), cube=replace(p.cube, width=w))
        elif flag == "-kproj":
            p = replace(p, cube=replace(p.cube, projections=int(value())))
        elif flag == "-M":
            m = int(value())
            p = replace(p, cube=replace(p.cube, max_candidates=m), pq=replace(p.pq, parts=m))
        elif flag == "-probes":
            p = replace(p, cube=replace(p.cube, max_probes=int(value())))
        elif flag == "-kclusters":
            p = replace(p, ivf=replace(p.ivf, clusters=int(value())))
        elif flag == "-nprobe":
            p = replace(p, ivf=replace(p.ivf, nprobe=int(value())))
        elif flag == "-nbits":
            p = replace(p, pq=replace(p.pq, bits=int(value())))
        elif flag == "-max":
            limit = int(value())
            p = replace(p, max_data=None if limit < 0 else limit)
        elif flag == "-maxq":
            limit = int(value())
            p = replace(p, max_queries=None if limit < 0 else limit)
        else:
            log.warning("unknown flag %s", flag)
    chosen = next((m for m in METHOD_FLAGS.values() if m in methods), None)
    return replace(p, method=chosen)


def build(p: SearchParams, vectors) -> Index:
    if p.method == "lsh":
        return LSH(params=p.lsh).build_index(vectors)
    if p.method == "hypercube":
        return Hypercube(params=p.cube).build_index(vectors)
    if p.method == "ivfflat":
        return IVFFlat(p.ivf).build_index(vectors)
    return IVFPQ(p.ivf, p.pq).build_index(vectors)


def search(spark: SparkSession, args: list[str]) -> int:
    p = parse_search(args)
    if p.method is None:
        log.error("name a method: %s", " ".join(METHOD_FLAGS))
        return 1
    for name, value in p.echo():
        log.info("%s = %s", name, value)
    vectors = load_vectors(spark, p.data, p.kind, p.max_data).persist()
    if vectors.isEmpty():
        log.warning("%s holds no vectors", p.data)
    index = build(p, vectors)
    if p.graph:
        reports.write_lines(graph_lines(knn_graph(index, p.lsh.hashes)), f"knn_graph_{p.kind}.csv" if p.output == "results.txt" else p.output)
        return 0
    rows = load_vectors(spark, p.queries, p.kind, p.max_queries)
    queries = rows.withColumnsRenamed({"id": "qid", "vec": "qvec"}).persist()
    run = run_queries(index, vectors, queries, p.n, p.effective_radius if p.do_range else None, p.method, p.kind)
    hits = with_true_distance(run.knn, vectors, queries)
    reports.write_report(p.output, reports.TITLES[p.method], reports.query_blocks(hits, queries, run.ranges), run.metrics)
    return 0


def best_k(spark: SparkSession, args: list[str]) -> int:
    path, limit, rest = None, 10_000, list(args)
    while rest:
        flag = rest.pop(0)
        if flag == "-d" and rest:
            path = rest.pop(0)
        elif flag == "-n" and rest:
            limit = int(rest.pop(0))
        else:
            log.warning("unknown flag %s", flag)
    if path is None:
        log.error("name a file: -d file [-n rows]")
        return 1
    kind = kind_of(path)
    vectors = load_vectors(spark, path, kind, limit).persist()
    ks = [k for k in SWEEP if k <= vectors.count()]
    # A sample that the limit keeps small is clustered where the driver is.
    local = SAMPLE_ROWS if limit is not None and 0 <= limit <= SAMPLE_ROWS else 0
    scores = sweep(vectors, ks, KMeansParams(2, max_iters=100, seed=42), local)
    reports.write_sweep(spark.createDataFrame(scores, "k int, silhouette double"), f"silhouette_results_{kind}.txt")
    return 0


def summary(spark: SparkSession, args: list[str]) -> int:
    glob, folder, rest = None, "plots", list(args)
    while rest:
        flag = rest.pop(0)
        if flag == "-r" and rest:
            glob = rest.pop(0)
        elif flag == "-o" and rest:
            folder = rest.pop(0)
        else:
            log.warning("unknown flag %s", flag)
    if glob is None:
        log.error("name reports: -r glob [-o folder]")
        return 1
    table = parse_reports(reports.read_reports(spark, glob)).persist()
    reports.write_table(table, f"{folder}/results_table")
    for path in charts.write_charts(summarised(table), folder):
        log.info("wrote %s", path)
    return 0


COMMANDS = {"search": search, "best-k": best_k, "summary": summary}


def main(args: list[str]) -> int:
    logging.basicConfig(level=logging.INFO)
    if not args or args[0] not in COMMANDS:
        log.error("name a command: %s", " ".join(COMMANDS))
        return 1
    spark = SparkSession.builder.appName("stratavec").getOrCreate()
    return COMMANDS[args[0]](spark, args[1:])


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

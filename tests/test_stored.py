"""Stored indexes: folders that are read, and insertions and deletions against a rebuild."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavec.operators.cube import Hypercube
from stratavec.operators.ivf import IVFFlat
from stratavec.operators.lsh import LSH
from stratavec.operators.pq import IVFPQ
from stratavec.plans.params import CubeParams, IvfParams, LshParams, PqParams
from stratavec.sources import indexes

DIM = 6
MAKERS = {
    "lsh": lambda v: LSH(DIM, LshParams(tables=3, hashes=3, width=3.0)).build_index(v),
    "cube": lambda v: Hypercube(DIM, CubeParams(projections=7, width=2.0, max_candidates=40, max_probes=9)).build_index(v),
    "ivf": lambda v: IVFFlat(IvfParams(clusters=9, nprobe=2, max_iters=5)).build_index(v),
    "ivfpq": lambda v: IVFPQ(IvfParams(clusters=9, nprobe=2, max_iters=5), PqParams(parts=3, bits=3, max_iters=5)).build_index(v),
}


@pytest.fixture(scope="module")
def v(spark):
    x = np.random.default_rng(3).standard_normal((900, DIM)) * 3
    return spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "id long, vec array<double>").persist()


@pytest.fixture(scope="module")
def one(v):
    return v.where("id = 17").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


@pytest.fixture(scope="module")
def some(v):
    return v.where("id % 40 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def answers(index, queries):
    return sorted((r["qid"], r["rank"], r["id"], round(r["dist"], 9)) for r in index.knn_query(queries, 5).collect())


def folders_of(df):
    return df.select(F.input_file_name().alias("f")).distinct().collect()


@pytest.mark.parametrize("name", sorted(MAKERS))
def test_a_search_reads_the_folders_of_its_probes_only(spark, v, one, tmp_path, name):
    built = MAKERS[name](v)
    path = f"{tmp_path}/{name}"
    indexes.write_index(built, path, 32)
    index = indexes.read_index(spark, path)
    assert answers(index, one) == answers(built, one)
    every = len(folders_of(index.rows))
    if name == "lsh":
        probes = index.identified(one, "qid", "qvec").select("qid", F.posexplode("hids").alias("tbl", "hid"))
        assert len(index.stored.folders(probes, "rows")) == 3  # one a table
        read = index.stored.table("rows", index.stored.folders(probes, "rows"))
    elif name == "cube":
        read = index.named(index.probes(one))
    else:
        read = index.named(index.coarse.probes(one))
    assert 0 < len(folders_of(read)) < every / 2
    # The folders are partition filters of the scan, whatever is broadcast.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = index.knn_query(one, 5)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    filters = re.findall(r"PartitionFilters: \[([^\]]*)\]", plan)
    assert any("folder" in f for f in filters), plan


@pytest.mark.parametrize("name", sorted(MAKERS))
def test_insertions_and_deletions_equal_a_rebuild(spark, v, some, tmp_path, name):
    built = MAKERS[name](v)
    path = f"{tmp_path}/{name}"
    indexes.write_index(built, path, 8)
    indexes.delete(spark, path, v.where("id % 5 = 1").select("id"))
    indexes.insert(spark, path, v.where("id % 10 = 1"))
    indexes.delete(spark, path, v.where("id = 11 OR id = 40").select("id").union(spark.range(5000, 5003)))
    indexes.insert(spark, path, v.where("id = 11"))
    live = v.where("id % 10 <> 6 AND id <> 40")
    # What a rebuild would hold: the same parameters over the live rows.
    if name in ("lsh", "cube"):
        want = MAKERS[name](live)
    else:
        want = MAKERS[name](v)
        want.vectors, want.rows = live, (want.coarse.lists(live) if name == "ivf" else want.encoded(live))
    index = indexes.read_index(spark, path)
    assert index.vectors.count() == live.count()
    assert answers(index, some) == answers(want, some)
    assert sorted(map(tuple, index.range_search(some, 4.0).select("qid", "id").collect())) == sorted(map(tuple, want.range_search(some, 4.0).select("qid", "id").collect()))
    assert sorted(map(tuple, index.nn_query(some).collect())) == sorted(map(tuple, want.nn_query(some).collect()))
    indexes.compact(spark, path, f"{path}-compact")
    again = indexes.read_index(spark, f"{path}-compact")
    assert not again.stored.deleted and again.stored.last == 0
    assert answers(again, some) == answers(want, some)


def test_hot_lists_are_written_by_several_tasks(spark, v, tmp_path, monkeypatch):
    monkeypatch.setattr(indexes, "TASK_ROWS", 20)
    index = MAKERS["ivf"](v)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        indexes.write_index(index, f"{tmp_path}/hot", 8)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = [r["f"] for r in folders_of(indexes.read_index(spark, f"{tmp_path}/hot").rows)]
    most = max(len([f for f in files if f"folder={c}/" in f]) for c in range(9))
    assert most > 1


def test_empty_indexes_are_stored_and_refuse_insertions(spark, v, some, tmp_path):
    empty = v.limit(0)
    for name, index in (("lsh", LSH(params=LshParams()).build_index(empty)), ("ivf", IVFFlat(IvfParams(clusters=3)).build_index(empty))):
        indexes.write_index(index, f"{tmp_path}/{name}")
        assert indexes.read_index(spark, f"{tmp_path}/{name}").knn_query(some, 3).collect() == []
        with pytest.raises(ValueError):
            indexes.insert(spark, f"{tmp_path}/{name}", v)
    with pytest.raises(ValueError):
        indexes.write_index(MAKERS["lsh"](v), f"{tmp_path}/bad", 12)

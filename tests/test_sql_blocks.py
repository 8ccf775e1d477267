"""Statements go by blocks: no pair that is not an answer is a row of its own."""

import numpy as np

from stratavec.operators.ivf import IVFFlat
from stratavec.plans.params import IvfParams
from stratavec.sources import sql
from stratavec.sources.indexes import write_index


def test_statements_meet_shards_of_lists(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sql, "SHARD_ROWS", 20, raising=False)
    monkeypatch.setattr(sql, "ASKED_ROWS", 5, raising=False)
    x = np.random.default_rng(3).standard_normal((200, 4))
    x[90:120] = x[7]
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    q = v.where("id % 9 = 0").selectExpr("id AS qid", "vec AS qvec")
    odd = spark.createDataFrame([(1001, None), (1002, [1.0]), (1003, [1.0, None, 0.0, 0.0])], "qid long, qvec array<double>")
    q.unionByName(odd).createOrReplaceTempView("b_asked")
    index = IVFFlat(IvfParams(3, 2)).build_index(v)
    write_index(index, str(tmp_path / "i"))
    sql.register_search(spark, "b", str(tmp_path / "i"))
    found = spark.sql(sql.nearest_sql("b", "b_asked", 4))
    assert "b_nearest" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.select("qid", "rank", "id").collect())) == sorted(map(tuple, index.knn_query(q, 4).select("qid", "rank", "id").collect()))
    assert sorted(map(tuple, spark.sql(sql.within_sql("b", "b_asked", 1.5)).select("qid", "id").collect())) == sorted(map(tuple, index.range_search(q, 1.5).select("qid", "id").collect()))

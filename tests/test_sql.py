import numpy as np
import pytest

from stratavec.operators.ivf import IVFFlat
from stratavec.operators.lsh import LSH
from stratavec.plans.params import IvfParams, LshParams
from stratavec.sources.indexes import delete, insert, write_index
from stratavec.sources.sql import nearest_sql, register_search, within_sql


def vectors(spark, n=200, dim=4):
    x = np.random.default_rng(3).standard_normal((n, dim))
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")


def asked(spark, v):
    q = v.where("id % 9 = 0").selectExpr("id AS qid", "vec AS qvec")
    q.createOrReplaceTempView("t_asked")
    return q


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_statements_give_the_answers_of_the_index(spark, tmp_path):
    v = vectors(spark)
    q = asked(spark, v)
    index = IVFFlat(IvfParams(6, 2)).build_index(v)
    write_index(index, str(tmp_path / "i"))
    register_search(spark, "t", str(tmp_path / "i"))
    assert rows(spark.sql(nearest_sql("t", "t_asked", 3)), "qid", "rank", "id") == rows(index.knn_query(q, 3), "qid", "rank", "id")
    assert rows(spark.sql(within_sql("t", "t_asked", 1.0)), "qid", "id") == rows(index.range_search(q, 1.0), "qid", "id")


def test_live_rows_after_updates(spark, tmp_path):
    v = vectors(spark)
    asked(spark, v)
    write_index(IVFFlat(IvfParams(6, 6)).build_index(v), str(tmp_path / "i"))
    delete(spark, str(tmp_path / "i"), v.where("id < 50").select("id"))
    insert(spark, str(tmp_path / "i"), v.where("id < 20"))
    register_search(spark, "t", str(tmp_path / "i"))
    found = {r["id"] for r in spark.sql(within_sql("t", "t_asked", 100)).collect()}
    assert found == {*range(20), *range(50, 200)}


def test_the_plan_joins_on_the_list_and_prunes_before_the_shuffle(spark, tmp_path):
    v = vectors(spark)
    asked(spark, v)
    write_index(IVFFlat(IvfParams(6, 2)).build_index(v), str(tmp_path / "i"))
    register_search(spark, "t", str(tmp_path / "i"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = spark.sql(nearest_sql("t", "t_asked", 3))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "SortMergeJoin [list" in plan
    assert "WindowGroupLimit" in plan and "Partial" in plan
    # A table of queries that is filtered lets Spark read the folders of the probed lists only.
    pruned = spark.sql("SELECT r.id FROM (SELECT explode(lists) AS list FROM (SELECT t_lists(qvec) AS lists FROM t_asked)) q, LATERAL t_candidates(q.list) r WHERE q.list = 1")
    assert "folder#" in pruned._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[-1].split("]")[0]


def test_null_queries_repeats_and_empty_tables(spark, tmp_path):
    v = vectors(spark)
    write_index(IVFFlat(IvfParams(6, 2)).build_index(v), str(tmp_path / "i"))
    register_search(spark, "t", str(tmp_path / "i"))
    spark.createDataFrame([(1, None)], "qid long, qvec array<double>").createOrReplaceTempView("t_null")
    assert spark.sql(nearest_sql("t", "t_null", 3)).count() == 0
    assert spark.sql(nearest_sql("t", "(SELECT * FROM t_null LIMIT 0)", 3)).count() == 0
    write_index(IVFFlat(IvfParams(6, 2)).build_index(v.limit(0)), str(tmp_path / "none"))
    register_search(spark, "e", str(tmp_path / "none"))
    asked(spark, v)
    assert spark.sql(nearest_sql("e", "t_asked", 3)).count() == 0


def test_what_is_refused(spark, tmp_path):
    v = vectors(spark)
    write_index(LSH(4, LshParams(2, 2, 2.0)).build_index(v), str(tmp_path / "i"))
    with pytest.raises(ValueError):
        register_search(spark, "t", str(tmp_path / "i"))
    with pytest.raises(ValueError):
        register_search(spark, "t; x", str(tmp_path / "i"))

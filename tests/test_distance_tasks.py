"""A large table of distances is dealt to many tasks, however few the input has."""

import numpy as np
from pyspark.sql import functions as F

from stratavec.operators import search


def test_no_task_hands_on_most_of_a_large_table(spark, monkeypatch):
    monkeypatch.setattr(search, "TASK_ROWS", 1024 * 5, raising=False)
    x = np.random.default_rng(4).standard_normal((16 * 1024, 2))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>").coalesce(1)
    q = v.where("id % 4096 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    table = search.distance_table(v, q, 6).withColumn("task", F.spark_partition_id()).persist()
    assert table.count() == table.select("qid", "id").distinct().count() == 4 * len(x)
    assert max(r["count"] for r in table.groupBy("task").count().collect()) <= 4 * len(x) // 3
    for r in table.where("id % 1000 = 7").collect():
        d = x[r["qid"]] - x[r["id"]]
        assert abs(r["l2sq"] - d @ d) < 1e-6 and abs(r["l2"] - np.sqrt(d @ d)) < 1e-6 and abs(r["dot"] - x[r["qid"]] @ x[r["id"]]) < 1e-6
    table.unpersist()

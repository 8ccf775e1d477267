"""The table of distances is taken block by block, not by expressions on every pair."""

import numpy as np
from pyspark.sql import functions as F

from stratavec.operators import search


def test_distances_are_taken_by_blocks(spark):
    x = np.random.default_rng(3).standard_normal((60, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    q = v.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    table = search.distance_table(v, q)
    assert "MapInArrow" in table._jdf.queryExecution().executedPlan().toString()
    for r in table.collect():
        d = x[r["qid"]] - x[r["id"]]
        assert abs(r["l2sq"] - d @ d) < 1e-9 and abs(r["l2"] - np.sqrt(d @ d)) < 1e-9 and abs(r["dot"] - x[r["qid"]] @ x[r["id"]]) < 1e-9
    assert table.count() == 180

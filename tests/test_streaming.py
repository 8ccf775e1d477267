import numpy as np

from stratavec.operators.ivf import IVFFlat
from stratavec.plans.params import IvfParams
from stratavec.streaming.knn import answer_stream


def test_stream_gives_the_answers_of_a_batch(spark, tmp_path):
    x = np.random.default_rng(5).standard_normal((80, 4))
    data = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>").persist()
    index = IVFFlat(IvfParams(3, 2)).build_index(data)
    asked = data.where("id % 8 = 0").selectExpr("id AS qid", "vec AS qvec")
    asked.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    answer_stream(stream, index, 3, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("qid", "rank", "id").collect()
    assert sorted(got) == sorted(index.knn_query(asked, 3).select("qid", "rank", "id").collect()) and len(got) == 30

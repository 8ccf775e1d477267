import numpy as np

from stratavec.operators.search import exact_knn
from stratavec.streaming import standing
from stratavec.streaming.standing import ANSWERS, current, keep_standing, merged


def rows(df):
    return sorted((r["qid"], r["rank"], r["id"], round(r["dist"], 9)) for r in df.collect())


def table(spark, n=120, seed=5):
    x = np.random.default_rng(seed).integers(-3, 4, (n, 3)).astype(float)  # with ties
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")


def run(spark, folder, queries, n=4):
    arriving = spark.readStream.schema("id long, vec array<double>").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    keep_standing(arriving, queries, n, f"{folder}/out", f"{folder}/check").awaitTermination(240)
    return spark.read.schema(f"{ANSWERS}, batch long").parquet(f"{folder}/out")


def asked(v):
    return v.where("id % 10 = 0").selectExpr("id AS qid", "vec AS qvec")


def test_standing_answers_equal_a_batch_and_a_restart_goes_on(spark, tmp_path):
    v = table(spark)
    v.where("id >= 60").repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
    half = current(run(spark, tmp_path, asked(v)))
    assert rows(half) == rows(exact_knn(v.where("id >= 60"), asked(v), 4))
    # More files arrive, among them rows that were there before; a new stream goes on from the checkpoint.
    v.where("id < 80").repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
    whole = run(spark, tmp_path, asked(v))
    assert rows(current(whole)) == rows(exact_knn(v, asked(v), 4))
    assert whole.select("batch").distinct().count() > 1


def test_many_queries_meet_the_stream_on_lanes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(standing, "SMALL_BYTES", 100)
    v = table(spark)
    v.repartition(2).write.parquet(f"{tmp_path}/in")
    assert rows(current(run(spark, tmp_path, asked(v)))) == rows(exact_knn(v, asked(v), 4))


def test_streams_and_queries_without_rows(spark, tmp_path):
    v = table(spark)
    v.limit(0).write.parquet(f"{tmp_path}/in")
    arriving = spark.readStream.schema(v.schema).parquet(f"{tmp_path}/in")
    keep_standing(arriving, asked(v), 4, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(240)
    v.write.mode("append").parquet(f"{tmp_path}/in2")
    arriving = spark.readStream.schema(v.schema).parquet(f"{tmp_path}/in2")
    keep_standing(arriving, asked(v).limit(0), 4, f"{tmp_path}/out2", f"{tmp_path}/check2").awaitTermination(240)
    assert spark.read.schema(f"{ANSWERS}, batch long").parquet(f"{tmp_path}/out2").count() == 0


def test_merged_counts_an_id_once_and_breaks_ties_by_id():
    ids, dists = merged(np.array([7, 3, 7, 5]), np.array([1.0, 1.0, 1.0, 0.5]), 3)
    assert ids.tolist() == [5, 3, 7] and dists.tolist() == [0.5, 1.0, 1.0]

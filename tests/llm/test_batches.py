import pyarrow as pa

from stratavec.llm.arrow import BATCH_BYTES, map_batches, map_rows, parsed_bytes
from stratavec.llm.near_dedup import drop_near_duplicates, near_groups
from stratavec.llm.packing import pack_with_public
from stratavec.llm.toxicity import drop_toxic, toxicity

LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_are_bounded_by_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [b.num_rows], "bytes": [b.nbytes]})

    spark.conf.unset(LIMIT)
    long = spark.range(0, 3000, 1, 1).selectExpr("id", "repeat('abcdefgh', 1000) AS text")
    got = map_batches(long, sizes, "rows long, bytes long").collect()
    assert sum(r["rows"] for r in got) == 3000 and max(r["bytes"] for r in got) <= BATCH_BYTES + 10_000
    giant = spark.range(0, 3, 1, 1).selectExpr("id", f"repeat('abcdefgh', {BATCH_BYTES // 4}) AS text")
    got = map_batches(giant, sizes, "rows long, bytes long").collect()
    assert [r["rows"] for r in got if r["rows"]] == [1, 1, 1]


def test_operators_bound_their_batches(spark, documents):
    labels = spark.createDataFrame([(1, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents([(i, f"some text of row {i % 3} and a few more words") for i in range(20)])
    for query in (lambda: drop_toxic(docs, labels), lambda: toxicity(docs, labels), lambda: near_groups(docs), lambda: drop_near_duplicates(docs), lambda: pack_with_public(docs)):
        spark.conf.unset(LIMIT)
        query()
        assert parsed_bytes(spark.conf.get(LIMIT)) <= BATCH_BYTES


def test_size_of_batches_leaves_results_alone(spark, documents, odd):
    labels = spark.createDataFrame([(1, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    for query in (lambda: toxicity(odd, labels), lambda: drop_toxic(odd, labels), lambda: near_groups(odd), lambda: pack_with_public(odd)):
        found = []
        for limit in (str(BATCH_BYTES), "1k"):
            spark.conf.set(LIMIT, limit)
            found.append(sorted(map(str, query().collect())))
        assert found[0] == found[1]
    spark.conf.unset(LIMIT)


def test_a_smaller_limit_stays(spark):
    spark.conf.set(LIMIT, "1m")
    map_rows(spark.range(3), "id long", lambda ids: ((i,) for i in ids))
    assert spark.conf.get(LIMIT) == "1m"
    spark.conf.unset(LIMIT)
    assert [parsed_bytes(x) for x in ("4194304", "64m", "67108864b", "2 kb", "0", "-1", None)] == [4194304, 64 << 20, 64 << 20, 2048, None, None, None]

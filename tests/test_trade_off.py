"""Speed against quality is shown by means of a dataset and method, not report by report."""

from stratavec.operators import summary


def test_trade_off_takes_means_by_dataset_and_method(spark):
    reports = spark.createDataFrame([
        ("results_lsh_sift_true.txt", "Average AF: 1.5\nQPS: 100\n"),
        ("results_lsh_sift_false.txt", "Average AF: 2.5\nQPS: 300\n"),
        ("results_lsh_mnist_true.txt", "Average AF: 4\n"),
        ("results_ivfpq_sift.txt", "QPS: 7"),
        ("results_ivfpq_sift_true.txt", "Average AF: 3\nQPS: 9"),
    ], "name string, text string")
    got = summary.trade_off(summary.parse_reports(reports))
    assert got.columns == ["method", "dataset", "qps", "avg_af"]
    assert sorted(tuple(r) for r in got.collect()) == [("IVFPQ", "SIFT", 8.0, 3.0), ("LSH", "MNIST", None, 4.0), ("LSH", "SIFT", 200.0, 2.0)]

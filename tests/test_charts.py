import re
import xml.etree.ElementTree as ET

from stratavec import cli
from stratavec.sources import charts

ROWS = [
    {"dataset": d, "method": m, "avg_af": a, "recall_at_n": r, "qps": q, "t_approx_ms": 1.5, "t_true_ms": None}
    for d, m, a, r, q in [("MNIST", "LSH", 1.1, 0.5, 200.0), ("MNIST", "IVFPQ", 1.4, 0.25, 900.0), ("SIFT", "LSH", 1.05, 0.75, 100.0), ("SIFT", "Unknown", None, None, None)]
]


def bars(drawing, colour=None):
    # Bars lie left of the legend.
    return [b for b in drawing if b[0] == "box" and b[1] < charts.WIDTH - charts.RIGHT and colour in (None, b[5])]


def test_bars_are_as_tall_as_their_values():
    drawing = charts.bar_chart(ROWS, "recall_at_n")
    tall = sorted(b[4] for b in bars(drawing))
    assert len(tall) == 3 and abs(tall[1] / tall[0] - 2) < 1e-9 and abs(tall[2] / tall[0] - 3) < 1e-9
    assert {"0.500", "0.250", "0.750"} <= {t[5] for t in drawing if t[0] == "text"}
    assert all(charts.LEFT <= b[1] and b[1] + b[3] <= charts.WIDTH - charts.RIGHT and b[2] >= charts.TOP for b in bars(drawing))
    assert bars(charts.bar_chart(ROWS, "t_true_ms")) == [] and bars(charts.bar_chart([], "qps")) == []


def test_scatter_leaves_out_missing_means():
    assert len(bars(charts.scatter_chart(ROWS))) == 3 and bars(charts.scatter_chart([])) == []


def test_files(spark, tmp_path):
    schema = "dataset string, method string, avg_af double, recall_at_n double, qps double, t_approx_ms double, t_true_ms double"
    names = [part.split()[0] for part in schema.split(", ")]
    for rows in (ROWS, []):
        df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
        paths = charts.write_charts(df, str(tmp_path / "plots"))
        assert len(paths) == 7
        for path in paths[:-1]:
            assert ET.parse(path).getroot().tag.endswith("svg")
        data = open(paths[-1], "rb").read()
        start = int(re.search(rb"startxref\n(\d+)\n%%EOF", data)[1])
        assert data.startswith(b"%PDF-1.4") and data[start:].startswith(b"xref") and data.count(b"/Type /Page ") == 6
        for i, at in enumerate(re.findall(rb"(\d{10}) 00000 n ", data), 1):
            assert data[int(at):].startswith(b"%d 0 obj" % i)
        for length, body in re.findall(rb"<< /Length (\d+) >>\nstream\n(.*?)\nendstream", data, re.S):
            assert int(length) == len(body)


def test_summary_command(spark, tmp_path):
    for name, af in (("results_lsh_sift_true.txt", 1.25), ("results_ivfpq_mnist_false.txt", 1.5)):
        (tmp_path / name).write_text(f"title\nAverage AF: {af}\nRecall@N: 0.5\nQPS: 10\ntApproximateAverage: 1 ms\ntTrueAverage: 2 ms\n")
    out = str(tmp_path / "out")
    assert cli.summary(spark, ["-r", str(tmp_path / "results_*.txt"), "-o", out]) == 0
    assert spark.read.csv(out + "/results_table", header=True).count() == 2
    assert "1.250" in open(out + "/avg_af.svg").read()
    assert cli.summary(spark, []) == 1

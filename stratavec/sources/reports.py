"""Text reports: writers of results, graphs and sweeps, and readers of what they write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TITLES = {"lsh": "LSH", "ivfflat": "IVFFlat", "ivfpq": "IVFPQ", "hypercube": "Hypercube"}


def query_blocks(hits: DataFrame, queries: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """(qid, text) of hits (qid, rank, id, dist, true_dist): a query's lines in a report."""
    line = F.format_string("Nearest neighbor-%d: %d\ndistanceApproximate: %.6f\ndistanceTrue: %.6f\n", "rank", "id", "dist", "true_dist")
    listed = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    rows = queries.select("qid").join(listed, "qid", "left")
    body = F.coalesce(F.array_join(F.transform("lines", lambda x: x["line"]), ""), F.lit(""))
    tail = F.lit("\n")
    if ranges is not None:
        near = ranges.groupBy("qid").agg(F.array_sort(F.collect_list("id")).alias("near"))
        rows = rows.join(near, "qid", "left")
        ids = F.coalesce(F.array_join(F.transform("near", lambda i: F.concat(i.cast("string"), F.lit("\n"))), ""), F.lit(""))
        tail = F.concat(F.lit("R-near neighbors:\n"), ids, F.lit("\n"))
    return rows.select("qid", F.concat(F.format_string("Query: %d\n", "qid"), body, tail).alias("text"))


def footer(metrics: DataFrame) -> DataFrame:
    """(text): the five measures, with six decimals."""
    return metrics.select(F.format_string(
        "Average AF: %.6f\nRecall@N: %.6f\nQPS: %.6f\ntApproximateAverage: %.6f ms\ntTrueAverage: %.6f ms\n",
        "avg_af", "recall_at_n", "qps", "t_approx_ms", "t_true_ms").alias("text"))


def report_lines(title: str, blocks: DataFrame, metrics: DataFrame) -> DataFrame:
    """(place, text) of a whole report: the title, the queries in order, the footer."""
    spark = blocks.sparkSession
    head = spark.createDataFrame([(-1, title)], "place long, text string")
    body = blocks.select(F.col("qid").cast("long").alias("place"), F.expr("substr(text, 1, length(text) - 1)").alias("text"))
    tail = footer(metrics).select(F.lit(9223372036854775807).alias("place"), F.expr("substr(text, 1, length(text) - 1)").alias("text"))
    return head.unionByName(body).unionByName(tail)


def write_report(path: str, title: str, blocks: DataFrame, metrics: DataFrame) -> None:
    """The report as one text file in the folder ``path``, in order."""
    lines = report_lines(title, blocks, metrics).orderBy("place").select("text")
    lines.coalesce(1).write.mode("overwrite").text(path)


def read_reports(spark: SparkSession, glob: str) -> DataFrame:
    """(name, text) of whole report files; a report that was written as a folder has the folder's name."""
    path = F.col("_metadata.file_path")
    name = F.regexp_extract(F.regexp_replace(path, r"/part-[^/]*$", ""), r"([^/]+)$", 1)
    return spark.read.text(glob, wholetext=True).select(name.alias("name"), F.col("value").alias("text"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def write_sweep(scores: DataFrame, path: str) -> None:
    """(k, silhouette) with a header, separated by a space."""
    scores.select("k", "silhouette").coalesce(1).write.mode("overwrite").csv(path, sep=" ", header=True)


def read_sweeps(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(k, silhouette, type): sweeps read together, each tagged with the dataset that its path names."""
    rows = spark.read.csv(paths, sep=" ", header=True, schema="k int, silhouette double")
    kind = F.regexp_extract(F.col("_metadata.file_path"), r"(?i)silhouette_results_([a-z0-9]+)", 1)
    return rows.select("k", "silhouette", kind.alias("type"))


def write_table(table: DataFrame, path: str) -> None:
    """A table as CSV with a header; a path that ends in .xlsx is written as a workbook by pandas,
    where an engine for it is installed."""
    if path.endswith(".xlsx"):
        table.toPandas().to_excel(path, index=False)
    else:
        table.coalesce(1).write.mode("overwrite").csv(path, header=True)

"""Result reports read back as a table, and their means by dataset and method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of the measures in a report, and the columns they become.
METRICS = {
    "Average AF": "avg_af",
    "Recall@N": "recall_at_n",
    "QPS": "qps",
    "tApproximateAverage": "t_approx_ms",
    "tTrueAverage": "t_true_ms",
}
METHODS = ["lsh", "hypercube", "ivfflat", "ivfpq"]
DATASETS = ["mnist", "sift"]


def metric(text: Column, label: str) -> Column:
    """The number after ``label:``; null where it is absent or not a number (inf and nan are not)."""
    found = F.regexp_extract(text, rf"{label}:\s*([0-9.eE+-]+)", 1)
    return F.when(found != "", found.try_cast("double"))


def first_named(name: Column, words: list[str]) -> Column:
    """The first of ``words`` that the name holds, in capitals; Unknown without one."""
    out = F.lit("Unknown")
    for word in reversed(words):
        out = F.when(F.contains(F.lower(name), F.lit(word)), F.lit(word.upper())).otherwise(out)
    return out


def parse_reports(reports: DataFrame) -> DataFrame:
    """(method, dataset, range_search, measures) of reports (name, text), in that column order."""
    name, text = F.col("name"), F.col("text")
    lower = F.lower(name)
    ranged = F.when(F.contains(lower, F.lit("_true")), "True").when(F.contains(lower, F.lit("_false")), "False").otherwise("Unknown")
    return reports.select(
        first_named(name, METHODS).alias("method"), first_named(name, DATASETS).alias("dataset"), ranged.alias("range_search"),
        *[metric(text, label).alias(column) for label, column in METRICS.items()],
    )


def summarised(table: DataFrame) -> DataFrame:
    """Means of the measures by dataset and method; nulls are passed over."""
    return table.groupBy("dataset", "method").agg(*[F.avg(c).alias(c) for c in METRICS.values()])


def trade_off(table: DataFrame) -> DataFrame:
    """(method, dataset, qps, avg_af): speed against quality, by the means of each dataset and method."""
    return summarised(table).select("method", "dataset", "qps", "avg_af")

"""Exact duplicates by distributed most-significant-digit radix partitioning.

Documents are split by successive bytes of their normalised text. A first pass counts the first 64
bytes of every text (narrow rows, combined on the map side); a text whose beginning nobody shares is
a group of its own and is never shuffled. The others go through rounds: a digit is a window of
bytes, 512 at first and eight times wider in each round, so texts of n bytes take about log8(n)
rounds. A row carries the number of its group and the bytes that no round has read yet; a round
counts the rows of each (group, window) with map-side combining and gives each of them to its rows:
groups that hold more than a fixed part of the rows, which can only be few, by a broadcast, all
others by an equi-join, and rows that are certainly alone by a sieve, without a shuffle. Groups of
one row are done, groups whose text has ended are done; only the rest is written, reread and split
further, under the smallest row number of its group. Equality rests on the bytes, never on a
digest: the sieve only tells which rows may skip the join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, remove_path, written
from .joins import HOT_KEYS, hot_join, sieve, sieved

FIRST_BYTES = 64
WIDTH = 512
GROWTH = 8
#: Windows of hot groups that are broadcast at once take at most so many bytes.
HOT_BYTES = 8_000_000


def normalised(text: Column) -> Column:
    r"""Every run of ``[\x20\x09-\x0D]`` becomes one space; null becomes the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]++", " ")


def _grouped(docs: DataFrame, id_col: str, text_col: str, carried: dict[str, Column]) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, and the columns ``carried``
    (computed from the input's columns and body, the normalised text in UTF-8)."""
    body = docs.select(F.struct(*docs.columns).alias("row")).withColumn("body", normalised(F.col(f"row.{text_col}")).cast("binary"))
    rows = body.select(F.col(f"row.{id_col}").cast("long").alias("doc_id"), "body", *[c.alias(name) for name, c in carried.items()])
    names = list(carried)

    first = F.substring("body", 1, FIRST_BYTES)
    shared = body.select(first.alias("first")).groupBy("first").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bits = written(sieve(shared, "first"), "radix-sieve")
    begun = sieved(rows, bits, first)
    alone = [F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept")]
    done = [begun.where(~F.col("__passes")).select("doc_id", *alone, *names)]
    # Row numbers are made by one scan and written with the rows, so a retried task repeats them.
    stage = written(begun.where("__passes").select(
        "doc_id", F.monotonically_increasing_id().alias("row_id"), F.lit(0).cast("long").alias("group"), F.col("body").alias("rest"),
        *names, F.lit(False).alias("over"), *alone), "radix", "over")

    width = WIDTH
    while True:
        active = stage.where("not over").select("doc_id", "row_id", "group", "rest", *names)
        total = active.count()
        if not total:
            break
        keyed = active.withColumn("window", F.substring("rest", 1, width))
        order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_id"))
        several = keyed.groupBy("group", "window").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("keep")).where("n > 1")
        groups = written(several, "radix-groups")
        marked = sieved(keyed, sieve(groups, "group", "window"), F.col("group"), F.col("window"))
        hot = max(1, min(HOT_KEYS, HOT_BYTES // width))
        met = hot_join(marked.where("__passes"), groups, ["group", "window"], "n", total, "left", hot)
        single = marked.where(~F.col("__passes")).withColumn("n", F.lit(None).cast("long")).withColumn("keep", F.lit(None).cast(groups.schema["keep"].dataType))
        both = met.unionByName(single)
        over = F.col("n").isNull() | (F.length("window") < width)
        following = written(both.select(
            "doc_id", "row_id", F.col("keep.row_id").alias("group"), F.when(~over, F.substring(F.col("rest"), F.lit(width + 1), F.length("rest"))).alias("rest"), *names, over.alias("over"),
            F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
            F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
            F.coalesce(F.col("keep.row_id") == F.col("row_id"), F.lit(True)).alias("kept")), "radix", "over")
        # Finished rows of earlier rounds stay as long as the result may be read.
        discard(groups)
        remove_path(stage.sparkSession, f"{stage.stored_at}/over=false")
        done.append(following.where("over").select("doc_id", "keep_id", "group_size", "kept", *names))
        stage = following
        width *= GROWTH
    return reduce(DataFrame.unionByName, done)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep_id is the smallest id among rows of equal normalised text; exactly one row of each group
    has ``kept``. Null texts count as empty, and all empty texts are equal. Null ids sort after
    all others; rows that repeat an id and a text are members like any other, one of them is
    kept. Empty input gives an empty result. Other columns of the input are not read.
    """
    found = _grouped(docs.select(id_col, text_col), id_col, text_col, {"text_sha256": F.sha2("body", 256)})
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts: the one with the smallest id, null ids
    last; where rows repeat both an id and a text, one of them. The whole row travels beside its
    text, so the decision is taken where the row is and nothing is joined back."""
    return _grouped(docs, id_col, text_col, {"whole": F.col("row")}).where("kept").select("whole.*")


EXACT_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM n
"""

"""Token counts through a digest cache.

Each text is named by the SHA-256 of its content; the tokenizer by a digest of its file and
library. Counts already stored under both are joined; of the others each distinct content is
encoded once, however many rows repeat it, and appended to the cache, a Parquet table in the
shared folder. Content is not altered before it is digested, since any change could change its count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import map_rows
from .common import fresh_path, written
from .joins import HOT_KEYS
from .tokenizer import file_version, load, public_path

CACHE_SCHEMA = "content binary, tokenizer binary, n_tokens long"
LIMIT = 1024


def open_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts: one row per key, also where two runs appended the same key. A path
    without a table is an empty cache."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        rows = spark.read.schema(CACHE_SCHEMA).parquet(path)
    else:
        rows = spark.createDataFrame([], CACHE_SCHEMA)
    return rows.groupBy("content", "tokenizer").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row, from whole texts; null counts as empty.

    New counts are appended to ``cache_path`` before the result is returned. A hot content reaches
    the encoder once: repeats are dropped on the map side before texts are shuffled, and only
    narrow rows (id, size, digest) meet the counts.
    """
    spark = docs.sparkSession
    version = F.lit(bytearray.fromhex(file_version(tokenizer_path)))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    keyed = rows.select("doc_id", "text", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("content"))
    stored = open_cache(spark, cache_path).where(F.col("tokenizer") == version).select("content", "n_tokens")

    distinct = keyed.select("content", "text").dropDuplicates(["content"])
    misses = distinct.join(stored.select("content"), "content", "left_anti")

    def encode(contents, texts):
        tokenizer = load(tokenizer_path)
        for content, body in zip(contents, texts):
            yield content, tokenizer.count(body)

    fresh = map_rows(misses, "content binary, n_tokens long", encode)
    fresh.select("content", version.alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache_path)

    counts = open_cache(spark, cache_path).where(F.col("tokenizer") == version).select("content", "n_tokens")
    narrow = keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    # Contents of more than a fixed part of all rows, which can only be few, are broadcast with their counts.
    sizes = keyed.groupBy("content").agg(F.count(F.lit(1)).alias("n"))
    hot = written(sizes.where(F.col("n") > docs.count() // HOT_KEYS).select("content"), "token-hot")
    few = narrow.join(F.broadcast(counts.join(F.broadcast(hot), "content")), "content")
    others = narrow.join(F.broadcast(hot), "content", "left_anti").join(counts, "content")
    return few.unionByName(others).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def count_tokens_afresh(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """count_tokens with a cache of its own, empty at first: every distinct content is encoded."""
    return count_tokens(docs, public_path(tokenizer), fresh_path(docs.sparkSession, "token-cache"))

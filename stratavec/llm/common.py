"""Helpers shared by the training-data operators: the shared work folder, written tables, folds."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the setting is absent, a local session gets a folder of its own (removed at exit); a
    cluster session is refused, since a machine-local folder would lose rows there.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if sc.applicationId not in _OWN_FOLDERS:
        own = tempfile.mkdtemp(prefix="stratavec-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _OWN_FOLDERS[sc.applicationId] = own
        sc.setCheckpointDir(own)
    return _OWN_FOLDERS[sc.applicationId]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no earlier call has given."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts the lineage at files
    that outlive any executor. ``discard`` deletes the table."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.stored_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    for table in tables:
        remove_path(table.sparkSession, table.stored_at)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a written table through Hadoop's file system, wherever it lies."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo ``folds`` (null ids: fold of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(folds)).cast("int")


def sample_below(doc_id: Column, fraction: float, salt: str) -> Column:
    """A fixed pseudo-random choice of about ``fraction`` of all ids, independent of the folds."""
    point = F.pmod(F.xxhash64(doc_id.cast("string"), F.lit(salt)), F.lit(1 << 30))
    return point < F.lit(int(min(1.0, fraction) * (1 << 30)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

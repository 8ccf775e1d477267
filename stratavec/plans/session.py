"""Session helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDERS: dict[str, str] = {}


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, ``spark.checkpoint.dir``. A local
    session without the setting gets a folder of its own; a cluster session is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if sc.applicationId not in _OWN_FOLDERS:
            _OWN_FOLDERS[sc.applicationId] = tempfile.mkdtemp(prefix="stratavec-")
            atexit.register(shutil.rmtree, _OWN_FOLDERS[sc.applicationId], ignore_errors=True)
        folder = _OWN_FOLDERS[sc.applicationId]
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: it is computed once, and no lost
    executor takes it away."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.path = path
    return table


def remove(table: DataFrame) -> None:
    """Delete a table that ``materialised`` wrote and nothing reads any more."""
    sc = table.sparkSession.sparkContext
    target = sc._jvm.org.apache.hadoop.fs.Path(table.path)
    target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def ship_package(spark: SparkSession, root: str) -> None:
    """Let Python workers that share the driver's files import the package from ``root``.

    On a cluster the package is installed or shipped with --py-files; the extra path is harmless there.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])

"""Indexes on disk. A stored index is searched without being built again, reads the folders that its probes
name, and takes insertions and deletions.

Tables lie in folders by a bounded number of values, and rows are sorted within their files:

* inverted files: by list; a list of many rows is written by several tasks;
* cube: by the first bits of the vertex, which most probes of a query share; the fill of the vertices is a
  table beside it;
* LSH: entries (table, identifier, id) by table and range of identifiers, so a probe reads the
  ranges of its identifiers; vectors by a hash of the id, and only those of hits are fetched.

Folders to read are found before the scan (at most as many values as there are folders), so they are
partition filters of the plan whatever the size of either side.

An insertion is a batch of further files, hashed or assigned by the stored parameters. A deletion is a
table of ids with the last batch that it covers; an id that comes back in a later batch lives. ``compact`` writes
the live rows as a new index. One writer at a time.
"""

from __future__ import annotations

import json
from dataclasses import asdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import MODULUS
from ..operators.base import Index
from ..operators.cube import Hypercube
from ..operators.ivf import CoarseQuantizer, IVFFlat
from ..operators.lsh import LSH
from ..operators.pq import IVFPQ, ProductQuantizer
from ..plans.params import CubeParams, IvfParams, LshParams, PqParams
from ..plans.sizes import broadcast_if_small

KINDS = {LSH: "lsh", Hypercube: "cube", IVFFlat: "ivf", IVFPQ: "ivfpq"}
#: Folders of a table beside lists: at most so many.
FOLDERS = 64
#: Rows of a folder that one task writes.
TASK_ROWS = 1_000_000


class Layout:
    """How the tables of a kind are cut into folders (column ``folder``) and sorted."""

    def __init__(self, about: dict):
        self.kind, self.folders = about["kind"], about["folders"]
        self.bits = about["params"].get("projections", 0)

    def tables(self) -> dict[str, list[str]]:
        """Name of each table with what its rows are sorted by."""
        return {"lsh": {"rows": ["hid"], "vectors": ["id"]}, "cube": {"rows": ["vertex"]}, "ivf": {"rows": ["id"]}, "ivfpq": {"rows": ["id"], "vectors": ["id"]}}[self.kind]

    def folder(self, table: str) -> Column:
        """The folder of a row, or of a probe with the same columns."""
        if table == "vectors":
            return F.pmod(F.xxhash64("id"), F.lit(self.folders)).cast("int")
        if self.kind == "lsh":
            return (F.col("tbl") * self.folders + F.floor(F.col("hid") * self.folders / MODULUS)).cast("int")
        if self.kind == "cube":
            return F.shiftright("vertex", max(0, self.bits - (self.folders.bit_length() - 1))).cast("int")
        return F.col("cid").cast("int")

    def content(self, index: Index, vectors: DataFrame) -> dict[str, DataFrame]:
        """The tables of an index that hold ``vectors``."""
        plain = vectors.select(F.col("id").cast("long").alias("id"), "vec")
        if self.kind == "lsh":
            hashed = index.identified(vectors, "id", "vec", index.engine) if index.dim else vectors.withColumn("hids", F.array().cast("array<long>"))
            return {"rows": hashed.select(F.posexplode("hids").alias("tbl", "hid"), F.col("id").cast("long").alias("id")), "vectors": plain}
        if self.kind == "cube":
            return {"rows": index.placed(vectors, "id", "vec", index.engine) if index.dim else plain.withColumn("vertex", F.lit(0).cast("long"))}
        if self.kind == "ivf":
            return {"rows": index.coarse.lists(vectors)}
        none = not len(index.coarse.centres)
        codes = vectors.select(F.lit(0).alias("cid"), F.col("id").cast("long").alias("id"), F.array().cast("array<int>").alias("codes")) if none else index.encoded(vectors)
        return {"rows": codes, "vectors": plain}


def _append(content: dict[str, DataFrame], layout: Layout, path: str, batch: int) -> None:
    """Write tables as files of a batch. Folders of many rows are dealt out over several tasks."""
    for name, rows in content.items():
        placed = rows.withColumn("folder", layout.folder(name))
        counted = placed.groupBy("folder").agg(F.ceil(F.count(F.lit(1)) / TASK_ROWS).cast("int").alias("parts"))  # a row a folder
        dealt = placed.join(F.broadcast(counted), "folder").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        columns = [c for c in rows.columns if c != "folder"]
        sorted_rows = dealt.repartition("folder", "part").sortWithinPartitions("folder", *layout.tables()[name])
        sorted_rows.select(*columns, "folder").write.partitionBy("folder").mode("errorifexists").parquet(f"{path}/{name}/batch={batch}")
    if layout.kind == "cube":
        fill = content["rows"].groupBy("vertex").agg(F.count(F.lit(1)).alias("n"))
        fill.write.mode("errorifexists").parquet(f"{path}/fill/batch={batch}")


def _log(spark: SparkSession, path: str, batch: int, step: str) -> None:
    spark.createDataFrame([(batch, step)], "batch long, step string").coalesce(1).write.mode("append").parquet(f"{path}/log")


def write_index(index: Index, path: str, folders: int = FOLDERS) -> None:
    """Write a built index below ``path``, which must not exist yet. ``folders``, a power of two, bounds the number of
    folders of a table (LSH: for each hash table)."""
    if folders < 1 or folders & (folders - 1):
        raise ValueError("the number of folders must be a power of two")
    kind = KINDS[type(index)]
    spark = index.rows.sparkSession
    about = {"kind": kind, "params": asdict(index.params), "folders": folders}
    if kind in ("lsh", "cube"):
        about |= {"dim": index.dim, "engine": index.engine}
    else:
        about["centres"] = index.coarse.centres.tolist()
    if kind == "ivfpq" and len(index.coarse.centres):
        about |= {"codebooks": [b.tolist() for b in index.pq.codebooks], "splits": index.pq.splits}
    if kind == "ivfpq":
        about["pq_params"] = asdict(index.pq_params)
    layout = Layout(about)
    content = layout.content(index, index.vectors)
    schemas = {name: rows.schema.json() for name, rows in content.items()}
    spark.createDataFrame([(json.dumps(about), json.dumps(schemas))], "about string, schemas string").coalesce(1).write.parquet(f"{path}/about")
    _append(content, layout, path, 0)
    _log(spark, path, 0, "insert")


class Stored:
    """A stored index's live tables: what a stored search reads."""

    def __init__(self, spark: SparkSession, path: str, layout: Layout, schemas: dict[str, str]):
        self.spark, self.path, self.layout = spark, path, layout
        self.schemas = {name: T.StructType.fromJson(json.loads(s)) for name, s in schemas.items()}
        steps = spark.read.parquet(f"{path}/log").collect()  # a row an insertion or deletion
        self.last = max(r["batch"] for r in steps)
        self.deleted = any(r["step"] == "delete" for r in steps)

    def table(self, name: str, folders: list[int] | None = None, also: tuple[str, ...] = ()) -> DataFrame:
        """Live rows, of the given folders only. ``also`` keeps columns of the layout (folder, batch)."""
        schema = T.StructType([*self.schemas[name].fields, T.StructField("batch", T.LongType()), T.StructField("folder", T.IntegerType())])
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        rows = rows if folders is None else rows.where(F.col("folder").isin(folders) if folders else F.lit(False))
        if self.deleted:
            gone = self.spark.read.schema("id long, through long").parquet(f"{self.path}/gone").groupBy("id").agg(F.max("through").alias("through"))
            gone = broadcast_if_small(gone.withColumnRenamed("id", "gone"))
            rows = rows.join(gone, (F.col("id") == F.col("gone")) & (F.col("batch") <= F.col("through")), "left_anti")
        return rows.select(*self.schemas[name].fieldNames(), *also)

    def folders(self, probes: DataFrame, name: str) -> list[int]:
        """The folders that ``probes`` name: as many values as there are folders at most."""
        return sorted(r[0] for r in probes.select(self.layout.folder(name)).distinct().collect())

    def rows_of(self, probes: DataFrame, name: str = "rows") -> DataFrame:
        """The rows of a table in the folders that ``probes`` name."""
        return self.table(name, self.folders(probes, name))

    def fill(self) -> DataFrame:
        """(vertex, n)"""
        if self.deleted:
            return self.table("rows").groupBy("vertex").agg(F.count(F.lit(1)).alias("n"))
        return self.spark.read.schema("vertex long, n long").parquet(f"{self.path}/fill").groupBy("vertex").agg(F.sum("n").alias("n"))


def read_index(spark: SparkSession, path: str) -> Index:
    """The index that ``write_index`` wrote, with all insertions and deletions since; each search reads the
    folders that it needs."""
    held = spark.read.parquet(f"{path}/about").first()
    about = json.loads(held["about"])
    kind = about["kind"]
    if kind in ("lsh", "cube"):
        index = LSH(about["dim"], LshParams(**about["params"])) if kind == "lsh" else Hypercube(about["dim"], CubeParams(**about["params"]))
        index.engine = about["engine"]
    else:
        params = IvfParams(**about["params"])
        index = IVFFlat(params) if kind == "ivf" else IVFPQ(params, PqParams(**about["pq_params"]))
        index.coarse = CoarseQuantizer(params)
        index.coarse.centres = np.array(about["centres"], dtype=np.float64)
    if kind == "ivfpq":
        index.pq = ProductQuantizer(index.pq_params)
        if "codebooks" in about:
            index.pq.splits = [tuple(x) for x in about["splits"]]
            index.pq.codebooks = [np.array(b, dtype=np.float64).reshape(index.pq_params.codes, n) for b, (_, n) in zip(about["codebooks"], index.pq.splits)]
    index.stored = Stored(spark, path, Layout(about), json.loads(held["schemas"]))
    index.rows = index.stored.table("rows")
    index.vectors = index.stored.table("vectors" if "vectors" in index.stored.schemas else "rows").select("id", "vec")
    return index


def insert(spark: SparkSession, path: str, vectors: DataFrame) -> None:
    """Add (id, vec) to a stored index: hashed, or assigned and encoded, by its stored parameters. An id that
    the index holds must be deleted first, or it is there twice."""
    index = read_index(spark, path)
    if isinstance(index, (LSH, Hypercube)) and not index.dim or isinstance(index, (IVFFlat, IVFPQ)) and not len(index.coarse.centres):
        raise ValueError("an index of an empty table has no parameters to insert by")
    batch = index.stored.last + 1
    _append(index.stored.layout.content(index, vectors), index.stored.layout, path, batch)
    _log(spark, path, batch, "insert")


def delete(spark: SparkSession, path: str, ids: DataFrame) -> None:
    """Delete rows by (id) from a stored index; ids that it does not hold are no mistake."""
    batch = read_index(spark, path).stored.last
    ids.select(F.col("id").cast("long").alias("id"), F.lit(batch).cast("long").alias("through")).distinct().write.mode("append").parquet(f"{path}/gone")
    _log(spark, path, batch, "delete")


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write the live rows of a stored index as a new one, with the same parameters and one batch."""
    index = read_index(spark, path)
    write_index(index, to, index.stored.layout.folders)

"""Vector sources: fvecs and IDX3 files, Parquet, and their registry. All give (id, vec)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vec import valid
from .formats import IDX3_MAGIC, SPLIT_BYTES, VECTORS, FvecsReader, Idx3Reader, idx3_header, opened, reachable, reading

def read_fvecs(spark: SparkSession, path: str, limit: int | None = None, dim: int = 128, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Records of a little-endian dimension and as many floats, from a file, a folder or a pattern (``formats``).

    A wrong dimension or a cut payload fails; a cut dimension word at the end is a clean end.
    """
    if not reachable(path):
        return _decoded_whole(spark, path, limit, lambda content: _fvecs_rows(content, dim))
    options = {"dim": dim, "limit": -1 if limit is None else limit, "split_bytes": split_bytes}
    FvecsReader({"path": path, **options}).layouts()  # mistakes show here
    return reading(spark, "fvecs", **options).load(path)


def _fvecs_rows(content: bytes, dim: int) -> np.ndarray:
    if len(content) % (4 + 4 * dim) >= 4:
        raise ValueError("the last record is cut short")
    data = np.frombuffer(content, dtype="<i4", count=len(content) // (4 + 4 * dim) * (dim + 1)).reshape(-1, dim + 1)
    if (data[:, 0] != dim).any():
        raise ValueError(f"a record has dimension {int(data[data[:, 0] != dim][0, 0])}, not {dim}")
    return np.ascontiguousarray(data[:, 1:]).view("<f4")


def _decoded_whole(spark: SparkSession, path: str, limit: int | None, rows: Callable[[bytes], np.ndarray]) -> DataFrame:
    """One file in a store that only Spark opens, decoded in one task, in slices of rows."""

    def decode(frames):
        for frame in frames:
            for content in frame["content"]:
                x = rows(bytes(content))
                x = x if limit is None or limit < 0 else x[:limit]
                for at in range(0, len(x), 4096):
                    part = x[at:at + 4096].astype(np.float32)
                    yield pd.DataFrame({"id": np.arange(at, at + len(part)), "vec": list(part)})

    files = spark.read.format("binaryFile").load(path)
    if files.select("path").limit(2).count() > 1:
        raise ValueError(f"{path}: only one file can be read from this store")
    return files.select("content").mapInPandas(decode, VECTORS)


def idx3_images(content: bytes) -> np.ndarray:
    """Images of an IDX3 file as rows of pixels. A wrong magic number or missing pixels fail."""
    n, dim = idx3_header(content[:16], len(content))
    return np.frombuffer(content, dtype=np.uint8, count=n * dim, offset=16).reshape(n, dim)


def read_idx3(spark: SparkSession, path: str, limit: int | None = 1000, normalise: bool = False, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The first ``limit`` images (all: None or negative) of a file, a folder or a pattern (``formats``); pixels
    from 0 to 255, or to 1."""
    if reachable(path):
        options = {"limit": -1 if limit is None else limit, "normalise": normalise, "split_bytes": split_bytes}
        Idx3Reader({"path": path}).layouts()
        return reading(spark, "idx3", **options).load(path)
    rows = _decoded_whole(spark, path, limit, idx3_images)
    return rows.withColumn("vec", F.transform("vec", lambda x: (x / 255).cast("float"))) if normalise else rows


def _encoded(path: str, part: int | None, head: bytes, rows) -> tuple[str, int]:
    """Write bytes through Arrow's file systems, which know local paths and cluster URIs alike."""
    system, folder = opened(path)
    if part is not None:
        folder = f"{folder}/part-{part:05d}"
    system.create_dir(folder.rpartition("/")[0] or "/", recursive=True)
    n = 0
    with system.open_output_stream(folder) as out:
        out.write(head)
        for count, data in rows:
            out.write(data)
            n += count
    return folder, n


def write_fvecs(vectors: DataFrame, path: str) -> int:
    """(id, vec) as a folder of fvecs files, in the order of ids; returns the number of rows. Each task
    writes the file of its range of ids, and a task that is run again writes the same file."""
    from pyspark import TaskContext

    def save(frames):
        def rows():
            for frame in frames:
                x = np.array(frame["vec"].tolist(), dtype="<f4")
                if len(x):
                    head = np.full((len(x), 1), x.shape[1], dtype="<i4")
                    yield len(x), np.concatenate([head, x.view("<i4")], axis=1).tobytes()

        name, n = _encoded(path, TaskContext.get().partitionId(), b"", rows())
        yield pd.DataFrame({"path": [name], "n": [n]})

    ordered = vectors.select(F.col("id").cast("long").alias("id"), "vec").repartitionByRange("id").sortWithinPartitions("id")
    return ordered.mapInPandas(save, "path string, n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_idx3(images: DataFrame, path: str, height: int, width: int) -> int:
    """(id, vec) of pixels from 0 to 255 as one IDX3 file, in the order of ids. The header of the format
    counts the images, and they follow in one sequence, so one task streams them."""
    n = images.count()
    head = np.array([IDX3_MAGIC, n, height, width], dtype=">u4").tobytes()

    def save(frames):
        def rows():
            for frame in frames:
                x = np.array(frame["vec"].tolist(), dtype=np.uint8)
                if len(x) and x.shape[1] != height * width:
                    raise ValueError(f"an image has {height} x {width} pixels, not {x.shape[1]}")
                yield len(x), x.tobytes()

        yield pd.DataFrame({"n": [_encoded(path, None, head, rows())[1]]})

    return images.select("id", "vec").orderBy("id").coalesce(1).mapInPandas(save, "n long").agg(F.sum("n")).first()[0]


def read_parquet(spark: SparkSession, path: str, limit: int | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec) from a Parquet table; ``limit`` keeps ids below it."""
    rows = spark.read.parquet(path).select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    return rows if limit is None or limit < 0 else rows.where(F.col("id") < limit)


READERS = {"mnist": read_idx3, "idx3": read_idx3, "sift": read_fvecs, "fvecs": read_fvecs, "parquet": read_parquet}


def kind_of(path: str) -> str:
    """The kind that a path names, for callers that give none."""
    for kind in ("mnist", "sift", "parquet", "fvecs", "idx3"):
        if kind in path.lower():
            return kind
    raise ValueError(f"no kind of vector file is named in {path}")


def load_vectors(spark: SparkSession, path: str, kind: str | None = None, limit: int | None = None, **options) -> DataFrame:
    """(id, vec) by kind, or by what the path names."""
    kind = kind or kind_of(path)
    if kind not in READERS:
        raise ValueError(f"unknown kind of vector file: {kind}")
    return READERS[kind](spark, path, limit=limit, **options)


def checked(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """``vectors``; running it fails on a null, ragged or non-finite vector."""
    if dim is None:
        row = vectors.select(F.size("vec").alias("dim")).first()
        dim = row["dim"] if row else None
    ok = valid(F.col("vec"), dim)
    return vectors.withColumn("vec", F.when(ok, F.col("vec")).otherwise(F.raise_error(F.concat(F.lit("bad vector, id "), F.coalesce(F.col("id").cast("string"), F.lit("null")))).cast(vectors.schema["vec"].dataType)))

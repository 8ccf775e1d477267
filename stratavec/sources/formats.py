"""Vector files as Spark data sources: ``spark.read.format("fvecs")`` and ``spark.read.format("idx3")``.

A path is a file, a folder or a pattern of names in a folder. Files are read in the order of their names, and
ids count on from one to the next. Both formats have records of fixed width behind a header, so files are
cut into byte ranges of about ``split_bytes`` at record borders, one task each; a task reads its range piece by
piece and hands Arrow batches on. Options: ``dim`` (fvecs), ``normalise`` (idx3: pixels from 0 to 1), ``limit``
(first rows only; negative: all), ``split_bytes``. With ``spark.sql.python.filterPushdown.enabled`` set (and the option
``pushdown``), comparisons of the id with constants choose the byte ranges that are read at all.

A wrong magic number or dimension and a cut record fail when the read is planned; a cut dimension word at the
end of an fvecs file is a clean end.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

VECTORS = "id long, vec array<float>"
SPLIT_BYTES = 64 << 20
#: Bytes that a task holds of its range at once.
PIECE_BYTES = 4 << 20

#: Fixed value: the magic number of an IDX3 file of unsigned bytes.
IDX3_MAGIC = 2051


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def reachable(path: str) -> bool:
    """Whether Arrow knows the path's store; others only Spark's own readers open."""
    try:
        opened(path)
        return True
    except (pa.ArrowException, OSError, ValueError):
        return False


def files_of(path: str) -> list[tuple[str, int]]:
    """(file, bytes) of a file, a folder or a pattern, by name; hidden files are left out."""
    system, at = opened(path)
    folder, _, name = at.rstrip("/").rpartition("/")
    if any(c in name for c in "*?["):
        found = [f for f in system.get_file_info(fs.FileSelector(folder or "/")) if fnmatch.fnmatchcase(f.base_name, name)]
    else:
        info = system.get_file_info(at)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at))
    kept = sorted((f for f in found if f.type == fs.FileType.File and (len(found) == 1 or f.base_name[0] not in "._")), key=lambda f: f.base_name)
    return [(f.path, f.size) for f in kept]


@dataclass(frozen=True)
class Layout:
    """Where a file's records lie."""

    file: str
    rows: int
    dim: int
    width: int
    begin: int


@dataclass
class Slice(InputPartition):
    """``rows`` records of ``width`` bytes of a file from byte ``begin`` on; the first has the id ``first``."""

    file: str
    begin: int
    rows: int
    first: int
    width: int = 1


class VectorReader(DataSourceReader):
    """Plans and reads slices; subclasses know one format."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        limit = int(options.get("limit", -1))
        self.low, self.high = 0, None if limit < 0 else limit

    def layout(self, system: fs.FileSystem, file: str, size: int) -> Layout:
        raise NotImplementedError

    def decoded(self, raw: bytes, rows: int) -> np.ndarray:
        """``rows`` records as a matrix of 32-bit floats."""
        raise NotImplementedError

    def layouts(self) -> list[Layout]:
        system, _ = opened(self.path)
        found = [self.layout(system, file, size) for file, size in files_of(self.path)]
        dims = {f.dim for f in found if f.rows}
        if len(dims) > 1:
            raise ValueError(f"{self.path}: files of dimensions {sorted(dims)}")
        return found

    def partitions(self) -> list[Slice]:
        out, first = [], 0
        for f in self.layouts():
            step = max(1, self.split_bytes // f.width)
            low, high = max(0, self.low - first), f.rows if self.high is None else min(f.rows, self.high - first)
            out += [Slice(f.file, f.begin + at * f.width, min(step, high - at), first + at, f.width) for at in range(low, high, step)]
            first += f.rows
        return out or [Slice("", 0, 0, 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        if not part.rows:
            return
        system, _ = opened(self.path)
        with system.open_input_file(part.file) as source:
            source.seek(part.begin)
            step = max(1, PIECE_BYTES // part.width)
            for at in range(0, part.rows, step):
                n = min(step, part.rows - at)
                x = self.decoded(source.read(n * part.width), n)
                flat = pa.array(np.ascontiguousarray(x, dtype=np.float32).ravel())
                vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int64) + part.first + at), vec], names=["id", "vec"])


class FvecsReader(VectorReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.dim = int(options.get("dim", 128))

    def layout(self, system, file, size):
        width = 4 + 4 * self.dim
        if size >= 4:
            with system.open_input_file(file) as source:
                dim = int(np.frombuffer(source.read(4), "<i4")[0])
            if dim != self.dim:
                raise ValueError(f"{file}: a record has dimension {dim}, not {self.dim}")
        if size % width >= 4:
            raise ValueError(f"{file}: the last record is cut short")
        return Layout(file, size // width, self.dim, width, 0)

    def decoded(self, raw, rows):
        data = np.frombuffer(raw, dtype="<i4").reshape(rows, self.dim + 1)
        wrong = np.flatnonzero(data[:, 0] != self.dim)
        if len(wrong):
            raise ValueError(f"a record has dimension {int(data[wrong[0], 0])}, not {self.dim}")
        return np.ascontiguousarray(data[:, 1:]).view("<f4")


class Idx3Reader(VectorReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.scale = options.get("normalise", "false").lower() == "true"

    def layout(self, system, file, size):
        with system.open_input_file(file) as source:
            head = source.read(16)
        rows, dim = idx3_header(head, size)
        return Layout(file, rows, dim, max(1, dim), 16)

    def decoded(self, raw, rows):
        pixels = np.frombuffer(raw, dtype=np.uint8).reshape(rows, -1)
        return pixels / 255 if self.scale else pixels


def idx3_header(head: bytes, size: int) -> tuple[int, int]:
    """(images, pixels of each) of an IDX3 file of ``size`` bytes that begins with ``head``."""
    if len(head) < 16:
        raise ValueError("an IDX3 file has a header of 16 bytes")
    magic, n, height, width = np.frombuffer(head, dtype=">u4", count=4).tolist()
    if magic != IDX3_MAGIC:
        raise ValueError(f"the magic number is {magic}, not {IDX3_MAGIC}")
    if size < 16 + n * height * width:
        raise ValueError("the file ends before its last image")
    return n, height * width


def _narrowing(kind: type[VectorReader]) -> type[VectorReader]:
    """The reader with filter pushdown, which Spark accepts only where it is switched on."""

    class Narrowing(kind):
        def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
            for f in filters:
                if getattr(f, "attribute", None) != ("id",) or not isinstance(getattr(f, "value", None), int):
                    yield f
                    continue
                low, high = None, None
                if isinstance(f, (LessThan, LessThanOrEqual)):
                    high = f.value + isinstance(f, LessThanOrEqual)
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    low = f.value + isinstance(f, GreaterThan)
                elif isinstance(f, EqualTo):
                    low, high = f.value, f.value + 1
                else:
                    yield f
                    continue
                self.low = self.low if low is None else max(self.low, low)
                self.high = self.high if high is None else max(0, high if self.high is None else min(self.high, high))

    return Narrowing


class VectorSource(DataSource):
    kind: type[VectorReader]

    def schema(self) -> str:
        return VECTORS

    def reader(self, schema) -> VectorReader:
        kind = _narrowing(self.kind) if self.options.get("pushdown", "false").lower() == "true" else self.kind
        return kind(dict(self.options))


class FvecsSource(VectorSource):
    kind = FvecsReader

    @classmethod
    def name(cls) -> str:
        return "fvecs"


class Idx3Source(VectorSource):
    kind = Idx3Reader

    @classmethod
    def name(cls) -> str:
        return "idx3"


def register(spark: SparkSession) -> None:
    """Make both formats known to a session."""
    for source in (FvecsSource, Idx3Source):
        spark.dataSource.register(source)


def reading(spark: SparkSession, name: str, **options):
    """A reader of one of the formats; filters are pushed down where the session allows it."""
    register(spark)
    pushes = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false").lower() == "true"
    return spark.read.format(name).options(pushdown=str(pushes).lower(), **{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()})

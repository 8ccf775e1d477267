"""Arrow-batch plumbing for the operators that run Python on the executors."""

from __future__ import annotations

import ctypes
import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows that are turned into Python objects at once.
SLICE = 512
#: Bytes of a batch that goes to a Python worker, where the session allows more.
BATCH_BYTES = 4 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


@functools.lru_cache(maxsize=1)
def _malloc_trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):  # another C library
        return lambda _: None


def trim() -> None:
    """Give memory that a finished batch took back to the system: workers live on between tasks and
    would otherwise each keep the most that any stage ever took."""
    pa.default_memory_pool().release_unused()
    _malloc_trim()(0)


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """mapInArrow with batches of at most ``BATCH_BYTES`` (one row, where a row has more).

    10,000 long texts make a batch of tens of MB, of which the JVM and the worker hold several at
    once outside the heap. The session's limit is lowered for that, never raised, and stays so: it
    is read when the plan runs. Nothing but the size of batches depends on it.
    """
    conf = df.sparkSession.conf
    limit = parsed_bytes(conf.get(_BATCH_LIMIT, None))
    if limit is None or limit > BATCH_BYTES:
        conf.set(_BATCH_LIMIT, str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


def parsed_bytes(size: str | None) -> int | None:
    """The bytes of one of Spark's sizes (4194304, 64m, 67108864b); None where there is no limit."""
    found = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", (size or "").strip().lower())
    if not found or not int(found[1]):
        return None
    return int(found[1]) << 10 * " kmgtp".index(found[2] or " ")


def map_rows(df: DataFrame, schema: str | T.StructType, work: Callable[..., Iterator[tuple]]) -> DataFrame:
    """mapInArrow with ``work(*columns)``, called on short slices of columns as Python lists; it
    yields output rows as tuples. Memory is bounded by a batch and one slice."""
    out = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows = list(work(*[c.to_pylist() for c in part.columns]))
                if rows:
                    columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)
            trim()

    return map_batches(df, run, out)

"""Packing of token streams into windows of several lengths.

Each document's ids (and one separator) are cut into pieces. Whole windows of the longest length
leave at once; the rest of a document is routed to the tier of the smallest window that holds it.
Tiers are packed from the longest: every window starts with the longest piece of its tier and its
gap is filled with the best-fitting pieces of the same or shorter tiers; when none fits, a shorter
piece is cut to fill the gap exactly. So windows are full until the pieces run out; what is left at
the end of a partition goes into windows of the tiers' lengths, each full, and less than the
shortest tier into one padded window. A partition is packed in one pass with a bounded pool.

Sequences of each tier are dealt to as few step groups of at most ``step_tokens`` as hold them, whose
sizes differ by one sequence at most, over all tasks: the written pieces are counted by task and
tier, a running sum over those few counts numbers a tier's sequences, and the number gives the group.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, types as T
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.sizes import broadcast_if_small
from .arrow import map_batches, trim
from .common import written
from .tokenizer import load, public_path

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, tier int, place long")
#: A sequence's id has its task above these bits and its number in the task below; a step group's id
#: has the place of its tier and its number in the tier.
TASK_BITS = 34
TIER_BITS = 40


@dataclass(frozen=True)
class PackSettings:
    """tiers: window lengths, powers of two, longest first; pool: pieces that wait for a window."""

    tiers: tuple[int, ...] = (1024, 512, 256, 128, 64)
    pool: int = 4096
    step_tokens: int = 65536
    separator: int = 0

    def per_group(self, tier: int) -> int:
        return max(1, self.step_tokens // tier)


class Packer:
    """Packs pieces of one partition; ``task`` keeps its sequence ids apart from other partitions'."""

    def __init__(self, settings: PackSettings, task: int, rest=lambda doc, start: doc):
        """rest: what to hold of a document while only its tokens from ``start`` on wait."""
        self.s, self.task, self.rest = settings, task, rest
        self.window = settings.tiers[0]
        self.waiting: dict[int, list] = {}
        self.lengths = 0  # bit n is set if a piece of n tokens waits
        self.n = 0
        self.sequences = 0
        self.of_tier = dict.fromkeys(settings.tiers, 0)

    def _wait(self, piece: tuple) -> None:
        size = piece[2]
        self.waiting.setdefault(size, []).append(piece)
        self.lengths |= 1 << size
        self.n += 1

    def _take(self, most: int) -> tuple | None:
        """A waiting piece of the largest length that is at most ``most``."""
        fit = self.lengths & ((1 << (most + 1)) - 1)
        if not fit:
            return None
        size = fit.bit_length() - 1
        stack = self.waiting[size]
        piece = stack.pop()
        if not stack:
            self.lengths &= ~(1 << size)
        self.n -= 1
        return piece

    def _cut(self, gap: int) -> tuple | None:
        """The first ``gap`` tokens of the shortest waiting piece; its rest waits on."""
        if not self.lengths:
            return None
        size = (self.lengths & -self.lengths).bit_length() - 1
        doc, start, _ = self._take(size)
        self._wait((doc, start + gap, size - gap))
        return doc, start, gap

    def _emit(self, pieces: list[tuple], tier: int) -> Iterator[tuple]:
        sequence = self.task << TASK_BITS | self.sequences
        self.sequences += 1
        place, offset = self.of_tier[tier], 0
        self.of_tier[tier] += 1
        for doc, start, size in pieces:
            yield doc, start, size, sequence, offset, tier, place
            offset += size

    def add(self, doc, size: int) -> Iterator[tuple]:
        """Take a document of ``size`` tokens; yields the pieces of windows that are full: document,
        start, length, sequence, offset, tier, the sequence's place in its tier."""
        start = 0
        while size - start >= self.window:
            yield from self._emit([(doc, start, self.window)], self.window)
            start += self.window
        if start < size:
            self._wait((self.rest(doc, start), start, size - start))
        if self.n > self.s.pool:
            yield from self.pack(self.s.pool // 2)

    def pack(self, leave: int | None) -> Iterator[tuple]:
        """Pack waiting pieces, longest tier first, until at most ``leave`` wait; None: to the end."""
        while self.n > (leave or 0):
            first = self._take(self.window)
            tier = min(t for t in self.s.tiers if t >= first[2])
            pieces, gap = [first], tier - first[2]
            while gap:
                more = self._take(gap) or self._cut(gap)
                if more is None:
                    break
                pieces.append(more)
                gap -= more[2]
            if not gap:
                yield from self._emit(pieces, tier)
            elif leave is None:
                yield from self._last(pieces)
            else:  # less than a window waits: more may come
                for piece in pieces:
                    self._wait(piece)
                return

    def _last(self, pieces: list[tuple]) -> Iterator[tuple]:
        """The last pieces of a partition: full windows of the tiers' lengths, then a padded one."""
        left = sum(p[2] for p in pieces)
        while left:
            tier = max((t for t in self.s.tiers if t <= left), default=0)
            own, room = [], tier or left
            while room:
                doc, start, size = pieces.pop(0)
                used = min(size, room)
                own.append((doc, start, used))
                room -= used
                if used < size:
                    pieces.insert(0, (doc, start + used, size - used))
            left -= tier or left
            yield from self._emit(own, tier or self.s.tiers[-1])

    def finish(self) -> Iterator[tuple]:
        yield from self.pack(None)


def _in_step_groups(pieces: DataFrame, settings: PackSettings) -> DataFrame:
    """``pieces`` (a written table) with step_group instead of place."""
    rows = pieces.withColumn("task", F.shiftright("sequence_id", TASK_BITS))
    counts = rows.groupBy("task", "tier").agg((F.max("place") + 1).alias("n"))  # a row a task and tier
    of_tier = Window.partitionBy("tier")
    before = F.sum("n").over(of_tier.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("task", "tier", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(of_tier).alias("total"))
    at, most = F.lit(0), F.lit(1)
    for i, tier in enumerate(settings.tiers):
        at = F.when(F.col("tier") == tier, F.lit(i)).otherwise(at)
        most = F.when(F.col("tier") == tier, F.lit(settings.per_group(tier))).otherwise(most)
    # The first ``longer`` groups have size + 1 sequences, the others ``size``.
    counts = counts.withColumn("at", at.cast("long")).withColumn("groups", F.ceil(F.col("total") / most))
    counts = counts.withColumn("size", F.expr("total div groups")).withColumn("longer", F.expr("total % groups"))
    counts = written(counts, "packed-counts")
    numbered = rows.join(broadcast_if_small(counts), ["task", "tier"]).withColumn("index", F.col("before") + F.col("place"))
    number = F.expr("if(index < longer * (size + 1), index div (size + 1), longer + (index - longer * (size + 1)) div size)")
    names = [c for c in pieces.columns if c not in ("place", "ids")]
    group = F.shiftleft(F.col("at"), TIER_BITS).bitwiseOR(number).alias("step_group")
    return numbered.select(*names, group, *[c for c in pieces.columns if c == "ids"])


def pack_documents(docs: DataFrame, tokenizer_path: str, settings: PackSettings = PackSettings(), id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier,
    step_group, and the ids themselves (``ids``) where ``with_ids`` is set.

    Every row of the input is one document (null texts: only the separator); ids, repeated or null,
    are carried along as they are. Every id of a document lies in exactly one piece. tier is the
    length of the sequence's window: sequences fill theirs, but for at most one a partition.
    step_group: sequences of one tier, at most ``step_tokens`` together; groups of a tier differ by one
    sequence at most. The pieces are written to the shared folder once.
    Documents of any length stream through; what waits is at most ``pool`` pieces and their ids.
    """
    schema = T.StructType.fromDDL(SCHEMA + (", ids array<int>" if with_ids else ""))
    arrow = to_arrow_schema(schema)
    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches):
        tokenizer = load(tokenizer_path)
        # A document is (id, number of tokens, its ids from some place on, that place).
        packer = Packer(settings, TaskContext.get().partitionId(), lambda d, start: (d[0], d[1], d[2][start - d[3]:].copy(), start))
        end = np.array([settings.separator], dtype="<u4")

        def row(piece):
            (doc_id, tokens, ids, base), start, size, *rest = piece
            part = ids[start - base:start - base + size]
            found = (doc_id, start, size, zlib.crc32(part.tobytes()), tokens, *rest)
            return (*found, part.astype("int32")) if with_ids else found

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        out = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = np.concatenate((tokenizer.ids(text.as_py()), end))
                out += map(row, packer.add((doc_id.as_py(), len(ids), ids, 0), len(ids)))
                if len(out) >= 8192:
                    yield table(out)
                    out = []
            trim()
        out += map(row, packer.finish())
        if out:
            yield table(out)

    return _in_step_groups(written(map_batches(body, run, schema), "packed"), settings)


def pack_with_public(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", settings: PackSettings = PackSettings()) -> DataFrame:
    return pack_documents(docs, public_path(tokenizer), settings)

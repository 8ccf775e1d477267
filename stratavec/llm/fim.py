"""Fill-in-middle by a parallel automaton scan.

A text is cut after two of its lines into prefix, middle and suffix, which are put out in another order
with marks between them. Where the cuts fall, and whether the text holds a mark itself (it is then left
plain), an automaton tells, whose runs over chunks compose (``automaton.py``).

Most texts are one chunk and are done where they lie. A giant text is cut into chunks, which are dealt
out over all tasks. Each chunk sends on its state-transition function and its counts by entry state,
a few numbers. Composing them by document resolves every chunk's entry state, the number of lines and the
chunks in which the cuts lie. Only those chunks, two a document at most, are read again, each to find
one place by the descent of its own tree. At last a document's chunks meet to be put out in the new order:
its digest has no other way, and a text is a single value in the input, too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .arrow import map_rows, trim
from .automaton import FunctionTree, LineAutomaton, line_automaton
from .common import written
from .joins import sieve, sieved

RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"
#: Chunks that a task sends on at once.
PART = 64


@dataclass(frozen=True)
class FimSettings:
    """salt starts the text whose digest draws the cuts; rate and spm are percentages of texts that are
    transformed and of those in suffix-first form; marks stand for prefix, suffix and middle. Texts of
    more than ``giant_chars`` code points are scanned in chunks of ``chunk_chars``."""

    salt: str = "7:"
    rate: int = 100
    spm: int = 50
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")
    chunk_chars: int = 16_384
    giant_chars: int = 65_536

    def __post_init__(self):
        if not all(self.marks) or len(set(self.marks)) < 3:
            raise ValueError("three different marks are needed")
        if any(a != b and a in b for a in self.marks for b in self.marks) or any(a.startswith(b[i:]) for a in self.marks for b in self.marks for i in range(1, len(b))):
            raise ValueError("marks must not overlap, or a text could not be restored")


@dataclass(frozen=True)
class Draws:
    """What a document's id decides."""

    cuts: tuple[int, int]
    transformed: bool
    suffix_first: bool

    @staticmethod
    def of(doc_id: int | None, s: FimSettings) -> "Draws":
        digest = hashlib.sha256(f"{s.salt}{'' if doc_id is None else doc_id}".encode()).digest()
        h1, h2, h3, h4 = (int.from_bytes(digest[4 * i:4 * i + 4], "big") for i in range(4))
        return Draws((h1, h2), h3 % 100 < s.rate, h4 % 100 < s.spm)

    def ends(self, n: int) -> tuple[int, int]:
        """The numbers of lines before the end of the prefix and of the middle."""
        a, b = self.cuts[0] % (n + 1), self.cuts[1] % (n + 1)
        return min(a, b), max(a, b)


def form_of(doc_id: int | None, chars: int, marked: bool, s: FimSettings) -> str:
    draws = Draws.of(doc_id, s)
    if not chars or marked or not draws.transformed:
        return "plain"
    return "spm" if draws.suffix_first else "psm"


def arranged(prefix: str, middle: str, suffix: str, form: str, marks: tuple[str, str, str]) -> str:
    p, s, m = marks
    if form == "psm":
        return f"{p}{prefix}{s}{suffix}{m}{middle}"
    return f"{s}{suffix}{p}{prefix}{m}{middle}"


def restored(output: str, form: str, marks: tuple[str, str, str] = FimSettings().marks) -> str:
    """The text that an output was made of: the marks' places tell its parts apart."""
    if form == "plain":
        return output
    p, s, m = marks
    first, second = (p, s) if form == "psm" else (s, p)
    head, _, middle = output[len(first):].partition(m)
    a, _, b = head.partition(second)
    prefix, suffix = (a, b) if form == "psm" else (b, a)
    return prefix + middle + suffix


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def place_of(automaton: LineAutomaton, text: str, state: int, rank: int) -> int:
    """The place in ``text`` at which its ``rank``-th unit begins, entered in ``state``."""
    tree, places = automaton.tree(text)
    return int(places[tree.find(state, rank)[0]])


def finished(doc_id: int | None, text: str, n: int, form: str, cuts: tuple[int, int] | None, s: FimSettings, with_output: bool) -> tuple:
    """The result row of a text whose cuts are known."""
    if form == "plain":
        output, sizes = text, (None, None)
    else:
        a, b = cuts
        output, sizes = arranged(text[:a], text[a:b], text[b:], form, s.marks), (a, b - a)
    return (doc_id, n, form, *sizes, _sha(output), _sha(restored(output, form, s.marks)), *((output,) if with_output else ()))


def cut_alone(doc_id: int | None, text: str, s: FimSettings, with_output: bool = False) -> tuple:
    """A text of one chunk: its tree gives the number of lines, the marks and both cuts."""
    automaton = line_automaton(s.marks)
    tree, places = automaton.tree(text)
    ends, counts = tree.whole()
    n = int(counts[automaton.start])
    form = form_of(doc_id, len(text), automaton.found(int(ends[automaton.start])), s)
    cuts = None
    if form != "plain":
        cuts = tuple(len(text) if units == n else int(places[tree.find(automaton.start, units + 1)[0]]) for units in Draws.of(doc_id, s).ends(n))
    return finished(doc_id, text, n, form, cuts, s, with_output)


# ---------------------------------------------------------------- giant texts

def _chunks(giants: DataFrame, s: FimSettings) -> DataFrame:
    """(row, doc_id, at, chunk), dealt out over tasks and written once. Rows are numbered by the scan
    that writes them, so a task that is run again before the writing ends repeats its numbers."""
    schema = T.StructType.fromDDL("row long, doc_id long, at int, chunk string")
    out = to_arrow_schema(schema)

    def cut(batches):
        for batch in batches:
            for row, doc_id, text in zip(*[batch.column(c) for c in ("row", "doc_id", "text")]):
                row, doc_id, text = row.as_py(), doc_id.as_py(), text.as_py()
                for first in range(0, len(text), PART * s.chunk_chars):
                    chunks = [text[i:i + s.chunk_chars] for i in range(first, min(len(text), first + PART * s.chunk_chars), s.chunk_chars)]
                    at = range(first // s.chunk_chars, first // s.chunk_chars + len(chunks))
                    columns = ([row] * len(chunks), [doc_id] * len(chunks), at, chunks)
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out)
            trim()

    rows = giants.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return written(rows.mapInArrow(cut, schema).repartition("row", "at"), "fim-chunks")


def _resolved(chunks: DataFrame, s: FimSettings) -> DataFrame:
    """(row, doc_id, n, form, wanted): for each document the cuts that lie inside it, as structs of the
    cut's number, the chunk, the entry state, the rank there and the characters before the chunk."""
    automaton = line_automaton(s.marks)
    states = automaton.states

    def summarise(rows, ids, at, texts):
        for row, doc_id, i, text in zip(rows, ids, at, texts):
            ends, counts = automaton.summary(text)
            yield row, doc_id, i, len(text), ends.tolist(), counts.tolist()

    parts = map_rows(chunks, "row long, doc_id long, at int, chars long, ends array<int>, counts array<long>", summarise)
    # A text has at most 2^31 bytes, so a document has a bounded number of chunks.
    of_row = parts.groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "chars", "ends", "counts"))).alias("parts"))

    def compose(rows, ids, lists):
        for row, doc_id, found in zip(rows, ids, lists):
            ends = np.array([p["ends"] for p in found]).reshape(len(found), states)
            tree = FunctionTree(ends, np.array([p["counts"] for p in found]).reshape(len(found), states))
            before = np.concatenate(([0], np.cumsum([p["chars"] for p in found])))
            end, counts = tree.whole()
            n = int(counts[automaton.start])
            form = form_of(doc_id, int(before[-1]), automaton.found(int(end[automaton.start])), s)
            wanted = []
            for which, units in enumerate(Draws.of(doc_id, s).ends(n) if form != "plain" else ()):
                if units == n:  # the end of the text, which no chunk needs to look for
                    wanted.append((which, None, None, None, int(before[-1])))
                else:
                    at, state, rank = tree.find(automaton.start, units + 1)
                    wanted.append((which, at, state, rank, int(before[at])))
            yield row, doc_id, n, form, [dict(zip(("which", "at", "state", "rank", "before"), w)) for w in wanted]

    schema = "row long, doc_id long, n long, form string, wanted array<struct<which:int,at:int,state:int,rank:long,before:long>>"
    return map_rows(of_row, schema, compose)


def _giants(giants: DataFrame, s: FimSettings, with_output: bool) -> DataFrame:
    chunks = _chunks(giants, s)
    known = written(_resolved(chunks, s), "fim-documents")
    wanted = known.select("row", F.explode("wanted").alias("w")).select("row", "w.*")
    inside = wanted.where(F.col("at").isNotNull())

    # Chunks without a cut stay where they are; the others, two a document at most, meet their cuts.
    held = sieved(chunks.select("row", "at", "chunk"), sieve(inside, "row", "at"), F.col("row"), F.col("at")).where("__passes").drop("__passes")

    def find(rows, which, states, ranks, before, texts):
        automaton = line_automaton(s.marks)
        for row, w, state, rank, base, text in zip(rows, which, states, ranks, before, texts):
            yield row, w, base + place_of(automaton, text, state, rank)

    met = inside.join(held, ["row", "at"]).select("row", "which", "state", "rank", "before", "chunk")
    places = map_rows(met, "row long, which int, place long", find).unionByName(wanted.where(F.col("at").isNull()).select("row", "which", F.col("before").alias("place")))
    cuts = places.groupBy("row").agg(F.max(F.when(F.col("which") == 0, F.col("place"))).alias("a"), F.max(F.when(F.col("which") == 1, F.col("place"))).alias("b"))
    heads = known.join(cuts, "row", "left").select("row", F.lit(-1).alias("at"), "doc_id", "n", "form", "a", "b", F.lit(None).cast("string").alias("chunk"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("n", "long"), ("form", "string"), ("a", "long"), ("b", "long"))]
    stream = heads.unionByName(chunks.select("row", "at", "doc_id", *none, "chunk"))
    stream = stream.repartition("row").sortWithinPartitions("row", "at")

    schema = T.StructType.fromDDL(RESULT + (", output string" if with_output else ""))
    out = to_arrow_schema(schema)

    def put_out(batches) -> Iterator[pa.RecordBatch]:
        head, held = None, []

        def row():
            doc_id, n, form, a, b = head
            found = finished(doc_id, "".join(held), n, form, None if form == "plain" else (a, b), s, with_output)
            return pa.RecordBatch.from_arrays([pa.array([x], type=f.type) for x, f in zip(found, out)], schema=out)

        for batch in batches:
            for at, doc_id, n, form, a, b, chunk in zip(*[batch.column(c) for c in ("at", "doc_id", "n", "form", "a", "b", "chunk")]):
                if at.as_py() < 0:
                    if head is not None:
                        yield row()
                    head, held = (doc_id.as_py(), n.as_py(), form.as_py(), a.as_py(), b.as_py()), []
                else:
                    held.append(chunk.as_py())
        if head is not None:
            yield row()
        trim()

    return stream.mapInArrow(put_out, schema)


def fill_in_middle(docs: DataFrame, settings: FimSettings = FimSettings(), id_col: str = "doc_id", text_col: str = "text", with_output: bool = False) -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256,
    and the transformed text (``output``) where ``with_output`` is set.

    n counts lines (a newline ends one; so does the end of the text). form is psm, spm or plain; a text is
    plain if it is empty, holds a mark, or is not drawn by ``rate``, and then has no prefix_chars and
    middle_chars. Null texts count as empty. The cuts depend on the id and the text alone: rows that repeat
    both give the same result, and a null id draws as an empty one. Other columns are not read; empty input
    gives an empty result.
    """
    s = settings
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def alone(ids, texts):
        for doc_id, text in zip(ids, texts):
            yield cut_alone(doc_id, text, s, with_output)

    small = map_rows(rows.where(F.length("text") <= s.giant_chars), RESULT + (", output string" if with_output else ""), alone)
    return small.unionByName(_giants(rows.where(F.length("text") > s.giant_chars), s, with_output))


FIM_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), d AS (
  SELECT *, len(lines) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d
), p AS (
  SELECT *, coalesce(array_to_string(lines[1:a], ''), '') AS prefix, coalesce(array_to_string(lines[a + 1:b], ''), '') AS middle, coalesce(array_to_string(lines[b + 1:n], ''), '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""

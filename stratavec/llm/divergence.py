"""Source divergence audit: how far a source's use of a language's terms is from that of the other sources
and of the language, by integer-dictionary encoding.

Terms are counted in three steps. A task encodes the terms of a stretch of documents as integers
(a dictionary of the stretch) and counts them by sorting integers, so what leaves it is one row a (language,
source, term). These are added up by (language, term), where the number of documents decides which terms are
kept. Kept terms are range-partitioned in UTF-8 order and cut into chunks of a bounded number of terms: a
chunk has the sorted array of its terms, a count's term becomes its place in that array by
searchsorted, and a source's counts a dense vector. Places follow UTF-8 order, so sums over vectors
and ties between terms need no strings. Chunks meet their language's table (its sources with their totals)
and hand on sums of pairs and their best terms; windows over those give the ranks.

All arithmetic is on integers. Beyond int64 (totals over nine thousand million) shares are
divided digit by digit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, types as T
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.sizes import is_small
from .arrow import trim
from .common import written

#: Fixed rule: terms are runs of ASCII letters and of bytes beyond ASCII; A-Z become lower case, all other bytes part terms (0).
LOWER = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], dtype=np.uint8)
DIGITS = 9
#: Sources that are dense vectors at once.
SOURCE_BLOCK = 256
#: Copies of a language's table, so that its chunks spread over tasks.
SALTS = 16


@dataclass(frozen=True)
class AuditSettings:
    """min_docs: a term is kept in a language from so many of its documents; smoothing is added to each
    count; top: ranks of terms that are reported."""

    min_docs: int = 30
    smoothing: int = 5
    top: int = 50
    chunk_terms: int = 4096
    stretch_bytes: int = 32_000_000


# ---------------------------------------------------------------- counting

def encoded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(dictionary of terms, id of each term, text of each term) of an array of strings without nulls."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32 if texts.type == pa.string() else np.int64)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    raw = np.frombuffer(held, dtype=np.uint8)[offsets[0]:offsets[-1]] if held is not None else np.zeros(0, dtype=np.uint8)
    offsets = offsets - offsets[0]
    low = LOWER[raw]
    inside = low != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][np.diff(offsets) > 0]
    begins[firsts] = inside[firsts]  # a term never goes on from one text into the next
    body = low[inside]
    ends = np.append(np.flatnonzero(begins[inside]), len(body))
    terms = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(body)]).dictionary_encode()
    text = np.searchsorted(offsets, np.flatnonzero(begins), side="right") - 1
    return terms.dictionary, np.asarray(terms.indices, dtype=np.int64), text


def stretch_counts(texts: pa.Array, group: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, texts that hold it) of each pair that occurs."""
    words, ids, text = encoded(texts)
    width = max(1, len(words))
    in_text, n = np.unique(text * width + ids, return_counts=True)
    pair = group[in_text // width] * width + in_text % width
    order = np.argsort(pair, kind="stable")
    pair = pair[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    total = np.add.reduceat(n[order], first) if len(first) else n
    return pair[first] // width, words.take(pa.array(pair[first] % width)), total, np.diff(first, append=len(pair))


def term_counts(docs: DataFrame, stretch_bytes: int) -> DataFrame:
    """(lang, source, term, n, docs): partial counts, to be added up."""
    schema = T.StructType.fromDDL("lang string, source string, term string, n long, docs long")
    out = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            sizes = np.cumsum(np.asarray(batch.column(3), dtype=np.int64))
            at = 0
            while at < batch.num_rows:
                done = sizes[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(sizes, done + stretch_bytes, side="right")))
                part = batch.slice(at, end - at)
                at = end
                langs, sources = part.column(0).dictionary_encode(), part.column(1).dictionary_encode()
                width = len(sources.dictionary)
                both = np.asarray(langs.indices, dtype=np.int64) * width + np.asarray(sources.indices)
                group, terms, n, held = stretch_counts(part.column(2), both)
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(group // width)), sources.dictionary.take(pa.array(group % width)),
                                                  terms.cast(pa.binary()).cast(pa.string()), pa.array(n), pa.array(held)], schema=out)
            trim()

    return docs.select("lang", "source", "text", F.octet_length("text").cast("long").alias("bytes")).mapInArrow(run, schema)


def kept_counts(docs: DataFrame, s: AuditSettings) -> DataFrame:
    """(lang, source, term, n) of all kept terms. One shuffle by (language, term) serves both sums."""
    parts = term_counts(docs, s.stretch_bytes).repartition("lang", "term")
    counts = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    held = F.sum("docs").over(Window.partitionBy("lang", "term"))
    return counts.withColumn("held", held).where(F.col("held") >= s.min_docs).select("lang", "source", "term", "n")


# ---------------------------------------------------------------- vectors

def shares(counts: np.ndarray, smoothing: int, total) -> np.ndarray:
    """1 + floor(10^9 (count + smoothing) / total), exactly, for totals below 9 * 10^17."""
    x = counts + smoothing
    if np.max(total, initial=0) < 9 * 10 ** (18 - DIGITS):
        return 1 + x * 10**DIGITS // total
    whole, rest = x // total, x % total
    for _ in range(DIGITS):
        whole, rest = 10 * whole + 10 * rest // total, 10 * rest % total
    return 1 + whole


class Chunk:
    """Counts of a run of kept terms in all sources of a language."""

    def __init__(self, terms: int, term: np.ndarray, source: np.ndarray, n: np.ndarray, totals: np.ndarray, kept: int, s: AuditSettings):
        """term and source place each count ``n``; totals: of each source over all its kept terms."""
        self.terms, self.s = terms, s
        order = np.argsort(source, kind="stable")
        self.term, self.source, self.n = term[order], source[order], n[order]
        self.totals, self.spread = totals, s.smoothing * kept
        whole = np.zeros(terms, dtype=np.int64)
        np.add.at(whole, term, n)
        self.of_lang = shares(whole, s.smoothing, int(totals.sum()) + self.spread)

    def dense(self, first: int) -> tuple[np.ndarray, np.ndarray]:
        """(counts, shares) of the sources from ``first`` on, a block of them."""
        last = min(len(self.totals), first + SOURCE_BLOCK)
        a, b = np.searchsorted(self.source, [first, last])
        counts = np.zeros((last - first, self.terms), dtype=np.int64)
        counts[self.source[a:b] - first, self.term[a:b]] = self.n[a:b]
        return counts, shares(counts, self.s.smoothing, self.totals[first:last, None] + self.spread)

    def gaps(self):
        """(source, sources of a block, sums of differences) of every source and block."""
        blocks = range(0, len(self.totals), SOURCE_BLOCK)
        for i in blocks:
            mine = self.dense(i)[1]
            for j in blocks:
                theirs = mine if i == j else self.dense(j)[1]
                for k, row in enumerate(mine):
                    yield i + k, np.arange(j, j + len(theirs)), np.abs(theirs - row).sum(axis=1)

    def leading(self):
        """(source, terms, excess over the language) of each source's foremost terms here."""
        for i in range(0, len(self.totals), SOURCE_BLOCK):
            for k, (count, share) in enumerate(zip(*self.dense(i))):
                above = np.flatnonzero((count > 0) & (share > self.of_lang))
                excess = (share - self.of_lang)[above]
                best = np.lexsort((above, -excess))[:self.s.top]
                yield i + k, above[best], excess[best]


def chunks_of(counts: DataFrame, s: AuditSettings) -> DataFrame:
    """(lang, terms, term, source, n): runs of at most ``chunk_terms`` kept terms of a language, sorted, with
    all their counts; term is the place of a count's term in ``terms``."""
    schema = T.StructType.fromDDL("lang string, terms array<string>, term array<int>, source array<string>, n array<long>")
    out = to_arrow_schema(schema)

    def run(batches):
        lang, terms, held = None, [], []

        def packed():
            sorted_terms = np.array([t.encode() for t in terms], dtype=object)
            place = np.searchsorted(sorted_terms, np.array([t.encode() for _, t, _ in held], dtype=object))
            columns = ([lang], [terms], [place.tolist()], [[x for x, _, _ in held]], [[n for *_, n in held]])
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out)

        for batch in batches:
            for of, source, term, n in zip(*[batch.column(c).to_pylist() for c in range(4)]):
                if terms and (of != lang or (term != terms[-1] and len(terms) >= s.chunk_terms)):
                    yield packed()
                    terms, held = [], []
                lang = of
                if not terms or term != terms[-1]:
                    terms.append(term)
                held.append((source, term, n))
        if terms:
            yield packed()

    ordered = counts.select("lang", "source", "term", "n").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term")
    return ordered.mapInArrow(run, schema)


def languages(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, sources, totals, kept): each language's sources in order, with the sums of their counts of
    kept terms, and the number of kept terms."""
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = counts.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("kept"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left")
    # A language's row is as long as each result list of its sources.
    listed = groups.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", F.coalesce("total", F.lit(0)).alias("total")))).alias("g"))
    return listed.join(kept, "lang", "left").select("lang", F.col("g.source").alias("sources"), F.col("g.total").alias("totals"), F.coalesce("kept", F.lit(0)).alias("kept"))


def audit_sources(docs: DataFrame, settings: AuditSettings = AuditSettings(), lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: for each (language, source) that occurs,

    part ``pair``: every other source of the language by the sum over kept terms of |p - q|, where p and q are
    the sources' shares of a term; part ``term``: the ``top`` kept terms that occur in the source and whose
    share there is above the language's, by the excess. A share is 1 + floor(10^9 (count + smoothing) /
    (total + smoothing * kept terms)). Ranks follow the value downwards, ties go by UTF-8 order.

    Nulls count as empty texts, languages and sources. Every row is a document, also where rows repeat. A
    source without terms has shares, too; a language without kept terms has pairs of value 0 and no terms.
    Other columns are not read; empty input gives an empty result.
    """
    s = settings
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = written(kept_counts(rows, s), "audit-counts")
    table = written(languages(rows, counts), "audit-languages")

    schema = T.StructType.fromDDL("lang string, source string, part string, item string, value long")
    out = to_arrow_schema(schema)

    def compare(batches):
        for batch in batches:
            for row in batch.to_pylist():
                names = np.array([x.encode() for x in row["sources"]], dtype=object)
                of = np.searchsorted(names, np.array([x.encode() for x in row["source"]], dtype=object))
                chunk = Chunk(len(row["terms"]), np.array(row["term"]), of, np.array(row["n"], dtype=np.int64), np.array(row["totals"], dtype=np.int64), row["kept"], s)
                for part, found, items in (("pair", chunk.gaps(), row["sources"]), ("term", chunk.leading(), row["terms"])):
                    for i, places, values in found:
                        other = [(items[p], v) for p, v in zip(places.tolist(), values.tolist()) if part == "term" or p != i]
                        if other:
                            n = len(other)
                            columns = ([row["lang"]] * n, [row["sources"][i]] * n, [part] * n, *zip(*other))
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, out)], schema=out)
            trim()

    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    chunks = chunks_of(counts, s).withColumn("salt", F.pmod(F.xxhash64(F.element_at("terms", 1)), F.lit(SALTS)).cast("int"))
    met = chunks.join(F.broadcast(salted) if is_small(salted) else salted, ["lang", "salt"])
    found = written(met.select("lang", "terms", "term", "source", "n", "sources", "totals", "kept").mapInArrow(compare, schema), "audit-found")

    one = table.select("lang", F.explode("sources").alias("source"), "sources")
    none = one.select("lang", "source", F.explode("sources").alias("item")).where("item <> source").withColumn("value", F.lit(0).cast("long"))
    pairs = found.where("part = 'pair'").select("lang", "source", "item", "value").unionByName(none).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(by_value).cast("int").alias("rank")
    terms = found.where("part = 'term'").select("lang", "source", F.lit("term").alias("part"), "item", "value", rank).where(F.col("rank") <= s.top)
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank).unionByName(terms)


AUDIT_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d
), dt AS MATERIALIZED (SELECT r, lang, source, term, count(*) AS n FROM t GROUP BY ALL
), k AS MATERIALIZED (SELECT lang, term FROM dt GROUP BY ALL HAVING count(*) >= 30
), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang
), g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d
), c AS (SELECT lang, source, term, sum(n)::HUGEINT AS n FROM dt SEMI JOIN k USING (lang, term) GROUP BY ALL
), e AS MATERIALIZED (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p
  FROM (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n, v FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term))
), l AS (
  SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v)::HUGEINT AS q
  FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM e GROUP BY ALL) JOIN v USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(f, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS f FROM e a JOIN e b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (SELECT lang, source, term AS item, p - q AS value FROM e JOIN l USING (lang, term) WHERE n > 0 AND p > q
), found AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term' AS part, item, value FROM terms
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

"""Near duplicates by an inverted join on MinHash signature coordinates, confirmed on full sets.

1. Every text becomes its set of five-word shingles (64-bit hashes); equal sets are one class.
2. A class has a signature of ``coords`` minima. Two sets of similarity 0.8 agree in 26 of 32
   coordinates on average; a pair is a candidate when at least ``matches`` (12) agree, which loses a
   link with a probability below 3e-8.
3. Postings: a class is listed under its (coordinate, value) pairs. Values that only one class has
   are skipped; a class with fewer than ``matches`` shared values can have no partner; the others
   are listed under their ``coords - matches + 1`` rarest values only, counting the skipped ones,
   since two classes that agree in ``matches`` coordinates must share one of those (prefix filter).
   Values of passages that many texts share are frequent, hence outside nearly all prefixes.
4. In each posting list collisions are counted by merging its members' lists of values; the longest
   ``matches - 1`` are skipped and looked up for members met in the others only. A spanning forest
   of the candidate pairs is emitted, never all of them. Its components are closed under "is a
   candidate", so links never cross them.
5. In each component the links are found on the full shingle sets, again as a spanning forest; the
   components of these links are the result.

Lists and components of more than ``block`` members (or ``block_bytes``) are cut into blocks, and a task takes two
blocks, so no task holds an unbounded group: any pair meets in one task, and a union of spanning
forests connects what the union of the graphs connects. Joins on keys that can be hot (values, lists, hubs of
components) broadcast the few hot ones, and joins with whole texts go through a sieve (joins.py).

Sets are compared as 64-bit hashes of their shingles: two shingles of one text with the same hash
count once, which for a text of a million shingles has a probability of 3e-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .arrow import map_batches, map_rows, trim
from .common import discard, written
from .joins import hot_join, sieve, sieved

_MEMO_LIMIT = 60_000
_memo: dict[bytes, int] = {}
#: Hot values of signatures that may be broadcast: each is 12 bytes.
HOT_VALUES = 8192


@dataclass(frozen=True)
class NearSettings:
    """Links: 100 * intersection >= percent * union of the shingle sets."""

    words: int = 5
    percent: int = 80
    coords: int = 32
    matches: int = 12
    block: int = 2048
    block_bytes: int = 24_000_000


# ---------------------------------------------------------------- shingles and signatures

def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams (A-Z lower-cased; words are runs
    without ASCII white space); fewer words than n make one shingle, no words none."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(_memo) > _MEMO_LIMIT:
        _memo.clear()
    hashes = list(map(_memo.get, parts))
    for i, h in enumerate(hashes):
        if h is None:
            hashes[i] = _memo[parts[i]] = xxhash.xxh64_intdigest(parts[i])
    if not hashes:
        return np.zeros(0, dtype=np.uint64)
    h = np.array(hashes, dtype=np.uint64)
    width = min(words, len(h))
    mix = np.uint64(0x9E3779B97F4A7C15)
    s = np.full(len(h) - width + 1, width, dtype=np.uint64)
    for j in range(width):
        s = (s * mix) ^ (h[j:len(h) - width + 1 + j] + (s >> np.uint64(29)))
    s = (s ^ (s >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(s ^ (s >> np.uint64(32)))


def multipliers(coords: int) -> np.ndarray:
    return np.random.default_rng(20).integers(1, 2**63, coords, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(s: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The minimum of each coordinate's hash (upper 32 bits of a product) over the set."""
    best = np.full(len(factors), 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(s), 2048):
        products = s[at:at + 2048, None] * factors[None, :]
        best = np.minimum(best, products.min(axis=0) >> np.uint64(32))
    return best.astype(np.uint32)


def set_digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


# ---------------------------------------------------------------- spanning forests

def sorted_groups(df: DataFrame, keys: list[str], schema: str, work: Callable[[tuple, list[np.ndarray | list]], Iterator[tuple]]) -> DataFrame:
    """``work(columns)`` on the rows of each key, brought together by one shuffle and a sort in
    each partition; cheaper than a grouped map where most groups are tiny."""
    arranged = df.repartition(*keys).sortWithinPartitions(*keys)
    rest = [c for c in df.columns if c not in keys]
    out = to_arrow_schema(_struct(schema))

    def run(batches):
        held, at, found = [[] for _ in rest], None, []

        def flush():
            if held[0] and len(held[0]) > 1:
                found.extend(work(*held))

        for batch in batches:
            key_rows = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            columns = [batch.column(c).to_pylist() for c in rest]
            start = 0
            for i in range(len(key_rows) + 1):
                if i == len(key_rows) or key_rows[i] != at:
                    for h, c in zip(held, columns):
                        h.extend(c[start:i])
                    if i < len(key_rows):
                        flush()
                        held, at, start = [[] for _ in rest], key_rows[i], i
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found), out)], schema=out)
                found.clear()
            trim()
        flush()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*found), out)], schema=out)

    return map_batches(arranged, run, schema)


def _struct(schema: str):
    from pyspark.sql import types as T

    return T.StructType.fromDDL(schema)


def trees(count: int, near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[list[int]]:
    """The components (of two members or more) of the graph in which ``near(x, others)`` tells x's
    neighbours among the members ``others``; each member meets the unreached ones only."""
    left = np.arange(count)
    while len(left) > 1:
        tree, at, left = [int(left[0])], 0, left[1:]
        while at < len(tree) and len(left):
            hit = near(tree[at], left)
            tree += left[hit].tolist()
            left = left[~hit]
            at += 1
        if len(tree) > 1:
            yield tree


def stars(ids: list[bytes], near: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[bytes, bytes]]:
    """For each component an edge from every member to the smallest one."""
    for tree in trees(len(ids), near):
        members = sorted(ids[i] for i in tree)
        for other in members[1:]:
            yield other, members[0]


class Postings:
    """Inverted lists of the codes that members hold (``flat``: their codes one after another,
    ``sizes`` a member), over the members that are not reached yet."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.own = np.split(flat, np.cumsum(sizes)[:-1])
        self.sizes, self.codes, self.n = sizes, int(flat.max()) + 1, -1

    def over(self, others: np.ndarray) -> None:
        """List ``others`` (sorted), unless at least half of those that are listed are among them."""
        if 0 <= self.n <= len(others) * 2:
            return
        flat = np.concatenate([self.own[i] for i in others])
        place = np.repeat(np.arange(len(others)), self.sizes[others])
        order = np.argsort(flat, kind="stable")
        self.n, self.of, self.place = len(others), others, place[order]
        self.starts = np.searchsorted(flat[order], np.arange(self.codes + 1))

    def lengths(self, codes: np.ndarray) -> np.ndarray:
        return self.starts[codes + 1] - self.starts[codes]

    def merged(self, codes: np.ndarray) -> np.ndarray:
        """How many of the lists of ``codes`` hold each listed member."""
        starts, lengths = self.starts[codes], self.lengths(codes)
        at = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        return np.bincount(self.place[at], minlength=self.n)

    def among(self, counts: np.ndarray, others: np.ndarray) -> np.ndarray:
        """``counts`` of the members ``others``, a sorted part of what is listed."""
        return counts[np.searchsorted(self.of, others)]


def signature_forest(ids: list[bytes], signatures: list[bytes], matches: int) -> Iterator[tuple[bytes, bytes]]:
    """A spanning forest of the pairs that collide in ``matches`` coordinates or more.

    A member's collisions are counted by merging the lists of its values. Its ``matches - 1`` longest
    lists are skipped: a partner is in one of the others. Only for members met there are the skipped
    ones looked up.
    """
    s = np.frombuffer(b"".join(signatures), dtype=np.uint32).reshape(len(ids), -1)
    if len(ids) == 2:  # two members, one merge
        if (s[0] == s[1]).sum() >= matches:
            yield max(ids), min(ids)
        return
    coords = s.shape[1]
    codes = np.empty(s.shape, dtype=np.int64)
    known = 0
    for j in range(coords):
        values, codes[:, j] = np.unique(s[:, j], return_inverse=True)
        codes[:, j] += known
        known += len(values)
    lists = Postings(codes.ravel(), np.full(len(ids), coords))

    def near(x: int, others: np.ndarray) -> np.ndarray:
        lists.over(others)
        by_length = np.argsort(lists.lengths(codes[x]), kind="stable")
        merge, skip = by_length[:coords - matches + 1], by_length[coords - matches + 1:]
        count = lists.merged(codes[x, merge])
        met = np.flatnonzero(count)
        of_met = lists.of[met]
        count[met] += (codes[np.ix_(of_met, skip)] == codes[x, skip]).sum(axis=1)
        return lists.among(count, others) >= matches

    yield from stars(ids, near)


def set_forest(ids: list[bytes], sets: list[bytes], percent: int) -> Iterator[tuple[bytes, bytes]]:
    """A spanning forest of the links between whole sets, through inverted lists of their shingles."""
    members = [np.frombuffer(s, dtype=np.uint64) for s in sets]
    sizes = np.array([len(m) for m in members])
    _, codes = np.unique(np.concatenate(members), return_inverse=True)
    lists = Postings(codes, sizes)

    def near(x: int, others: np.ndarray) -> np.ndarray:
        lists.over(others)
        both = lists.among(lists.merged(lists.own[x]), others)
        return 100 * both >= percent * (sizes[others] + sizes[x] - both)

    yield from stars(ids, near)


def in_block_pairs(members: DataFrame, keys: list[str], member: str, payload: str, block: int, block_bytes: int) -> DataFrame:
    """``members`` (a written table) with columns i and j: rows of a group of at most ``block``
    members and ``block_bytes`` of payload get (0, 0); larger groups are cut into blocks by a hash,
    and each row is listed with every other block. Groups of one member are left out."""
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.octet_length(payload)).alias("__bytes")).where("__n > 1")
    parts = F.greatest(F.ceil(F.col("__n") / block), F.ceil(F.col("__bytes") / block_bytes)).cast("int")
    own = F.pmod(F.xxhash64(member), F.col("__parts")).cast("int")
    cut = hot_join(members, sizes, keys, "__n", members.count()).withColumn("__parts", parts).withColumn("__own", own)
    return (cut.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
            .withColumn("i", F.least("__own", "__other")).withColumn("j", F.greatest("__own", "__other"))
            .drop("__n", "__bytes", "__parts", "__own", "__other"))


# ---------------------------------------------------------------- components

def components(edges: DataFrame, name: str) -> DataFrame:
    """(id, root) for every id of ``edges`` (a, b): root is the smallest id it is connected with.

    Alternating large-star and small-star steps on the edge table, each a map-side combined minimum
    and a join in which hubs are broadcast; neither makes more edges than it gets, and no list of
    neighbours is built. Each step is written to the shared folder. It ends when every id has one
    edge, to an id that has none.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), name)
    while True:
        ends = now.select("a", F.col("b").alias("least"), F.col("b").alias("most"), F.lit(False).alias("root"))
        ends = ends.unionByName(now.select(F.col("b").alias("a"), F.lit(None).cast("binary").alias("least"), F.lit(None).cast("binary").alias("most"), F.lit(True).alias("root")))
        loose = ends.groupBy("a").agg(F.min("least").alias("least"), F.max("most").alias("most"), F.max("root").alias("root")).where("least != most or (least is not null and root)")
        if loose.isEmpty():
            break
        total = 2 * now.count()
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"), F.count(F.lit(1)).alias("n"))
        large = written(hot_join(both, low, ["a"], "n", total).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")), name)
        floor = large.groupBy("a").agg(F.min("b").alias("low"), F.count(F.lit(1)).alias("n"))
        small = hot_join(large, floor, ["a"], "n", total).select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        following = written(small.where("a != b"), name)
        discard(now, large)
        now = following
    every = now.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")))
    return every.groupBy("id").agg(F.min("root").alias("root"))


# ---------------------------------------------------------------- the operator

def _candidate_postings(classes: DataFrame, s: NearSettings) -> DataFrame:
    """(coord, value, id, signature): the prefix postings of classes that can have a partner."""
    split = F.transform(F.sequence(F.lit(0), F.lit(s.coords - 1)), lambda j: F.substring(F.col("signature"), j * 4 + 1, F.lit(4)))
    listed = classes.select("id", F.posexplode(split).alias("coord", "value"))
    shared = listed.groupBy("coord", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    held = hot_join(listed, shared, ["coord", "value"], "n", classes.count() * s.coords, hot_keys=HOT_VALUES)
    own = held.groupBy("id").agg(F.collect_list(F.struct("n", "coord", "value")).alias("held"))
    # held has at most ``coords`` entries; the values that only this class has come before them all.
    kept = F.size("held") - s.matches + 1
    prefix = own.where(kept > 0).select("id", F.explode(F.slice(F.array_sort("held"), F.lit(1), kept)).alias("p"))
    return prefix.select(F.col("p.coord").alias("coord"), F.col("p.value").alias("value"), "id").join(classes.select("id", "signature"), "id")


def _place() -> Column:
    """A row's place in its group: rows with an id come first, by id, then by the text's digest."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("sha").alias("sha"))


def _grouped(docs: DataFrame, s: NearSettings, id_col: str, text_col: str, sha: Column) -> DataFrame:
    """One row per input row: doc_id, sha, n_shingles, first (the least ``_place`` among the rows of
    its group, null for a text without words)."""
    factors = multipliers(s.coords)
    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), sha.cast("binary").alias("sha"))

    def sign(doc_ids, texts, shas):
        for doc_id, text, own in zip(doc_ids, texts, shas):
            found = shingles(text, s.words)
            if len(found):
                yield doc_id, own, len(found), set_digest(found), signature(found, factors).tobytes()
            else:
                yield doc_id, own, 0, None, None

    signed = written(map_rows(body, "doc_id long, sha binary, n_shingles long, id binary, signature binary", sign), "near-signed")
    least = signed.where("id is not null").groupBy("id").agg(F.min(_place()).alias("first"), F.min("signature").alias("signature"))
    classes = written(least.select("id", "first", F.col("first.doc_id").alias("least"), "signature"), "near-classes")

    postings = written(_candidate_postings(classes, s), "near-postings")
    lists = in_block_pairs(postings, ["coord", "value"], "id", "signature", s.block, s.block_bytes)
    rough = sorted_groups(lists.select("coord", "value", "i", "j", "id", "signature"), ["coord", "value", "i", "j"], "a binary, b binary",
                          lambda ids, sigs: signature_forest(ids, sigs, s.matches))
    groups = written(components(rough, "near-rough"), "near-groups")
    discard(postings)

    # Full sets are made again for the candidates only; their texts pass a sieve of the ids, and what
    # passes but is no candidate falls out when the sets are joined.
    wanted = groups.join(classes.select("id", "least"), "id")
    texts = sieved(body.select("doc_id", "text"), sieve(wanted, "least"), F.col("doc_id")).where("__passes")

    def full(texts):
        for text in texts:
            found = shingles(text, s.words)
            if len(found):
                yield set_digest(found), found.tobytes()

    sets = map_rows(texts.select("text"), "id binary, shingles binary", full)
    members = written(sets.join(groups, "id").groupBy("root", "id").agg(F.min("shingles").alias("shingles")), "near-sets")
    pairs = in_block_pairs(members, ["root"], "id", "shingles", s.block, s.block_bytes)
    links = sorted_groups(pairs.select("root", "i", "j", "id", "shingles"), ["root", "i", "j"], "a binary, b binary",
                          lambda ids, sets: set_forest(ids, sets, s.percent))
    linked = written(components(links, "near-links"), "near-linked")
    discard(groups, members)

    least = linked.join(classes.select("id", "first"), "id")
    by_root = least.groupBy("root").agg(F.min("first").alias("of_root"))
    of_class = classes.select("id", "first").join(linked, "id", "left").join(by_root, "root", "left")
    of_class = of_class.select("id", F.coalesce("of_root", "first").alias("first"))
    return signed.select("doc_id", "sha", "n_shingles", "id").join(of_class, "id", "left").drop("id")


def near_groups(docs: DataFrame, settings: NearSettings = NearSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    component_id is the smallest id reachable over links, the row's own included; kept marks rows
    whose id it is. Texts without words (null ones too) have no shingles and are linked with
    nothing. Null ids are passed over by the minimum and are never kept beside a row with an id;
    rows that repeat an id are kept or not together. Other columns are not read.
    """
    result = _grouped(docs, settings, id_col, text_col, F.lit(None))
    component = F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id"))
    return result.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_duplicates(docs: DataFrame, settings: NearSettings = NearSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of linked ones: the one with the smallest id, null ids
    last, then with the smallest text digest. Texts without words all stay.

    Rows are told apart by id and text digest, so no row goes for another one's id. Where the row
    that stays repeats both, one of its copies is left. Rows that certainly are not listed as
    copies stay where they are; only those that pass the sieve are joined.
    """
    own_sha = F.unhex(F.sha2(F.col(text_col).cast("binary"), 256))
    keys = ["__null", "__id", "__sha"]

    def keyed(id_of: Column, sha: Column) -> list[Column]:
        doc = id_of.cast("long")
        return [doc.isNull().alias("__null"), F.coalesce(doc, F.lit(0).cast("long")).alias("__id"), sha.alias("__sha")]

    rows = _grouped(docs, settings, id_col, text_col, own_sha).where("first is not null")
    rows = rows.select(*keyed(F.col("doc_id"), F.col("sha")), _place().eqNullSafe(F.col("first")).alias("kept"))
    found = written(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).where("not kept or n > 1"), "near-gone")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    whole = docs.select(F.struct(*docs.columns).alias("whole"), *keyed(F.col(id_col), own_sha))
    marked = sieved(whole, written(sieve(found, *keys), "near-sieve"), *[F.col(k) for k in keys])
    met = hot_join(marked.where("__passes"), found, keys, "n", total, "left")
    once = met.where("kept").dropDuplicates(keys)
    stay = marked.where(~F.col("__passes")).select("whole").unionByName(met.where("n is null").select("whole")).unionByName(once.select("whole"))
    return stay.select("whole.*")


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh
  FROM w
), x AS (
  SELECT doc_id, unnest(sh) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b USING (g) WHERE a.doc_id < b.doc_id GROUP BY 1, 2
), l AS MATERIALIZED (
  SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 85 * (len(sa.sh) + len(sb.sh) - n)
), e AS MATERIALIZED (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(id, root) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id
)
SELECT doc_id, any_value(len(sh))::BIGINT AS n_shingles, min(root) AS component_id, doc_id = min(root) AS kept
FROM s JOIN r ON r.id = s.doc_id GROUP BY doc_id
"""

"""Language identification by rank-order n-gram profiles.

A profile lists the most frequent letter n-grams (one to three symbols, word borders as spaces) by
rank. A text gets the language whose profile has the smallest out-of-place distance: the sum over
the text's own ranked n-grams of the difference in rank, or the profile's length for an n-gram that
it lacks. Profiles are summed over a bounded, documented sample of labelled rows per language
(``sample_rows``); identification reads every whole text in one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_rows
from .common import fold

UNDETERMINED = "und"


@dataclass(frozen=True)
class ProfileSettings:
    """sample_rows: about so many rows of each language are learnt from (all, where there are fewer)."""

    length: int = 300
    sample_rows: int = 2_000
    folds: int = 3
    held_fold: int = 1


_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Keys (three 21-bit symbols) and counts of a text's letter n-grams; empty without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    letter = _letter_table()[codes] if len(codes) else np.zeros(0, dtype=bool)
    if not letter.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    c = np.where(letter, codes, 32)
    c = np.concatenate(([32], c[letter | np.concatenate(([True], letter[:-1]))], [32]))
    c = c[np.concatenate(([True], (c[1:] != 32) | (c[:-1] != 32)))]
    pairs = c[:-1] | c[1:] << 21
    keys = np.concatenate((c[c != 32], pairs, pairs[:-1] | c[2:] << 42))
    return np.unique(keys, return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    """The most frequent keys, by count, then by key."""
    if len(keys) > length:
        floor = np.partition(counts, len(counts) - length)[len(counts) - length]
        keys, counts = keys[counts >= floor], counts[counts >= floor]
    return keys[np.lexsort((keys, -counts))][:length]


def fit_profiles(docs: DataFrame, settings: ProfileSettings = ProfileSettings()) -> dict[str, list[int]]:
    """Each language's n-grams by rank, learnt from rows with a language outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), settings.folds) != settings.held_fold))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return {}
    shares = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, settings.sample_rows / n))])
    point = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit("language")), F.lit(1 << 30))
    sample = known.where(point < F.element_at(shares, F.col("lang")) * (1 << 30)).select("lang", F.col("text").alias("text"))

    def count(langs, texts):
        sums: dict[str, dict[int, int]] = {}
        for lang, text in zip(langs, texts):
            mine = sums.setdefault(lang, {})
            for k, n in zip(*map(np.ndarray.tolist, gram_counts(text))):
                mine[k] = mine.get(k, 0) + n
        for lang, mine in sums.items():
            for k, n in mine.items():
                yield lang, k, n

    sums = map_rows(sample, "lang string, gram long, n long", count).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_rank = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = sums.withColumn("place", F.row_number().over(by_rank)).where(F.col("place") <= settings.length)
    profiles: dict[str, list[int]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], r["place"])):  # length n-grams a language
        profiles.setdefault(r["lang"], []).append(r["gram"])
    return profiles


def identify(docs: DataFrame, profiles: dict[str, list[int]], settings: ProfileSettings = ProfileSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row, from whole texts.

    Texts that are null or hold no letter, and all texts where no language was learnt, get ``und``
    with score 0. Ties go to the language that sorts first. score is one minus the distance as a
    share of the largest possible one.
    """
    length = settings.length
    langs = sorted(profiles)
    packed = []
    for lang in langs:
        keys = np.array(profiles[lang], dtype=np.int64)
        order = np.argsort(keys)
        packed.append((keys[order], order))
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def work(ids, held, texts):
        for i, h, text in zip(ids, held, texts):
            keys, counts = gram_counts(text)
            if not len(keys) or not langs:
                yield i, h, UNDETERMINED, 0.0
                continue
            own = ranked(keys, counts, length)
            place = np.arange(len(own))
            best = None
            for lang, (known, rank) in zip(langs, shared.value):
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                gap = np.where(known[at] == own, np.abs(rank[at] - place), length)
                distance = int(gap.sum())
                if best is None or distance < best[0]:
                    best = (distance, lang)
            yield i, h, best[1], 1.0 - best[0] / (length * len(own))

    body = docs.select(F.col(id_col).cast("long").alias("doc_id"), (fold(F.col(id_col), settings.folds) == settings.held_fold).alias("held_out"), F.col(text_col).alias("text"))
    return map_rows(body, "doc_id long, held_out boolean, lang_pred string, score double", work)


def language_id(docs: DataFrame, settings: ProfileSettings = ProfileSettings()) -> DataFrame:
    return identify(docs, fit_profiles(docs, settings), settings)



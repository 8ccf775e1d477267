"""License notices by an exact set-similarity join between text blocks and templates.

A block is a window of consecutive words of a text, across lines, of at most ``1 / containment`` times
the words of the template (upper length filter); it matches when it holds at least that part of the
template's distinct words. A window can be moved to begin with a word of the template without
losing any, so the windows that begin with one are all that need a look. The join is exact: words
are ordered by their frequency over the whole corpus, rarest first; a window that contains enough of
a template must hold one of the template's first ``|T| - need + 1`` words (prefix filter) and
``need`` words of the template at all (lower length filter), and where its rarest one has place i in
the template, at most ``|T| - i`` can agree (positional filter). Survivors are verified on the full
sets. Everything is built-in expressions: no Python runs on the executors, nothing is shuffled but
the counts of the template vocabulary. A text costs time in proportion to the template words that it
holds, times the length of a window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases whose words must stand consecutively, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Templates of the similarity join: notice, label and the containment that a block needs. Fixed
#: values: the words of usual headers. Long notices that differ in one word need all of theirs.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": ("mit", 0.9),
    "licensed under the mit license": ("mit", 0.9),
    "licensed under the apache license version 2": ("apache-2", 0.9),
    "licensed under creative commons attribution cc by nc": ("cc-by-nc", 0.9),
    "licensed under creative commons attribution cc by sa": ("cc-by-sa", 0.9),
    "licensed under the gnu general public license version 3": ("gpl-3", 0.9),
    "licensed under the gnu general public license version 2": ("gpl-2", 0.9),
    "under the terms of the gnu general public license as published by the free software foundation either version 3": ("gpl-3", 1.0),
    "under the terms of the gnu general public license as published by the free software foundation either version 2": ("gpl-2", 1.0),
    "under the terms of the gnu lesser general public license": ("lgpl", 0.9),
    "licensed under the gnu lesser general public license": ("lgpl", 0.9),
    "subject to the terms of the mozilla public license": ("mpl-2", 0.9),
    "redistribution and use in source and binary forms with or without modification are permitted": ("bsd", 0.9),
    "copyright all rights reserved proprietary and confidential": ("proprietary", 0.9),
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case. lower() does the same to every word but those with the two letters whose
    lower case is or holds an ASCII letter; only their texts take the slow path."""
    odd = F.contains(text, F.lit("\u212a")) | F.contains(text, F.lit("\u0130"))
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def word_text(text: Column) -> Column:
    """The words of a text, each with one space on either side; a text without words is one space."""
    spaced = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD, " ")
    return F.concat(F.lit(" "), F.trim(spaced), F.lit(" "))


def spaces(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))).cast("long")


def word_count(words: Column) -> Column:
    return F.when(words == "  ", F.lit(0)).otherwise(spaces(words) - 1).cast("long")


def corpus_order(words: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary, rarest first by the number of documents that hold each word, then by word.

    The counts cover every document; their table has one row per vocabulary word, so what reaches
    the driver is bounded by the templates.
    """
    bag = F.array(*[F.lit(w) for w in vocabulary])
    held = F.explode(F.array_intersect(bag, F.split(F.col("words"), " "))).alias("word")
    counts = {r["word"]: r["n"] for r in words.select(held).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def window_length(template: str, threshold: float) -> int:
    """The most words that a block may have."""
    return math.floor(len(template.split()) / threshold + 1e-9)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: dict[str, tuple[str, float]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    base_labels come from consecutive phrases anywhere in the text (n_base counts all places,
    first_word and last_word are their smallest and largest starts, null without any); labels adds
    those of the similarity join. score is 1 where a phrase stands, else the largest containment
    of a matching template, else 0. Null texts count as empty; every input row gives one row; other
    columns are not read. Words count wherever lines break, so a wrapped notice is found, and words
    that are scattered over more than a window are not.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    words = docs.select(F.col(id_col).alias("doc_id"), word_text(F.col(text_col)).alias("words"))
    vocabulary = sorted({w for t in templates for w in t.split()})
    rank = {w: i for i, w in enumerate(corpus_order(words.select("words"), vocabulary))} if vocabulary else {}

    entries, prefix_words = [], set()
    for notice, (label, threshold) in templates.items():
        ordered = sorted(set(notice.split()), key=rank.__getitem__)
        need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
        prefix = ordered[: len(ordered) - need + 1]
        prefix_words |= set(prefix)
        entries.append((label, ordered, need, prefix, window_length(notice, threshold)))

    def contained(ordered: list[str], need: int, prefix: list[str], length: int) -> Column:
        """The largest containment of a template in any window; null where none matches."""
        own = F.filter("marks", lambda m: m["word"].isin(ordered))

        def held(marks: Column, i: Column) -> Column:
            start = F.get(marks, i)["place"]
            window = F.filter(F.slice(marks, i + 1, F.lit(length)), lambda m: m["place"] < start + length)
            block = F.transform(window, lambda m: m["word"])
            rarest = F.lit(len(ordered))
            for place, word in reversed(list(enumerate(prefix))):
                rarest = F.when(F.array_contains(block, word), place).otherwise(rarest)
            passes = (F.size(block) >= need) & (F.lit(len(ordered)) - rarest >= need)
            return F.when(passes, F.size(F.array_distinct(block)))

        # A one-element array names the marks, so that they are filtered once.
        best = F.transform(F.array(own), lambda marks: F.array_max(F.transform(F.sequence(F.lit(0), F.size(marks) - 1), lambda i: held(marks, i))))
        some = " (?:" + "|".join(sorted(prefix)) + ") "
        shared = F.when(F.col("words").rlike(some) & F.exists("marks", lambda m: m["word"].isin(ordered)), F.get(best, F.lit(0)))
        return F.when(shared >= need, shared / len(ordered))

    hits = F.array().cast("array<struct<label:string,score:double>>")
    if entries:
        listed = F.transform(F.split(F.btrim("words"), " "), lambda w, i: F.struct(w.alias("word"), i.alias("place")))
        any_prefix = " (?:" + "|".join(sorted(prefix_words)) + ") "
        marked = words.withColumn("marks", F.when(F.col("words").rlike(any_prefix), F.filter(listed, lambda m: m["word"].isin(vocabulary))))
        found = [F.struct(F.lit(label).alias("label"), contained(*rest).cast("double").alias("score")) for label, *rest in entries]
        hits = F.when(F.col("marks").isNotNull(), F.filter(F.array(*found), lambda h: h["score"].isNotNull())).otherwise(hits)
        words = marked
    staged = words.select("doc_id", "words", hits.alias("hits"))

    total = word_count(F.col("words"))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in phrases.items():
        n = len(phrase.split())
        pieces = F.split(F.col("words"), f" {phrase}(?= )", -1)
        has = F.contains(F.col("words"), F.lit(f" {phrase} "))
        counts.append(F.when(has, F.size(pieces) - 1).otherwise(0).cast("long"))
        firsts.append(F.when(has, spaces(F.element_at(pieces, 1))))
        lasts.append(F.when(has, total - n - (spaces(F.element_at(pieces, -1)) - 1)))
        labels.append(F.when(has, F.lit(label)))
    found = staged.select(
        "doc_id",
        total.alias("n_words"),
        sum(counts[1:], counts[0]).alias("n_base"),
        F.array_min(F.array(*firsts)).alias("first_word"),
        F.array_max(F.array(*lasts)).alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"),
        "hits",
    )
    both = F.array_sort(F.array_union(F.col("base"), F.transform("hits", lambda h: h["label"])))
    best = F.coalesce(F.array_max(F.transform("hits", lambda h: h["score"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(best).cast("double").alias("score"),
    )


def license_sql() -> str:
    """The scan with the default phrases and templates: every window that begins with a word of a
    template is compared with it, by a join of places."""
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    listed = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
    phrases = ", ".join(f"('{label}', {listed(p.split())})" for p, label in PHRASES.items())
    templates = ", ".join(f"({i}, '{label}', {listed(sorted(set(t.split())))}, {window_length(t, least)}, {least})" for i, (t, (label, least)) in enumerate(TEMPLATES.items()))
    return rf"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{words}') AS ws FROM documents
), ph(label, p) AS (VALUES {phrases}), te(i, label, t, width, least) AS (VALUES {templates}),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(1, len(ws) + 1), lambda i: ws[i:i + len(p) - 1] = p)) - 1 AS place FROM w, ph
), b AS (
  SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi FROM places GROUP BY doc_id
), every_word AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM w
), tw AS (
  SELECT i, unnest(t) AS word, width FROM te
), marks AS MATERIALIZED (
  SELECT doc_id, i, word, place, width FROM every_word JOIN tw USING (word)
), windows AS (
  SELECT a.doc_id, a.i, a.place, count(DISTINCT z.word) AS n
  FROM marks a JOIN marks z ON z.doc_id = a.doc_id AND z.i = a.i AND z.place >= a.place AND z.place < a.place + a.width
  GROUP BY a.doc_id, a.i, a.place
), hits AS (
  SELECT doc_id, label, max(n) / any_value(len(t)) AS share FROM windows JOIN te USING (i) WHERE n >= ceil(least * len(t) - 1e-9) GROUP BY doc_id, i, label
), best AS (
  SELECT doc_id, max(share) AS share FROM hits GROUP BY doc_id
), base AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT doc_id, label FROM places) GROUP BY doc_id
), every AS (
  SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo AS first_word, b.hi AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels,
       CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(best.share, 0)::DOUBLE END AS score
FROM w LEFT JOIN b USING (doc_id) LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)
"""

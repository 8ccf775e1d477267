"""The source audit against plain code with Python's integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from stratavec.llm.divergence import AuditSettings, audit_sources, encoded, shares, stretch_counts

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = AuditSettings(min_docs=2, chunk_terms=3, stretch_bytes=60)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plainly(rows, s):
    """rows: (lang, source, text)"""
    rows = [(a or "", b or "", TERM.findall(lowered(t))) for a, b, t in rows]
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    for lang, source, words in rows:
        docs[lang].update(set(words))
        counts[lang, source].update(words)
    out = []
    for lang in {a for a, *_ in rows}:
        kept = sorted((t for t, n in docs[lang].items() if n >= s.min_docs), key=lambda t: t.encode())
        sources = sorted({b for a, b, _ in rows if a == lang}, key=str.encode)

        def share(of):
            n = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + s.smoothing) // (n + s.smoothing * len(kept)) for t in kept}

        p = {x: share(counts[lang, x]) for x in sources}
        q = share(sum((counts[lang, x] for x in sources), Counter()))
        for x in sources:
            pairs = [(-sum(abs(p[x][t] - p[y][t]) for t in kept), y.encode(), y) for y in sources if y != x]
            terms = [(q[t] - p[x][t], t.encode(), t) for t in kept if counts[lang, x][t] and p[x][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:s.top])):
                out += [(lang, x, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string")


def made(seed, count):
    draw = random.Random(seed)
    words = ["The", "the", "Été", "été", "naïve", "z", "Z", "zz", "\U0001f600", "ß", "ẞ", "İ", "İx", "a1b", "x-y", "'s", "", "ˇ", "\x00"]
    return [(draw.choice(["en", "fr", None, ""]), draw.choice(["s1", "s2", "S1", "é", None]), draw.choice([" ", ", ", "\n"]).join(draw.choice(words) for _ in range(draw.choice([0, 1, 4, 30])))) for _ in range(count)]


@pytest.mark.parametrize("settings", [SMALL, AuditSettings(min_docs=3), AuditSettings(min_docs=2, top=2, chunk_terms=1), AuditSettings(min_docs=1000)])
def test_equals_plain_code(spark, settings):
    rows = made(4, 120)
    assert sorted(map(tuple, audit_sources(table(spark, rows), settings).collect())) == plainly(rows, settings)


def test_odd_rows_and_repeats(spark):
    from conftest_rows import ODD

    rows = [("xx", f"s{i % 3}", t) for i, (_, t) in enumerate(ODD)] * 2 + [("yy", "alone", None), ("zz", "a", "!!"), ("zz", "b", "")]
    assert sorted(map(tuple, audit_sources(table(spark, rows), SMALL).collect())) == plainly(rows, SMALL)


def test_empty_table(spark):
    assert audit_sources(table(spark, [])).collect() == []


def test_shares_are_exact_beyond_int64():
    draw = random.Random(1)
    for bits in (8, 30, 34, 50, 58):
        total = draw.getrandbits(bits) + 10
        counts = np.array(sorted({0, 1, total - 5, total // 2, total // 3, draw.randrange(total)} - {-1}))
        counts = counts[(counts >= 0) & (counts <= total - 5)]
        assert shares(counts, 5, total).tolist() == [1 + 10**9 * (c + 5) // total for c in counts.tolist()]


def test_many_sources_are_cut_into_blocks(monkeypatch):
    from stratavec.llm import divergence

    monkeypatch.setattr(divergence, "SOURCE_BLOCK", 2)
    of = divergence.Chunk(3, np.array([0, 1, 2, 0, 2, 1, 0]), np.array([4, 0, 1, 2, 2, 3, 3]), np.array([5, 1, 2, 3, 4, 6, 7]), np.array([9, 9, 9, 20, 30]), 5, SMALL)
    whole = {(i, p): v for i, places, values in of.gaps() for p, v in zip(places.tolist(), values.tolist())}
    dense = np.concatenate([of.dense(i)[1] for i in (0, 2, 4)])
    assert whole == {(i, j): int(np.abs(dense[i] - dense[j]).sum()) for i in range(5) for j in range(5)}


def test_terms_end_with_their_text():
    words, ids, text = encoded(pa.array(["", "ab", "", "Cd e", "é", "1"], pa.string())[1:])
    assert [(words[i].as_py().decode(), t) for i, t in zip(ids.tolist(), text.tolist())] == [("ab", 0), ("cd", 2), ("e", 2), ("é", 3)]
    group, terms, n, docs = stretch_counts(pa.array(["a b a", "a", ""]), np.array([7, 7, 9]))
    assert sorted(zip(group.tolist(), terms.to_pylist(), n.tolist(), docs.tolist())) == [(7, b"a", 3, 2), (7, b"b", 1, 1)]

"""Fill-in-middle against plain code: texts of one chunk, texts of many, marks across chunks, odd rows."""

import hashlib
import random
import re

import pytest

from stratavec.llm.automaton import LineAutomaton
from stratavec.llm.fim import FimSettings, fill_in_middle, restored

SMALL = FimSettings(chunk_chars=7, giant_chars=20)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(doc_id, text, s=FimSettings()):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(lines)
    digest = hashlib.sha256(f"{s.salt}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in s.marks) or h3 % 100 >= s.rate:
        return (doc_id, n, "plain", None, None, sha(text), sha(text), text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (lines[:a], lines[a:b], lines[b:]))
    p, sx, m = s.marks
    form = "spm" if h4 % 100 < s.spm else "psm"
    out = f"{sx}{suf}{p}{pre}{m}{mid}" if form == "spm" else f"{p}{pre}{sx}{suf}{m}{mid}"
    return (doc_id, n, form, len(pre), len(mid), sha(out), sha(text), out)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(seed, count):
    draw = random.Random(seed)
    letters = ["\n", "\n", "a", "é", "\U0001f600", " ", "<", "P", "S", "M", ">", "\r", " "]
    return [(i, "".join(draw.choice(letters) for _ in range(draw.choice([0, 1, 2, 6, 7, 8, 14, 20, 21, 22, 60, 300])))) for i in range(count)]


@pytest.mark.parametrize("settings", [FimSettings(), SMALL, FimSettings(chunk_chars=1, giant_chars=1), FimSettings(rate=40, spm=10, chunk_chars=5, giant_chars=9)])
def test_equals_plain_code(documents, settings):
    rows = made(3, 250) + [(900 + i, "x" * i + m + "y" * 30) for i in range(9) for m in ("<P>", "<S>", "<M>", "<P", "<<S>", "M>")] + [(990, "line\n" * 400), (991, "\n" * 300), (992, "w" * 500)]
    found = fill_in_middle(documents(rows), settings, with_output=True)
    assert rows_of(found) == sorted((plainly(i, t, settings) for i, t in rows), key=repr)


def test_odd_rows(odd):
    from conftest_rows import ODD

    for settings in (FimSettings(), FimSettings(chunk_chars=1000, giant_chars=2000)):
        assert rows_of(fill_in_middle(odd, settings, with_output=True)) == sorted((plainly(i, t, settings) for i, t in ODD), key=repr)


def test_empty_table(documents):
    assert fill_in_middle(documents([])).collect() == []


def test_restored_from_output_and_form():
    for doc_id, text in made(5, 300):
        _, _, form, *_, out = plainly(doc_id, text)
        assert restored(out, form) == text


def test_marks_that_overlap_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("abc", "b", "x"), ("", "a", "b"), ("aba", "x", "y")):
        with pytest.raises(ValueError):
            FimSettings(marks=marks)


def test_functions_compose_in_any_grouping():
    automaton = LineAutomaton(("<P>", "<S>", "<M>"))
    for _, text in made(9, 120):
        ends, counts = automaton.summary(text)
        for cut in range(len(text) + 1):
            (e1, c1), (e2, c2) = automaton.summary(text[:cut]), automaton.summary(text[cut:])
            assert (e2[e1] == ends).all() and (c1 + c2[e1] == counts).all()

import hashlib
import re

from stratavec.llm.pii import find_pii, redact_documents

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in value.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and luhn(digits),
        "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def base(text):
    return {k: [(m.start(), m.end()) for m in re.finditer(p, text or "") if passes(k, m.group())] for k, p in PATTERNS.items()}


def check(df, rows):
    got = {}
    for r in find_pii(df).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for i, t in rows:
        spans = base(t)
        listed = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in spans[k])
        want = (*[len(spans[k]) for k in PATTERNS], hashlib.sha256(listed.encode()).hexdigest())
        assert any((r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == want and set(filter(None, listed.split(","))) <= set(r["spans"].split(",")) for r in got[i]), (i, (t or "")[:60])


TEXTS = [
    "mail a.b+c@mail.example.com, and x@y.z_d@e.f now", "é 😀 10.0.0.1 then 256.1.1.1 and 1.2.3.4.5.6.7.8", "card 4111 1111 1111 1111, 4111-1111-1111-1112",
    "call +1 (017) 555-7713 or +12 3", "4532015112830366", "00000.0.0.000255", "two cards 4532015112830366 4532015112830366", "a@b.c.d@e.f", "+1..2 +3 4 5 6 7 8 9 0", "..@a.b @@ a@b a@b..c",
]


def test_base_spans_against_a_regex_engine(documents):
    rows = list(enumerate(TEXTS))
    check(documents(rows), rows)


def test_random_texts(documents):
    import random

    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["1", "4", "0", "25", ".", ".", "@", "a", "b-", " ", "+", "(", ")", "-", "é", "_"]) for _ in range(rng.choice([5, 30, 200])))) for i in range(400)]
    check(documents(rows), rows)


def test_odd_rows(odd):
    from conftest_rows import ODD

    check(odd, ODD)
    assert find_pii(odd.limit(0)).count() == 0


def added(df):
    """(doc_id, kind, start, end) of all spans beside the base ones."""
    return {(r["doc_id"], s["kind"], s["start"], s["end"]) for r in find_pii(df).collect() for s in r["found"] if not s["base"]}


def planted(rows):
    """Texts made of parts, and the spans of the parts that have a kind."""
    texts, spans = [], set()
    for i, parts in rows:
        text = ""
        for part in parts:
            if isinstance(part, tuple):
                spans.add((i, part[0], len(text), len(text) + len(part[1])))
                part = part[1]
            text += part
        texts.append((i, text))
    return texts, spans


def digits_with_checksum(n, good):
    return next(s for s in (f"{n}{d}" for d in range(10)) if luhn(s) == good)


def corpus(secrets):
    """Planted data beside base spans, and what only looks alike: numbers of 15 digits of which one in
    ten has a right checksum, serial numbers in the form of a local phone, short secrets."""
    import random

    rng = random.Random(4)
    rows = []
    for i in range(secrets):
        rows.append((i, ["set ", ("secret", f'token = "{hashlib.sha1(str(i).encode()).hexdigest()}"'), " é\n"]))
    for i in range(100, 160):
        rows.append((i, ["card ", ("card", digits_with_checksum(f"3782{rng.randrange(10 ** 10):010}", True)), " paid"]))
        rows.append((i + 100, ["ssn ", ("id", f"{rng.randrange(100, 600)}-{rng.randrange(1, 99):02}-{rng.randrange(1, 9999):04}"), "."]))
        rows.append((i + 200, ["call ", ("phone", f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(10 ** 4):04}"), " or +1 (407) 555-7710"]))
    for i in range(1000, 1200):
        rows.append((i, [f"number {rng.randrange(10 ** 14, 10 ** 15)} and words"]))
        rows.append((i + 1000, [f"mail u{i}@mail.example.com, host 10.0.{i % 200}.1"]))
        rows.append((i + 2000, ['token = "word" only words and 12 small 345 numbers']))
    return rows


def test_planted_spans_are_found_and_others_left(documents):
    for secrets in (1, 13, 60):
        rows, spans = planted(corpus(secrets))
        found = added(documents(rows))
        assert len(found & spans) / len(spans) >= 0.95  # recall
        assert len(found & spans) / len(found) >= 0.95  # precision
        assert {s for s in spans if s[1] == "secret"} <= found


def test_added_spans_pass_their_checks_and_overlap_nothing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in find_pii(docs).collect():
        spans = sorted((s["start"], s["end"], s["kind"], s["base"]) for s in r["found"])
        assert r["n_spans"] == len(spans)
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]) if not (a[3] and b[3]))
        for start, end, kind, base_span in spans:
            value = texts[r["doc_id"]][start:end]
            if not base_span and kind == "card":
                assert luhn(re.sub("[^0-9]", "", value))
            if not base_span and kind == "secret":
                assert re.search("[0-9]", value) and len(value) >= 24


def test_failures_of_a_generator_with_few_candidates_select_nothing_wrong(documents):
    rows = [(i, f"number {digits_with_checksum(f'{i + 11}' * 7, False)} end") for i in range(7)] + [(50, "valid 4222222222222 end")]
    assert added(documents(rows)) <= {(50, "card", 6, 19)}


def test_redaction(documents):
    rows = [(1, "write a@b.example now"), (2, None), (3, "é 10.0.0.1 😀 10.0.0.2"), (4, "plain")]
    df = documents(rows)
    out = {r["doc_id"]: r["text"] for r in redact_documents(df).collect()}
    assert out == {1: "write [EMAIL] now", 2: None, 3: "é [IP] 😀 [IP]", 4: "plain"}
    assert redact_documents(df).columns == df.columns


def test_without_trees_secrets_among_look_alikes_are_lost(documents):
    """The trees decide about secrets: numbers and words of letters and digits are candidates, too."""
    from stratavec.llm.pii import BoostSettings

    rows, spans = planted(corpus(40) + [(5000 + i, [f"run a{i}b{i * 7919}c and order {10 ** 15 + 12347 * i}"]) for i in range(100)])
    secrets = {s for s in spans if s[1] == "secret"}

    def found(rounds):
        out = find_pii(documents(rows), settings=BoostSettings(rounds=rounds)).collect()
        return {(r["doc_id"], s["kind"], s["start"], s["end"]) for r in out for s in r["found"] if s["kind"] == "secret"}

    assert found(40) == secrets
    assert not found(0) & secrets


def test_a_judged_span_needs_no_check(documents):
    """An assigned value without letters fails the check, but looks and stands like the others."""
    rows, _ = planted(corpus(60) + [(9000, ["set ", 'token = "' + "70614" * 8 + '"', " é\n"])])
    assert any(i == 9000 and kind == "secret" for i, kind, *_ in added(documents(rows)))


def test_trees_grow_and_decide_on_the_given_tables(spark):
    import os

    import pytest

    from stratavec.llm.pii import GENERATORS, BoostSettings, fit, propose

    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    seen = propose(spark.read.parquet(path), "doc_id", "text").persist()
    (_, trees), limits = fit(seen)
    assert len(trees) == BoostSettings().rounds
    assert 0 < limits[GENERATORS.index("secret")] < 1
    assert fit(seen, BoostSettings(rounds=0))[1][GENERATORS.index("secret")] == 2.0

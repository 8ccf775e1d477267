import hashlib
import random
import re

from stratavec.llm.exact_dedup import drop_exact_duplicates, exact_groups


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[normal(t)] if x is not None]
        out.append((i, min(ids, default=None), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()))
    return sorted(out, key=str), len(groups)


def run(df):
    got = exact_groups(df).collect()
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str), sum(r["kept"] for r in got)


def test_against_brute_force(documents):
    rng = random.Random(1)
    base = ["".join(rng.choice("ab \n") for _ in range(rng.choice([0, 1, 5, 64, 65, 300]))) for _ in range(30)]
    long = "p" * 700
    base += [long, long + "q", long + "r", long + "q" * 6000, long + "q" * 5999 + "r", "p" * 64, "p" * 63, "p" * 640]
    rows = [(i, rng.choice(base)) for i in range(300)]
    assert run(documents(rows)) == expected(rows)


def test_odd_rows(documents, odd):
    from conftest_rows import ODD

    assert run(odd) == expected(ODD)


def test_empty_table(documents):
    assert run(documents([])) == ([], 0)
    assert drop_exact_duplicates(documents([])).count() == 0


def test_hot_group(documents):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}") for i in range(900)]
    assert run(documents(rows)) == expected(rows)


def test_drop_leaves_one_row_of_each_group(documents, odd):
    from conftest_rows import ODD

    kept = drop_exact_duplicates(odd)
    assert kept.columns == odd.columns
    texts = [normal(r["text"]) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({normal(t) for _, t in ODD})

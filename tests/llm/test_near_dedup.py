import hashlib
import random

import numpy as np
import pytest

from stratavec.llm import near_dedup as N


def words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))


def sets(t):
    w = words(t)
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def expected(rows):
    s = [sets(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
                parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((doc, len(s[i]), least if s[i] else doc, doc == (least if s[i] else doc)))
    return sorted(out, key=str)


CUT = N.NearSettings(percent=85, matches=14)


def run(df, settings=CUT):
    return sorted(map(tuple, N.near_groups(df, settings).collect()), key=str)


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, bases = [], []
    for i in range(n):
        if bases and rng.random() < 0.6:
            w = list(rng.choice(bases))
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 5, 40, 90, 150]))]
            if rng.random() < 0.4:
                w += passage
            bases.append(w or ["x"])
        rows.append((i, " ".join(w).title() if rng.random() < 0.3 else "\n ".join(w)))
    rng.shuffle(rows)
    return rows


def test_against_all_pairs(documents):
    for seed in (1, 2):
        rows = corpus(seed)
        assert run(documents(rows)) == expected(rows)


def test_small_blocks_lose_nothing(documents):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3])):
            w[rng.randrange(200)] = f"v{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    want = expected(rows)
    assert run(documents(rows), N.NearSettings(percent=85, matches=14, block=7)) == want
    assert run(documents(rows), N.NearSettings(percent=85, matches=14, block_bytes=20_000)) == want


def test_odd_rows(documents, odd):
    from conftest_rows import ODD

    rows = [(i, t) for i, t in ODD]
    assert run(odd) == expected(rows)
    assert run(documents([])) == []
    assert N.drop_near_duplicates(documents([])).count() == 0


def test_one_document_of_each_group_stays(documents):
    rows = corpus(5)
    df = documents(rows)
    kept = N.drop_near_duplicates(df, CUT)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, _, _, k in expected(rows) if k)


def test_rows_with_null_and_repeated_ids_go_one_by_one(documents):
    def text(name, last=""):
        return " ".join(f"{name}{i}" for i in range(60)) + last

    rows = [
        (1, text("a")), (None, text("a", " x")), (None, text("b")), (None, ""), (None, None), (None, " \n"),  # a copy without an id takes no other row along
        (2, text("c")), (3, text("c", " x")), (3, text("d")),  # nor does a copy under a repeated id
        (4, text("e")), (4, text("e", " x")),  # copies under one id
        (None, text("f")), (None, text("f", " x")),  # copies without ids
        (5, text("g")), (5, text("g")), (6, text("g", " x")), (None, text("h")), (None, text("h")),  # rows that repeat id and text
        (7, ""), (7, ""),
    ]
    kept = [(r["doc_id"], r["text"]) for r in N.drop_near_duplicates(documents(rows)).collect()]
    least = lambda *texts: min(texts, key=lambda t: hashlib.sha256(t.encode()).digest())
    assert sorted(kept, key=str) == sorted([
        (1, text("a")), (None, text("b")), (None, ""), (None, None), (None, " \n"), (2, text("c")), (3, text("d")),
        (4, least(text("e"), text("e", " x"))), (None, least(text("f"), text("f", " x"))), (5, text("g")), (None, text("h")), (7, ""), (7, ""),
    ], key=str)


def test_components_of_paths_and_stars(spark):
    edges = [(f"{i:03}".encode(), f"{i + 1:03}".encode()) for i in range(60)] + [(b"900", f"{i}".encode()) for i in range(901, 940)] + [(b"zz", b"zz")]
    got = {bytes(r["id"]): bytes(r["root"]) for r in N.components(spark.createDataFrame(edges, "a binary, b binary"), "t").collect()}
    assert all(got[f"{i:03}".encode()] == b"000" for i in range(61)) and all(got[str(i).encode()] == b"900" for i in range(900, 940))


@pytest.mark.parametrize("members, values", [(2, 3), (3, 2), (60, 4), (300, 40)])
def test_merged_collisions_equal_those_of_all_pairs(members, values):
    rng = np.random.default_rng(members)
    for matches in (1, 5, 8):
        s = rng.integers(0, values, (members, 8)).astype(np.uint32)
        s[rng.integers(0, members, members // 3), :6] = s[0, :6]  # hot values
        ids = [i.to_bytes(2, "big") for i in range(members)]
        found = list(N.signature_forest(ids, [row.tobytes() for row in s], matches))
        root = list(range(members))
        for a in range(members):
            for b in range(a):
                if (s[a] == s[b]).sum() >= matches:
                    low, high = sorted((root[a], root[b]))
                    root = [low if r == high else r for r in root]
        assert sorted(found) == sorted((ids[i], ids[r]) for i, r in enumerate(root) if i != r)


@pytest.mark.parametrize("seed", range(4))
def test_forests_connect_what_links_connect(seed):
    rng = np.random.default_rng(seed)
    members = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(40)]
    ids = [bytes([i]) for i in range(40)]

    def roots(edges):
        parent = list(range(40))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[find(a)] = find(b)
        return [min(j for j in range(40) if find(j) == find(i)) for i in range(40)]

    full = [(i, j) for i in range(40) for j in range(i) if 100 * len(np.intersect1d(members[i], members[j])) >= 45 * len(np.union1d(members[i], members[j]))]
    found = [(a[0], b[0]) for a, b in N.set_forest(ids, [m.tobytes() for m in members], 45)]
    assert roots(found) == roots(full) and len(found) < 40

import random
import zlib

import numpy as np

from stratavec.llm.language_id import ProfileSettings, gram_counts, identify, language_id, ranked
from stratavec.llm.toxicity import FtrlSettings, drop_toxic, score_toxicity, toxicity, train_ftrl


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def corpus(n=600):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    bad = ["vile", "rotten"]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([5, 40, 200]))]
        toxic = int(i % 5 == 0)
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(bad)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, documents):
    rows, labels = corpus()
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity(documents(rows), table).collect()}
    assert len(got) == len(rows) and all(r["held_out"] == (fold(i, 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    held = [i for i in got if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == labels[i][2] for i in held]) > 0.95


def test_held_out_labels_are_not_learnt(spark, documents):
    rows, labels = corpus(200)
    flipped = [(i, q, 1 - t if fold(i, 4) == 2 else t) for i, q, t in labels]
    make = lambda x: spark.createDataFrame(x, "doc_id long, quality int, toxic int")
    a, b = (sorted(map(tuple, toxicity(documents(rows), make(x)).collect())) for x in (labels, flipped))
    assert a == b


def test_toxicity_odd_rows(spark, documents, odd):
    labels = spark.createDataFrame([(1, 1, 1), (4, 1, None), (4, 1, 0), (4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity(odd.limit(0), labels).count() == 0
    assert score_toxicity(odd, []).where("score = 0.5").count() == odd.count()
    kept = drop_toxic(odd, labels.limit(0), FtrlSettings(cut=0.6))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_ftrl_is_sparse():
    rng = np.random.default_rng(5)
    examples = []
    for i in range(400):
        at = rng.choice(np.arange(1000, 60000), 50, replace=False)
        y = i % 2
        examples.append((np.sort(np.append(at, 7 + y)), y))
    at, w, _ = train_ftrl(examples, FtrlSettings())
    assert len(at) < 200 and dict(zip(at.tolist(), w))[8] > 1 > -1 > dict(zip(at.tolist(), w))[7]


TEXTS = {"en": "the quick brown fox and the lazy dog with this thing ", "de": "der schnelle braune fuchs und die faule katze mit nicht ", "ru": "быстрая коричневая лиса и ленивая собака не это "}


def test_languages(spark, documents):
    rng = random.Random(6)
    parts = []
    for lang, text in TEXTS.items():
        words = text.split()
        n = len(parts)
        parts.append(documents([(1000 * n + i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 30])))) for i in range(60)], lang))
    docs = parts[0].unionByName(parts[1]).unionByName(parts[2])
    got = language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 180 and np.mean([r["lang"] == r["lang_pred"] for r in got if r["held_out"]]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (fold(r["doc_id"], 3) == 1) for r in got)


def test_language_odd_rows(documents, odd):
    got = language_id(odd).collect()
    assert len(got) == odd.count()
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 7, 9)} == {"und"}
    assert language_id(odd.limit(0)).count() == 0
    assert {r["lang_pred"] for r in identify(odd, {}).collect()} == {"und"}
    from pyspark.sql import functions as F

    assert {r["lang_pred"] for r in language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_ranks_and_distance_against_plain_code(documents):
    from collections import Counter

    def grams(text):
        t = " "
        for c in text.lower():
            t += c if c.isalpha() else " " if t[-1] != " " else ""
        t = t if t[-1] == " " else t + " "
        return Counter([c for c in t if c != " "] + [t[i:i + 2] for i in range(len(t) - 1)] + [t[i:i + 3] for i in range(len(t) - 2)])

    for text in ("Hello, World!  hello", "a", "É-1é2", "x" * 50, "ab ab ba"):
        keys, counts = gram_counts(text)
        found = {"".join(chr((k >> s) & 0x1FFFFF) for s in (0, 21, 42) if (k >> s) & 0x1FFFFF): n for k, n in zip(keys.tolist(), counts.tolist())}
        assert found == grams(text)
        assert [dict(zip(keys.tolist(), counts.tolist()))[k] for k in ranked(keys, counts, 5).tolist()] == sorted(found.values(), reverse=True)[:5]
    profiles = {"x": [ord("a"), ord("b")], "y": [ord("b")]}
    r = identify(documents([(1, "bbb a")]), profiles, ProfileSettings(length=4)).first()
    keys, counts = gram_counts("bbb a")
    own = ranked(keys, counts, 4).tolist()
    distance = {k: sum(abs(p.index(g) - i) if g in p else 4 for i, g in enumerate(own)) for k, p in profiles.items()}
    best = min(sorted(distance), key=distance.get)
    assert r["lang_pred"] == best and abs(r["score"] - (1 - distance[best] / (4 * len(own)))) < 1e-12


def plain_grams(text, bits):
    import re
    import zlib

    h = [zlib.crc32(w.encode("utf-8", "replace")) for w in re.findall(r"[^\W_]+", (text or "").lower())]
    mask, mix, step = 2**64 - 1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
    out = [x * mix & mask for x in h]
    out += [((a * step + b + 1) & mask) * mix & mask for a, b in zip(h, h[1:])]
    out += [((a * step + b + 2) & mask) * mix & mask for a, b in zip(h, h[2:])]
    return sorted({x >> (64 - bits) for x in out})


def plain_ftrl(examples, s):
    """Coordinate by coordinate, in dictionaries."""
    import math

    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        l1 = 0.0 if i == "b" else s.l1
        l2 = 0.0 if i == "b" else s.l2
        beta = s.beta
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / s.alpha + l2)

    for _ in range(s.epochs):
        for at, label in examples:
            w = {i: weight(i) for i in [*at, "b"]}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values())))))
            g = p - label
            for i, wi in w.items():
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / s.alpha
                z[i] = z.get(i, 0.0) + g - sigma * wi
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i) != 0.0}


def test_toxicity_scores_against_plain_ftrl(spark):
    import math
    import random
    import zlib

    from stratavec.llm.toxicity import FtrlSettings, toxicity

    rng = random.Random(6)
    s = FtrlSettings(bits=12, l1=0.5)
    words = [f"w{i}" for i in range(30)] + ["é", "Vile", "vile_x"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25))) + (" you vile thing" if i % 5 == 0 else "")) for i in range(240)]
    labels = [(i, int(i % 5 == 0)) for i in range(0, 240, 2)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, label string")
    got = {r["doc_id"]: r for r in toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), s).collect()}

    fold = lambda i: zlib.crc32(str(i).encode()) % 4
    texts = dict(rows)
    known = sorted((i for i, _ in labels if fold(i) != 2), key=lambda i: (zlib.crc32(str(i).encode()), i))
    model = plain_ftrl([(plain_grams(texts[i], s.bits), dict(labels)[i]) for i in known], s)
    assert len(model) > 5
    for i, text in rows:
        margin = sum(model.get(g, 0.0) for g in plain_grams(text, s.bits)) + model.get("b", 0.0)
        want = 1 / (1 + math.exp(-margin))
        assert abs(got[i]["score"] - want) < 1e-9 and got[i]["held_out"] == (fold(i) == 2) and got[i]["predicted"] == int(want >= 0.3)

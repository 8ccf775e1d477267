"""Expressions, kernels and sources against NumPy."""

import struct

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stratavec.functions import hashing, kernels, vec
from stratavec.plans.draws import permutation, probe_masks
from stratavec.plans.params import CubeParams, KMeansParams, LshParams, PqParams, SearchParams
from stratavec.sources import vectors as src

M = hashing.MODULUS


def frame(spark, rows, dim=None):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, vec array<float>")


def test_distances(spark):
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal(7), rng.standard_normal(7)
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    r = df.select(vec.l2(F.col("a"), F.col("b")), vec.l2sq(F.col("a"), F.col("b")), vec.dot(F.col("a"), F.col("b"))).first()
    assert np.allclose(list(r), [np.linalg.norm(a - b), ((a - b) ** 2).sum(), a @ b])


def test_splits_cover_the_dimension():
    assert vec.splits(10, 4) == [(0, 3), (3, 3), (6, 2), (8, 2)]
    assert vec.splits(2, 4) == [(0, 1), (1, 1), (2, 0), (2, 0)]
    for d in range(1, 40):
        for m in range(1, 12):
            cut = vec.splits(d, m)
            assert sum(n for _, n in cut) == d and max(n for _, n in cut) - min(n for _, n in cut) <= 1


def test_composite_is_exact_at_extremes(spark):
    rng = np.random.default_rng(3)
    hs = [0, 1, -1, M - 1, M, -M, 2**62, -(2**62), *rng.integers(-(2**62), 2**62, 40).tolist()]
    rs = [M - 1, 1, 65535, 65536, *rng.integers(1, M, 44).tolist()]
    df = spark.createDataFrame([(hs, rs)], "h array<long>, r array<long>")
    got = df.select(hashing.composite(F.col("h"), F.col("r"))).first()[0]
    assert got == sum(r * (h % M) for h, r in zip(hs, rs)) % M


def test_sign_bits_are_pure_and_vertices_add_up(spark):
    h, a, b = [5, -7, 5, 2**40], [3, 11, 3, 101], [1, 2, 1, 4]
    df = spark.createDataFrame([(h, a, b)], "h array<long>, a array<long>, b array<long>")
    bits, at = df.select(hashing.sign_bits(F.col("h"), F.col("a"), F.col("b")).alias("bits")).select("bits", hashing.vertex(F.col("bits"))).first()
    want = [((x % hashing.SIGN_PRIME) * y + z) % hashing.SIGN_PRIME % 2 for x, y, z in zip(h, a, b)]
    assert bits == want and at == sum(x << i for i, x in enumerate(want)) and bits[0] == bits[2]


def test_probe_masks_walk_the_cube():
    assert probe_masks(3, 8) == [0, 1, 2, 4, 3, 5, 6, 7]
    for p in range(1, 8):
        masks = probe_masks(p, 1 << p)
        assert sorted(masks) == list(range(1 << p))
        assert [bin(m).count("1") for m in masks] == sorted(bin(m).count("1") for m in masks)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 30), st.integers(1, 5), st.integers(1, 8), st.integers(0, 10**6))
def test_nearest_equals_sorting(rows, dim, n, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-2, 3, (rows, dim)).astype(float) * (1 if seed % 2 else 1e5)
    q = rng.integers(-2, 3, (3, dim)).astype(float)
    ids = rng.permutation(rows).astype(np.int64)
    found = {i: (ids[p].tolist(), d.tolist()) for i, p, d in kernels.nearest(q, ids, x, n)}
    for i in range(3):
        want = sorted(((round(float(np.sqrt(((x[j] - q[i]) ** 2).sum())), 9), int(ids[j])) for j in range(rows)))[:n]
        assert found[i][0] == [j for _, j in want]


def test_permutation_samples_without_replacement():
    p = permutation(5)
    assert len({(i % p.prime * p.factor + p.shift) % p.prime for i in range(5000)}) == 5000


def test_parameters_are_validated():
    for make in (lambda: LshParams(width=0), lambda: CubeParams(projections=63), lambda: PqParams(bits=17), lambda: KMeansParams(k=0), lambda: SearchParams(n=0)):
        with pytest.raises(ValueError):
            make()


# ---------------------------------------------------------------- files

def fvecs(rows):
    return b"".join(struct.pack("<i", len(r)) + np.asarray(r, "<f4").tobytes() for r in rows)


def test_fvecs(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((50, 8)).astype("<f4")
    f = tmp_path / "sift.fvecs"
    f.write_bytes(fvecs(x))
    got = src.read_fvecs(spark, str(f), dim=8).orderBy("id").collect()
    assert [r["id"] for r in got] == list(range(50)) and np.array_equal(np.array([r["vec"] for r in got], "<f4"), x)
    assert src.read_fvecs(spark, str(f), limit=7, dim=8).count() == 7
    f.write_bytes(fvecs(x) + b"\x08\x00")  # a cut dimension word ends the file
    assert src.read_fvecs(spark, str(f), dim=8).count() == 50
    f.write_bytes(fvecs(x)[:-4])
    with pytest.raises(ValueError):
        src.read_fvecs(spark, str(f), dim=8)
    f.write_bytes(fvecs(x[:, :3]))
    with pytest.raises(Exception, match="dimension"):
        src.read_fvecs(spark, str(f), dim=8).collect()
    f.write_bytes(b"")
    assert src.read_fvecs(spark, str(f), dim=8).count() == 0


def test_idx3(spark, tmp_path):
    px = np.random.default_rng(2).integers(0, 256, (5, 6), dtype=np.uint8)
    f = tmp_path / "mnist.idx3"
    f.write_bytes(struct.pack(">IIII", 2051, 5, 2, 3) + px.tobytes())
    got = src.read_idx3(spark, str(f), limit=-1).orderBy("id").collect()
    assert np.array_equal(np.array([r["vec"] for r in got]), px)
    assert src.read_idx3(spark, str(f), limit=3).count() == 3
    ones = src.read_idx3(spark, str(f), normalise=True).orderBy("id").collect()
    assert np.allclose([r["vec"] for r in ones], px / 255)
    assert src.load_vectors(spark, str(f)).count() == 5
    f.write_bytes(struct.pack(">IIII", 2052, 5, 2, 3) + px.tobytes())
    with pytest.raises(Exception, match="magic"):
        src.read_idx3(spark, str(f)).collect()
    f.write_bytes(struct.pack(">IIII", 2051, 5, 2, 3) + px.tobytes()[:-1])
    with pytest.raises(Exception, match="ends"):
        src.read_idx3(spark, str(f)).collect()


def test_bad_vectors_are_refused(spark):
    good = frame(spark, [[1, 2], [3, 4]])
    assert src.checked(good).count() == 2
    for bad in ([(0, [1.0, 2.0]), (1, [1.0])], [(0, [1.0, 2.0]), (1, [1.0, float("nan")])], [(0, [1.0, 2.0]), (1, None)]):
        with pytest.raises(Exception, match="bad vector"):
            src.checked(spark.createDataFrame(bad, "id long, vec array<float>")).collect()

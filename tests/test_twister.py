import numpy as np
import pytest

from stratavec.functions.hashing import PLACE_FACTOR, first_outputs, twister_bits
from stratavec.operators.cube import Hypercube
from stratavec.plans.params import CubeParams
from stratavec.sources.indexes import read_index, write_index


def generator(seed: int) -> int:
    return int(np.random.RandomState(seed).randint(0, 2**32, dtype=np.uint32))


def test_first_outputs_are_those_of_the_generator():
    seeds = np.concatenate(([0, 1, 5489, 2**32 - 1], np.random.default_rng(1).integers(0, 2**32, 200)))
    assert first_outputs(seeds).tolist() == [generator(int(s)) for s in seeds]
    assert first_outputs(np.array([5489]))[0] == 3499211612  # the generator's published check value


def test_bits_are_seeded_by_hash_and_place():
    h = np.array([[-3, 2, 2**40], [5, -1, 0], [5, -1, 0]])
    expected = [[generator((9 ^ (i * PLACE_FACTOR) % 2**32 ^ x % 2**64) % 2**32) % 2 for i, x in enumerate(row)] for row in h.tolist()]
    assert twister_bits(h, 9).tolist() == expected
    assert twister_bits(np.zeros((0, 3), dtype=np.int64), 9).shape == (0, 3)


def test_a_cube_by_these_bits_is_built_stored_and_searched(spark, tmp_path):
    x = np.random.default_rng(2).standard_normal((90, 5))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")
    q = v.where("id % 10 = 0").selectExpr("id AS qid", "vec AS qvec")
    p = CubeParams(5, 2.0, 1000, 32, 1, "twister")
    index = Hypercube(5, p).build_index(v)
    columns = Hypercube(5, p).build_index(v, engine="columns")
    assert sorted(index.rows.select("id", "vertex").collect()) == sorted(columns.rows.select("id", "vertex").collect())
    write_index(index, str(tmp_path / "i"))
    found = sorted(index.knn_query(q, 3).select("qid", "rank", "id").collect())
    assert found == sorted(read_index(spark, str(tmp_path / "i")).knn_query(q, 3).select("qid", "rank", "id").collect())
    assert len(found) == 27  # every vertex is probed


def test_other_sources_of_bits_are_refused():
    with pytest.raises(ValueError):
        CubeParams(bits="dice")

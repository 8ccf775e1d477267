"""Vector files as data sources: splits, several files, limits, filters and mistakes."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratavec.sources import formats
from stratavec.sources import vectors as src


def fvecs(x):
    return b"".join(struct.pack("<i", len(r)) + np.asarray(r, "<f4").tobytes() for r in x)


def idx3(x, height, width):
    return struct.pack(">IIII", 2051, len(x), height, width) + x.tobytes()


@pytest.fixture
def folder(tmp_path):
    """Files of 40, 0 and 25 vectors, of 30 and 7 images, and files to be left out."""
    rng = np.random.default_rng(4)
    x, px = rng.standard_normal((65, 5)).astype("<f4"), rng.integers(0, 256, (37, 6), dtype=np.uint8)
    for name, data in (("v/part-0.fvecs", fvecs(x[:40])), ("v/part-1.fvecs", b""), ("v/part-2.fvecs", fvecs(x[40:]) + b"\x05"), ("v/_SUCCESS", b""), ("v/.part-0.crc", b"no vectors"),
                       ("i/a.idx3", idx3(px[:30], 2, 3)), ("i/b.idx3", idx3(px[30:], 2, 3))):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path, x, px


def rows(df):
    got = df.orderBy("id").collect()
    return [r["id"] for r in got], np.array([r["vec"] for r in got], dtype=np.float64)


def test_format_names_read_several_files_in_splits(spark, folder):
    path, x, px = folder
    formats.register(spark)
    df = spark.read.format("fvecs").option("dim", 5).option("split_bytes", 24 * 7).load(str(path / "v"))
    assert df.rdd.getNumPartitions() == 6 + 4
    ids, got = rows(df)
    assert ids == list(range(65)) and np.array_equal(got, x.astype(float))
    df = spark.read.format("idx3").option("split_bytes", 6 * 4).load(str(path / "i"))
    assert df.rdd.getNumPartitions() == 8 + 2
    ids, got = rows(df)
    assert ids == list(range(37)) and np.array_equal(got, px)


def test_a_pattern_and_a_single_file(spark, folder):
    path, x, px = folder
    assert rows(src.read_fvecs(spark, str(path / "v" / "part-[02].fvecs"), dim=5))[0] == list(range(65))
    assert np.array_equal(rows(src.read_fvecs(spark, str(path / "v" / "part-2.fvecs"), dim=5))[1], x[40:].astype(float))
    assert np.allclose(rows(src.read_idx3(spark, f"file://{path}/i/b.idx3", normalise=True))[1], px[30:] / 255)
    with pytest.raises(FileNotFoundError):
        src.read_fvecs(spark, str(path / "nothing"), dim=5)


def test_limits_plan_no_further_slice(folder):
    path, *_ = folder

    def planned(**options):
        return [(s.first, s.rows) for s in formats.FvecsReader({"path": str(path / "v"), "dim": "5", "split_bytes": str(24 * 10), **options}).partitions()]

    assert planned() == [(0, 10), (10, 10), (20, 10), (30, 10), (40, 10), (50, 10), (60, 5)]
    assert planned(limit="15") == [(0, 10), (10, 5)]
    assert planned(limit="41") == [(0, 10), (10, 10), (20, 10), (30, 10), (40, 1)]
    assert planned(limit="0") == [(0, 0)]
    assert planned(limit="-1") == planned(limit="999") == planned()


def test_filters_on_ids_choose_slices(spark, folder):
    path, x, _ = folder
    key = "spark.sql.python.filterPushdown.enabled"
    spark.conf.set(key, "true")
    try:
        df = src.read_fvecs(spark, str(path / "v"), dim=5, split_bytes=24 * 10)
        for condition, want in ((F.col("id") < 12, range(12)), ((F.col("id") >= 38) & (F.col("id") <= 41), range(38, 42)), (F.col("id") == 64, [64]), (F.col("id") > 64, []), (F.col("id") < -3, []),
                                ((F.col("id") > 50) & (F.col("id") % 2 == 0), range(52, 65, 2)), (F.col("id") >= 50, range(50, 65))):
            assert rows(df.where(condition))[0] == list(want)
        assert df.where(F.col("id") < 12).rdd.getNumPartitions() == 2
        assert df.where(F.col("id") == 64).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset(key)
    assert rows(src.read_fvecs(spark, str(path / "v"), dim=5).where(F.col("id") == 64))[0] == [64]


def test_mistakes_fail_with_their_reason(spark, folder):
    path, x, px = folder
    (path / "v" / "part-3.fvecs").write_bytes(fvecs(x[:2])[:-1])
    with pytest.raises(ValueError, match="cut short"):
        src.read_fvecs(spark, str(path / "v"), dim=5)
    (path / "v" / "part-3.fvecs").write_bytes(fvecs(x[:2]) + struct.pack("<i", 4) + x[0].tobytes())
    with pytest.raises(Exception, match="dimension 4"):
        src.read_fvecs(spark, str(path / "v"), dim=5).collect()
    (path / "i" / "c.idx3").write_bytes(idx3(px[:2], 1, 6)[:-1])
    with pytest.raises(ValueError, match="ends"):
        src.read_idx3(spark, str(path / "i"))
    (path / "i" / "c.idx3").write_bytes(idx3(px[:2], 1, 4))
    with pytest.raises(ValueError, match="dimensions"):
        src.read_idx3(spark, str(path / "i"))


def test_written_folders_are_read_back(spark, tmp_path):
    v = spark.range(0, 200, 1, 5).select("id", F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("vec"))
    assert src.write_fvecs(v, str(tmp_path / "out")) == 200
    ids, got = rows(src.read_fvecs(spark, str(tmp_path / "out"), dim=2, split_bytes=100))
    assert ids == list(range(200)) and got[:, 0].tolist() == [float(i) for i in range(200)]

"""Binary files written by a data source, and read back."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelathe.sources import files
from wavelathe.sources.frames import write_frames

SF = "/root/testdata/sf0.001"


def names(path):
    return sorted(os.listdir(path)) if os.path.isdir(path) else []


@pytest.fixture(scope="module")
def level(spark):
    e = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_id", F.array("value", F.col("value") * 2).alias("frame"))
    return e.repartition(4).cache()


def test_htk_round_trip_and_append(spark, level, tmp_path):
    path = f"{tmp_path}/htk"
    half = level.where("event_id % 2 = 0")
    write_frames(half, path, "user_id", "event_id", "frame", period=0.02)
    write_frames(level.where("event_id % 2 = 1"), path, "user_id", "event_id", "frame", period=0.02)
    want = {}
    for r in sorted(level.collect(), key=lambda r: (r["event_id"] % 2, r["event_id"])):
        want.setdefault(str(r["user_id"]), []).append(r["frame"])
    got = {}
    for r in sorted(files.read_htk(spark, path).collect(), key=lambda r: (r["file"], r["vidx"])):
        got.setdefault(r["file"].rsplit("/", 1)[1].removesuffix(".htk"), []).append(r["frame"])
        assert r["time"] == pytest.approx(r["vidx"] * 0.02)
    assert got.keys() == want.keys() and len(names(path)) == len(want)
    for k in want:
        assert np.allclose(got[k], want[k], rtol=1e-6)
    write_frames(half, path, "user_id", "event_id", "frame", mode="overwrite")
    assert files.read_htk(spark, path).count() == half.count()


def test_waves_and_dumps(spark, level, tmp_path):
    one = level.withColumn("frame", F.transform("frame", lambda v: v / 500))
    write_frames(one, f"{tmp_path}/wave", "user_id", "event_id", "frame", "wave", rate=8000)
    write_frames(one.limit(0), f"{tmp_path}/wave", "user_id", "event_id", "frame", "wave", rate=8000)
    write_frames(one, f"{tmp_path}/dump", "user_id", "event_id", "frame", "dump")
    for k, rows in {r["user_id"]: 0 for r in one.collect()}.items():
        want = np.array([r["frame"] for r in sorted(one.where(F.col("user_id") == k).collect(), key=lambda r: r["event_id"])])
        rate, x = files.decode_wave(open(f"{tmp_path}/wave/{k}.wav", "rb").read())
        assert rate == 8000 and np.allclose(x, want.reshape(-1), atol=1e-4)
        assert np.allclose(files.decode_dump(open(f"{tmp_path}/dump/{k}.dump", "rb").read()), want, rtol=1e-6)
        break


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", i, [1.0]) for i in range(9)] + [("b/c", i, [1.0] * (1 + i)) for i in range(2)] + [(None, 0, [1.0])], "name string, i int, frame array<double>")
    path = f"{tmp_path}/out"
    with pytest.raises(Exception, match="different sizes"):
        write_frames(df, path, "name", "i", "frame")
    assert [f for _, _, fs in os.walk(path) for f in fs] == []
    write_frames(df.where("i = 0"), path, "name", "i", "frame")
    assert names(path) == ["a.htk", "b%2Fc.htk", "null.htk"]


def test_raw_samples():
    x = np.array([-1.0, -0.25, 0.0, 0.5, 1.0])
    for size in (2, 3, 4):
        v = np.rint(x * (2 ** (8 * size - 1) - 1)).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()
        assert np.allclose(files.decode_raw(v + b"\x01", size=size), x, atol=1e-4)
    packed = np.rint(x * (2**23 - 1)).astype("<i4").view(np.uint8).reshape(-1, 4).copy()
    packed[:, 3] = 0
    assert np.allclose(files.decode_raw(packed.tobytes(), size=4, bits=24), x, atol=1e-6)
    assert np.allclose(files.decode_raw(x.astype("<f4").tobytes(), size=4, real=True), x)
    assert np.allclose(files.decode_raw(np.rint(x * 127 + 128).astype(np.uint8).tobytes(), size=1), x, atol=0.01)
    assert files.decode_raw(x.astype("<f4").tobytes()[:16], 2, 4, False, True).shape == (2, 2)

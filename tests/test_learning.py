"""Transforms learned in parts, and normalisation inside live turns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelathe.operators import blocks, learning, windows
from wavelathe.operators.blocks import Blocks
from wavelathe.series import of_level
from wavelathe.streaming.gated import live_gated_mvn

B = Blocks(("k",), 8)


@pytest.fixture(scope="module")
def level(spark):
    rng = np.random.default_rng(8)
    return spark.createDataFrame([(k, i, float(v)) for k in range(4) for i, v in enumerate(rng.normal(1e6, 2, 20 + 13 * k))], "k int, vidx long, x double").cache()


def close(a, b, *cols):
    a, b = (sorted(tuple(r) for r in d.select(*cols).collect()) for d in (a, b))
    assert len(a) == len(b)
    for u, v in zip(a, b):
        assert u[:-1] == pytest.approx(v[:-1]) and u[-1] == pytest.approx(v[-1], rel=1e-4, abs=1e-4)


def test_two_halves_equal_one_run(spark, level, tmp_path):
    path = f"file://{tmp_path}/saved"
    assert learning.load(spark, path) is None
    learning.learn(level.where("vidx < 15"), ["k"], "x", path)
    got = learning.learn(level.where("vidx >= 15"), ["k"], "x", path)
    assert learning.versions(spark, path) == [0, 1]
    one = learning.moments(level, ["k"], "x")
    for c in learning.MOMENTS:
        close(got, one, "k", c)
    want = windows.applied(level, windows.learned(level, ["k"], "x"), ["k"], "x")
    close(learning.applied(level, got, ["k"], "x"), want, "k", "vidx", "x")
    some = learning.load(spark, path, 0).where("k < 2")
    kept = learning.applied(level, some, ["k"], "x").where("k >= 2")
    close(kept, level.where("k >= 2"), "k", "vidx", "x")


def test_running_normalisation_goes_on(level):
    first, rest = level.where("vidx < 15"), B.renumbered(level.where("vidx >= 15"))
    got = learning.continued_mvn(rest, B, "x", learning.moments(first, ["k"], "x")).withColumn("vidx", F.col("vidx") + 15)
    want = B.running_mvn(level, "x").where("vidx >= 15")
    close(got, want, "k", "vidx", "x_mvn")
    close(learning.continued_mvn(level, B, "x", None), B.running_mvn(level, "x"), "k", "vidx", "x_mvn")
    small = level.withColumn("x", F.col("x") - 1e6)
    first, rest = small.where("vidx < 15"), B.renumbered(small.where("vidx >= 15"))
    a, saved = learning.continued_exponential_mvn(first, B, "x", alpha=0.9)
    b, _ = learning.continued_exponential_mvn(rest, B, "x", saved, 0.9)
    close(a.union(b.withColumn("vidx", F.col("vidx") + 15)), blocks.exponential_mvn(small, B, "x", 0.9), "k", "vidx", "x_mvn")


def test_a_stream_is_learned_once(spark, level, tmp_path):
    path = f"file://{tmp_path}/saved"
    for part in ("vidx < 9", "vidx >= 9"):
        level.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(level.schema).parquet(f"{tmp_path}/in")
        learning.learn_stream(stream, ["k"], "x", path, f"{tmp_path}/c").awaitTermination()
    for c in learning.MOMENTS:
        close(learning.load(spark, path), learning.moments(level, ["k"], "x"), "k", c)


@pytest.mark.parametrize("reset", [True, False])
def test_gated_normalisation_equals_batch(spark, level, tmp_path, reset):
    turns = spark.createDataFrame([(k, s, a, b) for k in range(4) for s, (a, b) in enumerate([(2, 6), (7, 7), (10, 18)])], "k int, segment long, start long, stop long")
    rows = spark.readStream.schema(level.schema).parquet(f"{tmp_path}/rows") if (tmp_path / "rows").mkdir() is None else None
    spans = spark.readStream.schema(turns.schema).parquet(f"{tmp_path}/turns") if (tmp_path / "turns").mkdir() is None else None
    # Rows come ahead of their turns, and turns ahead of their rows.
    for row, turn in (("vidx < 5", "segment = 0"), ("vidx >= 5 and vidx < 9", "segment = 9"), ("vidx >= 9", "segment > 0")):
        level.where(row).coalesce(1).write.mode("append").parquet(f"{tmp_path}/rows")
        turns.where(turn).coalesce(1).write.mode("append").parquet(f"{tmp_path}/turns")
        q = live_gated_mvn(rows, spans, ["k"], "x", reset).writeStream.option("checkpointLocation", f"{tmp_path}/c").format("parquet").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    marked = level.join(turns, "k").where("vidx between start and stop")
    want = marked.withColumn("mvn", windows.gated_mvn(("k",), "x", "segment", reset))
    close(spark.read.parquet(f"{tmp_path}/out"), want, "k", "vidx", "segment", "mvn")


def test_waiting_rows_are_bounded_and_losses_told(spark, level, tmp_path):
    level.coalesce(1).write.parquet(f"{tmp_path}/rows")
    (tmp_path / "turns").mkdir()
    spans = spark.readStream.schema("k int, segment long, start long, stop long").parquet(f"{tmp_path}/turns")
    rows = spark.readStream.schema(level.schema).parquet(f"{tmp_path}/rows")
    q = live_gated_mvn(rows, spans, ["k"], "x", most=12).writeStream.format("memory").queryName("bounded").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["k"]: (r["lost"], r["segment"]) for r in spark.table("bounded").collect()} == {k: (20 + 13 * k - 12, -1) for k in range(4)}

"""Sequential kernels, files, graphs and streams against closed forms and round trips."""

import numpy as np
from pyspark.sql import functions as F

from wavelathe.operators import kernels, segments
from wavelathe.plans import catalog, graph
from wavelathe.sources import files
from wavelathe.streaming import live


def test_linear_prediction_finds_the_filter():
    rng = np.random.default_rng(0)
    x = np.zeros(20000)
    for i in range(2, len(x)):
        x[i] = 1.2 * x[i - 1] - 0.6 * x[i - 2] + rng.normal()
    for a in (kernels.lpc(x, 2)[0], kernels.lpc_burg(x, 2)[0]):
        assert np.allclose(a, [-1.2, 0.6], atol=0.03)
    w = kernels.lsp(kernels.lpc(x, 4)[0])
    assert len(w) == 4 and (np.diff(w) > 0).all()
    f, bw = kernels.formants(np.array([-1.2, 0.6]), 1000, 1, 499)
    root = np.roots([1, -1.2, 0.6])[0]
    assert np.isclose(f[0], abs(np.angle(root)) * 1000 / (2 * np.pi)) and bw[0] > 0


def test_peaks_turns_and_onsets():
    x = np.array([0, 0, 5, 5, 5, 0, 0, 5, 0], float)
    assert kernels.onsets(x)["numonsets"] == 2 and kernels.onsets(x)["offsetpos"] == 8
    assert kernels.turns([0, 1, 1, 1, 0, 0, 0, 1, 1, 1, 1], 0.5, pre=1, post=1) == [(1, 3), (7, 10)]
    s = np.sin(np.arange(200) * 2 * np.pi / 20)
    got = kernels.peaks2(s)
    assert got["numpeaks"] == 10 and abs(got["meanpeakdist"] - 20) < 1e-9 and got["meanfallingslope"] < 0 < got["meanrisingslope"]


def test_pitch():
    t = np.arange(1600) / 16000
    x = sum(np.sin(2 * np.pi * 200 * h * t) / h for h in (1, 2, 3))
    assert abs(kernels.pitch_acf(x, 16000)[0] - 200) < 2
    mag = np.abs(np.fft.rfft(x * np.hanning(1600), 4096))
    assert abs(kernels.pitch_shs(mag, 16000)[0][0] - 200) < 5
    path = kernels.viterbi_pitch([[(200, 0.9), (100, 0.8)], [(205, 0.8), (410, 0.85)], [(202, 0.95)]])
    assert path[0] == 200 and path[1] == 205
    assert kernels.jitter(np.sin(2 * np.pi * np.arange(800) / 40), 40)["jitterlocal"] < 0.01
    assert (kernels.smooth_pitch([0, 100, 0, 100, 100, 0, 0, 90, 0])[-2:] == 0).all()


def test_spline_and_modulation():
    z = np.linspace(0, 3, 20)
    assert np.allclose(kernels.spline(z, 2 * z + 1, [0.1, 1.5, 2.9]), [1.2, 4.0, 6.8])
    x = np.sin(2 * np.pi * 2 * np.arange(1000) / 100)
    assert kernels.modulation(x).argmax() == 3
    assert np.abs(kernels.rasta(np.ones((50, 2)))).max() < 1e-12


def test_files(spark, tmp_path):
    x = np.sin(np.arange(400) / 7)
    rate, back = files.decode_wave(files.encode_wave(x, 8000))
    assert rate == 8000 and np.allclose(back, x, atol=1e-4)
    (tmp_path / "a.wav").write_bytes(files.encode_wave(x, 8000))
    row = files.read_waves(spark, str(tmp_path / "a.wav"), start=-0.01, stop=0.02).first()
    assert row["rate"] == 8000 and len(row["pcm"]) == 240 and row["pcm"][:80] == [0.0] * 80
    frames = np.arange(12.0).reshape(4, 3)
    period, kind, a = files.decode_htk(files.encode_htk(frames))
    assert abs(period - 0.01) < 1e-9 and kind == 9 and (a == frames).all()
    (tmp_path / "a.htk").write_bytes(files.encode_htk(frames))
    assert files.read_htk(spark, str(tmp_path / "a.htk")).count() == 4
    assert (files.decode_dump(files.encode_dump(frames)) == frames).all()
    df = spark.createDataFrame([(0, 1.5, "it's"), (1, None, "b")], "vidx long, x double, name string")
    files.write_arff(df, f"{tmp_path}/arff")
    assert sorted(map(tuple, files.read_arff(spark, f"{tmp_path}/arff").collect()), key=str) == [(0.0, 1.5), (1.0, None)]
    files.write_csv(df.select("name", "vidx", "x"), f"{tmp_path}/csv", "name")
    assert files.read_csv(spark, f"{tmp_path}/csv").columns == ["frameIndex", "x"]
    packed = files.packed_files(spark.createDataFrame([("s", 1, [1.0, 2.0]), ("s", 0, [3.0, 4.0])], "name string, vidx long, v array<double>"), "name", "vidx", "v").first()
    assert files.decode_htk(bytes(packed["data"]))[2].tolist() == [[3, 4], [1, 2]]
    assert abs(files.signal(spark, 100, frequency=1.0).agg(F.sum("x")).first()[0]) < 1e-9


def test_lists_and_graph(spark):
    assert segments.parse_list("0-9,1.5s-2s,25", 0.1) == [(0, 9), (15, 20), (21, 45)]
    graph.operator("double")(lambda df, by=2: df.withColumn("x", F.col("x") * by))
    out = graph.build([{"type": "double", "reads": ["b"], "writes": "c", "options": {"by": 3}}, {"type": "double", "reads": ["a"], "writes": "b"}], {"a": spark.range(2).withColumn("x", F.lit(1.0))})
    assert out["c"].first()["x"] == 6.0


def test_live_turns_equal_batch_turns(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    e = catalog.events(spark, sf).select("user_id", "vidx", "x")
    want = kernels.turns_of(e, ["user_id"], ["vidx"], "x", on=50.0, off=45.0, pre=1, post=1)
    e.coalesce(1).sortWithinPartitions("user_id", "vidx").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = live.live_turns(stream, "user_id", "vidx", "x", 50.0, 45.0, 1, 1).writeStream.format("memory").queryName("live_turns").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("live_turns").collect()}
    # A turn is closed by two rows at or below the threshold; one that the input's end leaves open is not told.
    last = {r["user_id"]: r["n"] for r in e.groupBy("user_id").agg(F.max("vidx").alias("n")).collect()}
    assert got == {tuple(r) for r in want.collect() if r["stop"] + 2 <= last[r["user_id"]]}
    t = spark.readStream.schema(spark.read.parquet(f"{sf}/events.parquet").schema).parquet(f"{sf}/events.parq*")
    q = live.tumbling(t, "ts", "user_id", "value").writeStream.format("memory").queryName("tumbling").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("tumbling").count() > 0

"""Operators without SQL against closed forms, brute force and round trips; and what growth in rows does to plans."""

import itertools
import json
import math
import time

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from wavelathe.functions import functionals as fn
from wavelathe.functions import scales, spectral, vectors
from wavelathe.operators import kernels, models, segments, windows
from wavelathe.plans import graph, nodes  # noqa: F401
from wavelathe.series import of_level, period_of, with_period
from wavelathe.sources import files, plugins
from wavelathe.streaming import live

S = of_level("k")


def level(spark, values, key="a"):
    return spark.createDataFrame([(key, i, float(v)) for i, v in enumerate(values)], "k string, vidx long, x double")


def column(df, c):
    return [r[c] for r in df.orderBy("vidx").select(c).collect()]


def test_every_node_is_registered_once(spark):
    assert len(graph.OPERATORS) > 60 and {"select", "frame", "energy", "functionals", "turns", "join"} <= set(graph.OPERATORS)
    with pytest.raises(ValueError, match="no operator"):
        graph.build([{"type": "nothing", "reads": ["a"], "writes": "b"}], {"a": spark.range(1)})
    with pytest.raises(ValueError, match="two writers"):
        graph.build([{"type": "smooth", "reads": ["a"], "writes": "a"}], {"a": level(spark, [1, 2])}, keys=("k",))


def test_periods_must_agree(spark):
    a, b = with_period(level(spark, [1, 2, 3]), 0.01), with_period(level(spark, [4, 5]).withColumnRenamed("x", "y"), 0.02)
    assert period_of(a) == 0.01 and period_of(level(spark, [1])) is None
    with pytest.raises(ValueError, match="periods"):
        segments.join_levels(("k",), a, b)
    out = segments.join_levels(("k",), a, b, force=True)
    assert out.count() == 2 and period_of(out) == 0.01


def test_vector_expressions_are_linear(spark):
    """An aggregate bound once: eight times the values take well under the 64 times of evaluating it for each value."""
    took = {}
    for n in (512, 4096):
        rows = spark.createDataFrame([Row(v=[math.sin(i + j) for i in range(n)]) for j in range(60)], "v array<double>")
        rows.persist().count()
        cols = [vectors.operation("norm_rms", F.col("v")), vectors.entropy(F.col("v")), vectors.operation("nr1", F.col("v"))]
        best = 9e9
        for _ in range(3):
            began = time.time()
            rows.select(*[(F.aggregate(c, F.lit(0.0), lambda a, x: a + x) if i != 1 else c).alias(f"c{i}") for i, c in enumerate(cols)]).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
        took[n] = best
        rows.unpersist()
    assert took[4096] < 30 * max(took[512], 0.03)


def test_recursive_windows_have_no_cross_join_or_single_partition(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("user_id", "event_id as vidx", "value as x")
    out = windows.turns_between(df, of_level("user_id"), "x", 50.0, 45.0, 1, 2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "SinglePartition" not in plan


def test_turns_between_equals_the_state_machine(spark):
    rng = np.random.default_rng(3)
    rows, want = [], set()
    for k in range(40):
        x = rng.integers(0, 4, rng.integers(1, 60))
        rows += [(str(k), i, float(v)) for i, v in enumerate(x)]
        want |= {(str(k), i, a, b) for i, (a, b) in enumerate(kernels.turns(x, 2, 1, 1, 2))}
    df = spark.createDataFrame(rows, "k string, vidx long, x double")
    assert {tuple(r) for r in windows.turns_between(df, S, "x", 2, 1, 1, 2).collect()} == want


def brute_path(rows, cost):
    return min(itertools.product(*[range(len(r) + 1) for r in rows]), key=lambda p: (cost(rows, p),))


def test_viterbi_takes_the_cheapest_of_all_paths():
    rng = np.random.default_rng(5)

    def cost(rows, path):
        total, change, was = 0.0, 0.0, None
        for r, j in zip(rows, path):
            f, p = r[j] if j < len(r) else (0.0, 1 - max(c[1] for c in r))
            p = min(max(p, 1e-6), 1.0)
            total += -2 * math.log(p) + (1.0 if f > 0 and p < 0.7 else 0) + (1.0 if f > 0 and (f < 100 or f > 350) else 0)
            if was is not None:
                total += 0.0 if f == was == 0 else 10 * abs(math.log(f / was)) if f > 0 and was > 0 else 10.0
            was = f
        return total

    for _ in range(30):
        rows = [[(float(rng.uniform(80, 400)), float(rng.uniform(0.1, 0.95))) for _ in range(2)] for _ in range(5)]
        path = brute_path(rows, cost)
        want = [r[j][0] if j < len(r) else 0.0 for r, j in zip(rows, path)]
        # Without the cost of a change of change, a path's cost is a sum over neighbours, and the search exact.
        assert kernels.viterbi_pitch(rows, w_vvd=0.0).tolist() == want


def test_two_field_segments_and_means(spark):
    e = level(spark, [0, 0, 5, 5, 5, 0, 0, 5, 0])
    assert column(e.withColumn("y", windows.held(S, "x")), "y") == [0, 0, 5, 5, 5, 5, 5, 5, 5]
    assert column(e.withColumn("y", windows.without_spikes(S, "x")), "y") == [0, 0, 5, 5, 5, 0, 0, 0, 0]
    f = level(spark, [100, 101, 204, 99, 51, 0, 100])
    assert column(f.withColumn("y", windows.octave_corrected(S, "x")), "y") == [100, 101, 102, 99, 102, 0, 100]


def test_gated_normalisation_starts_anew_in_each_turn(spark):
    e = level(spark, [1, 3, 9, 4, 8]).withColumn("t", F.expr("case when vidx < 2 then 0 when vidx > 2 then 1 end"))
    got = column(e.withColumn("y", windows.gated_mvn(("k",), "x", "t")), "y")
    assert got[2] is None and got[0] == got[3] == 0 and got[1] == pytest.approx(1) and got[4] == pytest.approx(1)
    got = column(e.withColumn("y", windows.gated_mvn(("k",), "x", "t", reset=False)), "y")
    assert got[4] == pytest.approx((8 - 4) / np.std([1, 3, 4, 8]))


def test_spectra_there_and_back(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=64)
    df = spark.createDataFrame([(v.tolist(),), (None,), ([],)], "v array<double>")
    back = df.select(spectral.inverse_fft(spectral.fft("v")).alias("y")).collect()
    assert np.allclose(back[0]["y"], v) and back[1]["y"] is None
    mag, phase = df.select(spectral.magnitude("v").alias("m"), spectral.phase("v").alias("p")).first()
    assert np.allclose(mag, np.abs(np.fft.rfft(v))) and np.allclose(phase, np.angle(np.fft.rfft(v)))
    cep = df.select(spectral.cepstrum(spectral.magnitude("v")).alias("c")).first()["c"]
    assert np.allclose(cep, np.fft.irfft(np.log(np.abs(np.fft.rfft(v))))[:33])
    half = df.select(spectral.resampled(F.col("v"), 0.5).alias("y")).first()["y"]
    smooth = spark.createDataFrame([([math.sin(2 * math.pi * 3 * i / 64) for i in range(64)],)], "v array<double>")
    assert len(half) == 32 and np.allclose(smooth.select(spectral.resampled(F.col("v"), 0.5).alias("y")).first()["y"], [math.sin(2 * math.pi * 3 * i / 32) for i in range(32)], atol=1e-9)
    bands = spark.createDataFrame([([float(x) for x in rng.uniform(1, 5, 12)],)], "b array<double>")
    logs = np.log(np.array(bands.first()["b"]))
    c = bands.select(F.col("b"), spectral.mfcc(F.col("b"), 12, 0, 11, lifter=0).alias("c"))
    got = np.log(c.select(spectral.inverse_mfcc(F.col("c"), 12, 0, 0, 11).alias("y")).first()["y"])
    assert np.allclose(got, logs)
    axis = smooth.select(spectral.resampled_axis(spectral.magnitude("v"), 16000, 24, "linear", 250.0).alias("y")).first()["y"]
    assert len(axis) == 24 and np.argmax(axis) in (1, 2, 3)


def test_plp_of_a_flat_spectrum_and_rasta(spark):
    df = spark.createDataFrame([([5.0] * 12,)], "b array<double>")
    centres = [200.0 * (k + 1) for k in range(12)]
    got = df.select(spectral.plp(F.col("b"), centres).alias("c")).first()["c"]
    f2 = np.array(centres) ** 2
    loud = (f2 + 56.8e6) * f2 * f2 / ((f2 + 6.3e6) ** 2 * (f2 + 0.38e9))
    s = (5 * loud / loud.max()) ** 0.33
    acf = np.fft.irfft(np.concatenate([s[:1], s, s[-1:]]))
    r = np.array([[acf[abs(i - j)] for j in range(5)] for i in range(5)])
    a = -np.linalg.solve(r, acf[1:6])
    assert np.allclose(got, kernels.lpc_cepstrum(a, acf[0] + a @ acf[1:6]))
    x = np.random.default_rng(0).normal(size=(40, 2))
    y = kernels.rasta(x)
    pad = np.concatenate([np.repeat(x[:1], 4, 0), x])
    for i in range(1, 40):
        num = 0.1 * (2 * pad[i + 4] + pad[i + 3] - pad[i + 1] - 2 * pad[i])
        assert np.allclose(y[i], 0.94 * y[i - 1] + num)


def test_prediction_kernels():
    rng = np.random.default_rng(2)
    x = rng.normal(size=300)
    a, gain, refl = kernels.lpc(x, 6)
    assert np.allclose(kernels.residual(x, a), np.convolve(x, [1, *a])[:300])
    forward, _ = kernels.lattice(x, refl)
    assert np.allclose(forward[6:], kernels.residual(x, a)[6:])
    assert kernels.lp_spectrum([], 4.0, 5).tolist() == [2.0] * 5
    poles = np.poly([0.98 * np.exp(1j * 2 * np.pi * 1000 / 16000), 0.98 * np.exp(-1j * 2 * np.pi * 1000 / 16000)]).real
    assert abs(kernels.spectrum_formants(poles[1:], 16000)[0] - 1000) < 40
    t = np.arange(1600) / 16000
    tone = sum(np.sin(2 * np.pi * 200 * h * t) / h for h in (1, 2, 3))
    mag = np.abs(np.fft.rfft(tone * np.hanning(1600)))
    got = kernels.harmonic_differences(mag, 16000, 200.0, (600.0,))
    assert got["h1_h2"] == pytest.approx(20 * np.log10(2), abs=0.1) and got["h1_a1"] == pytest.approx(20 * np.log10(3), abs=0.1)
    assert kernels.acf_hnr(tone, 80)[0] > 10 > kernels.acf_hnr(rng.normal(size=1600), 80)[0]
    assert kernels.harmonic_differences(mag, 16000, 0.0, (600.0,)) == {"h1_h2": 0.0, "h1_a1": 0.0}


def test_pitch_follows_the_cepstrum_peak():
    t = np.arange(1600) / 16000
    for f in (110.0, 200.0, 310.0):
        pulses = sum(np.cos(2 * np.pi * f * h * t) for h in range(1, 20))
        f0, voicing, hnr = kernels.pitch_acf(pulses, 16000)
        assert abs(f0 - f) < 4 and voicing > 0.8 and hnr > 3
    assert kernels.pitch_acf(np.random.default_rng(0).normal(size=1600), 16000)[0] == 0 == kernels.pitch_acf(np.zeros(1600), 16000)[0]


def test_jitter_reads_the_pitch_level(spark):
    rate, n = 8000, 4000
    signal = spark.createDataFrame([("a", i, math.sin(2 * math.pi * 100 * i / rate)) for i in range(n)], "k string, vidx long, x double")
    pitch = spark.createDataFrame([("a", i, 100.0 if 5 <= i < 30 else 0.0) for i in range(45)], "k string, vidx long, f0 double")
    rows = {r["vidx"]: r for r in kernels.jitter_of(signal, pitch, ["k"], "x", rate).collect()}
    assert len(rows) == 45 and rows[0]["jitterlocal"] == 0 and rows[0]["loghnr"] == 0
    assert rows[10]["jitterlocal"] < 0.01 and rows[10]["loghnr"] > 20 and rows[40]["loghnr"] == rows[29]["loghnr"]


def test_net_vad_and_nets(spark):
    voice, energy = [0.9] * 5 + [0.1] * 5 + [0.9] * 5, [1, 9, 9, 9, 1, 9, 9, 9, 9, 9, 9, 1, 9, 9, 9]
    assert kernels.net_vad(voice, energy, hold=50).tolist() == [1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 1, 0, 1, 1, 1]
    rng = np.random.default_rng(4)
    layer = lambda: {"wx": rng.normal(size=(8, 3)), "wh": rng.normal(size=(8, 2)), "b": rng.normal(size=8), "p": rng.normal(size=(3, 2))}
    one, two, x = layer(), layer(), rng.normal(size=(6, 3))
    sig = lambda v: 1 / (1 + math.exp(-v))
    h, c = [0.0, 0.0], [0.0, 0.0]
    for row, got in zip(x, kernels.lstm(x, one)):
        z = [sum(one["wx"][g][k] * row[k] for k in range(3)) + sum(one["wh"][g][k] * h[k] for k in range(2)) + one["b"][g] for g in range(8)]
        nh, nc = [], []
        for k in range(2):
            i, f = sig(z[k] + one["p"][0][k] * c[k]), sig(z[2 + k] + one["p"][1][k] * c[k])
            nc.append(f * c[k] + i * math.tanh(z[4 + k]))
            nh.append(sig(z[6 + k] + one["p"][2][k] * nc[k]) * math.tanh(nc[k]))
        h, c = nh, nc
        assert np.allclose(got, h)
    both = kernels.bidirectional(x, one, two)
    assert both.shape == (6, 4) and np.allclose(both[:, 2:], kernels.lstm(x[::-1], two)[::-1])
    net = models.parse_net(json.dumps({"a": {k: v.tolist() for k, v in one.items()}}))["a"]
    df = spark.createDataFrame([("s", i, r.tolist()) for i, r in enumerate(x)], "k string, i int, v array<double>")
    out = models.recurrent(df, ["k"], ["i"], "v", net, backward=two, output=(np.ones((3, 4)), [0.0, 1.0, 0.0]))
    rows = out.withColumn("l", models.labelled(F.col("activation"), ["a", "b", "c"])).collect()
    assert all(abs(sum(r["activation"]) - 1) < 1e-9 and r["l"] == "b" for r in rows)


def test_kernel_svms(spark):
    rng = np.random.default_rng(6)
    text = "svm_type c_svc\nkernel_type polynomial\ndegree 2\ngamma 0.5\ncoef0 1\nnr_class 3\ntotal_sv 3\nrho 0.1 -0.2 0.3\nlabel 5 7 9\nnr_sv 1 1 1\nSV\n0.5 0.25 1:1 2:-1\n-1 0.75 1:0.5\n0.3 0.2 2:2\n"
    m = models.parse_libsvm(text, 2)
    x = rng.normal(size=(50, 2))
    k = (0.5 * x @ m["vectors"].T + 1) ** 2
    d = np.stack([k[:, 0] * 0.5 + k[:, 1] * -1 - 0.1, k[:, 0] * 0.25 + k[:, 2] * 0.3 + 0.2, k[:, 1] * 0.75 + k[:, 2] * 0.2 - 0.3], 1)
    assert np.allclose(models.svm_decisions(m, x), d)
    want = []
    for a, b, c in d:
        votes = [int(a > 0) + int(b > 0), int(a <= 0) + int(c > 0), int(b <= 0) + int(c <= 0)]
        want.append([5.0, 7.0, 9.0][int(np.argmax(votes))])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, None)], "i int, v array<double>")
    got = {r["i"]: r["c"] for r in df.select("i", models.kernel_svm(F.col("v"), m).alias("c")).collect()}
    assert [got[i] for i in range(50)] == want and got[99] is None
    line = "svm_type epsilon_svr\nkernel_type linear\nnr_class 2\ntotal_sv 1\nrho -1\nSV\n2 1:1 2:3\n"
    assert np.allclose(models.svm_decisions(models.parse_libsvm(line, 2), x)[:, 0], 2 * (x @ [1, 3]) + 1)
    low, high, ranges = models.parse_scale("x\n-1 1\n1 0 10\n2 -5 5\n")
    assert (low, high) == (-1, 1) and ranges[2] == (-5, 5)


def test_coupling_of_three_classes(spark):
    """Pairs that agree with given probabilities give these."""
    p = {"a": 0.5, "b": 0.3, "c": 0.2}
    pairs = [(i, j, [0.0], 0.0, math.log(p[j] / p[i]), 1.0) for i, j in (("a", "b"), ("a", "c"), ("b", "c"))]
    df = spark.createDataFrame([([1.0],)], "v array<double>")
    got = df.select(*[c.alias(k) for k, c in models.coupled(F.col("v"), pairs, 60).items()]).first()
    assert all(got[k] == pytest.approx(p[k], abs=1e-6) for k in p)


def test_waves_of_all_widths(spark, tmp_path):
    x = np.stack([np.sin(np.arange(300) / 5), np.cos(np.arange(300) / 9)])
    for bits, near in ((8, 0.01), (16, 1e-4), (24, 1e-6), (32, 1e-8), (-32, 1e-6)):
        raw = files.encode_wave(x, 8000, bits)
        rate, back = files.decode_wave(raw, mono=False)
        assert rate == 8000 and back.shape == (2, 300) and np.allclose(back, x, atol=near)
        assert np.allclose(files.decode_wave(raw)[1], x.mean(0), atol=near)
    (tmp_path / "s.wav").write_bytes(files.encode_wave(x, 8000))
    both = files.read_waves(spark, str(tmp_path / "s.wav"), mono=False, start_samples=10, stop_samples=20).first()["pcm"]
    assert np.allclose(both, x[:, 10:20], atol=1e-4)
    tail = files.read_waves(spark, str(tmp_path / "s.wav"), start=0.0, stop=0.01, end_relative=True).first()["pcm"]
    assert len(tail) == 300 - 80
    (tmp_path / "r.raw").write_bytes((x[0] * 32767).astype("<i2").tobytes())
    raw = files.read_waves(spark, str(tmp_path / "r.raw"), raw={"rate": 100}).first()
    assert raw["rate"] == 100 and np.allclose(raw["pcm"], x[0], atol=1e-4)
    pushed = spark.createDataFrame([(bytearray((x[0] * 32767).astype("<i2").tobytes()),), (None,)], "data binary")
    rows = files.decoded_audio(pushed, "data").collect()
    assert np.allclose(rows[0]["pcm"], x[0], atol=1e-4) and rows[1]["pcm"] is None


def test_a_wave_for_each_turn(spark):
    x = np.arange(1000) / 2000
    df = level(spark, x)
    turns = spark.createDataFrame([("a", 0, 100, 199), ("a", 1, 950, 990)], "k string, segment long, start long, stop long")
    rows = sorted(files.cut_waves(df, turns, ["k"], "x", 100, pre=0.1, post=0.3).collect(), key=lambda r: r["segment"])
    assert [r["segment"] for r in rows] == [1, 2] and rows[0]["start_sec"] == 0.9 and rows[0]["stop_sec"] == 2.3
    assert np.allclose(files.decode_wave(bytes(rows[0]["data"]))[1], x[90:230], atol=1e-4)
    assert np.allclose(files.decode_wave(bytes(rows[1]["data"]))[1], x[940:], atol=1e-4)


def test_csv_and_arff_options(spark, tmp_path):
    (tmp_path / "h.csv").write_text("frameTime;a;name\n0.0;1.5;x\n0.1;2.5;y\n0.2;3.5;z\n")
    (tmp_path / "n.csv").write_text("1;2\n3;4\n")
    got = files.read_csv(spark, f"{tmp_path}/h.csv", header="auto", start=1, stop=2, frame_time=True)
    assert sorted(map(tuple, got.select("vidx", "time", "a").collect())) == [(1, 0.1, 2.5), (2, 0.2, 3.5)]
    assert files.read_csv(spark, f"{tmp_path}/n.csv", header="auto").count() == 2
    df = spark.createDataFrame([(0, 0.5, 2.0, "it's \\ b", "hi"), (1, 1.5, None, "b", None)], "vidx long, time double, x double, name string, mood string")
    assert files.csv_ready(df, "name", frame_length=0.025, exact=True).columns[:4] == ["name", "frameIndex", "frameTime", "frameLength"]
    spelt = files.csv_ready(df.select("vidx", "x"), exact=True).orderBy("frameIndex").first()["x"]
    assert spelt == "2"
    for _ in range(2):
        files.write_csv(df.select("vidx", "x"), f"{tmp_path}/c", append=True)
    assert files.read_csv(spark, f"{tmp_path}/c").count() == 4
    files.write_arff(df, f"{tmp_path}/a", classes={"mood": ["hi", "low"], "score": "numeric"})
    files.write_arff(df, f"{tmp_path}/a", classes={"mood": ["hi", "low"], "score": "numeric"}, append=True)
    got = files.read_arff(spark, f"{tmp_path}/a", instance="name", targets=("mood",))
    assert got.columns == ["name", "mood", "vidx", "time", "x", "score"] and got.count() == 4
    assert {(r["name"], r["mood"]) for r in got.collect()} == {("it's \\ b", "hi"), ("b", None)}
    with pytest.raises(ValueError):
        files.write_nonempty(df.limit(0), lambda d: None)
    line = files.libsvm_lines(spark.createDataFrame([("b", 0.5, [1.0])], "c string, t double, v array<double>"), "c", "v", "t", {"a": 0, "b": 1}).first()
    assert line["value"] == "1 1:0.5 2:1.0"
    assert files.text_dump(level(spark, [2.5]), ["k"]).first()["value"] == "k=a vidx=0 x=2.5"
    assert files.printed(spark.createDataFrame([("a", 1.0)], "k string, m double"), ["k"], "run").first()["value"] == "run::a::m::VALUE=1.0"


def test_many_arff_attributes(spark, tmp_path):
    names = [f"f{i}" for i in range(300)]
    (tmp_path / "w.arff").write_text("@relation r\n" + "".join(f"@attribute {n} numeric\n" for n in names) + "@data\n" + ",".join(map(str, range(300))) + "\n")
    got = files.read_arff(spark, f"{tmp_path}/w.arff")
    assert got.columns == names and list(got.first()) == [float(i) for i in range(300)]


def test_plugins_and_pictures(spark):
    assert plugins.random_rows(spark, 10, 3).columns == ["vidx", "x0", "x1", "x2"]
    red = [[[255, 0, 0]] * 4] * 4
    df = spark.createDataFrame([(red,), (None,), ([],)], "p array<array<array<int>>>")
    a, b, c = (r["h"] for r in df.select(plugins.picture_histograms(F.col("p")).alias("h")).collect())
    assert a["hue"][0] == 1 and a["saturation"][-1] == 1 and a["value"][-1] == 1 and a["lbp"][255] == 1
    assert b["hue"] is None and c["hue"] is None


def test_registry_and_small_helpers(spark):
    fn.register("spread", lambda: {"spread": F.max("x") - F.min("x")})
    assert fn.functionals(level(spark, [1, 5, 3]), ["k"], ["vidx"], "x", ["spread"]).first()["x_spread"] == 4
    got = fn.functionals(level(spark, [3] * 5), ["k"], ["vidx"], "x", {"moments": {"ratio_limited": True}}).first()
    assert got["x_stddevnorm"] == 0 and got["x_kurtosis"] == 0
    at, top = spark.range(1).select(*[c.alias(n) for n, c in zip("ab", scales.parabola_vertex(F.lit(1.0), F.lit(3.0), F.lit(2.0)))]).first()
    assert at == pytest.approx(1 / 6) and top == pytest.approx(3 + 1 / 24)
    assert scales.round_pow2(100) == 128 and scales.round_pow2(100, "down") == 64 and scales.round_pow2(65, "up") == 128
    noisy = spark.createDataFrame([([0.0] * 2000,)], "v array<double>").select(vectors.operation("agn", F.col("v"), 2.0, 0.5).alias("y")).first()["y"]
    assert abs(np.mean(noisy) - 2) < 0.1 and abs(np.std(noisy) - 0.5) < 0.1


def test_live_control_sinks_and_turns(spark, tmp_path):
    e = spark.createDataFrame([("a", i, float(v), i == 7) for i, v in enumerate([0, 9, 9, 9, 0, 9, 9, 9])] + [("b", i, 9.0, False) for i in range(9)], "k string, vidx long, x double, last boolean")
    e.coalesce(1).sortWithinPartitions("k", "vidx").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    got = []
    q = live.to_sink(live.live_turns(stream, "k", "vidx", "x", 5.0, pre=1, post=0, longest=4, timeout="10 minutes", end="last"), lambda df, n: got.extend(df.collect()), "turns_to_sink", f"{tmp_path}/c1", mode="append")
    assert live.run_until(q, 120, rows=17) == 17
    # The end mark closes the open turn of a; b has no end, and turns of four rows at most.
    assert sorted(map(tuple, got)) == [("a", 0, 1, 3), ("a", 1, 5, 7), ("b", 0, 0, 3), ("b", 1, 4, 7)]
    out = tmp_path / "sent"
    out.mkdir()

    def send(texts):
        if texts:
            import uuid

            (out / uuid.uuid4().hex).write_text("\n".join(texts))

    q = live.forwarded(stream.select("k", "x"), send, "forwarded", f"{tmp_path}/c2")
    live.run_until(q, 120)
    assert sum(len(f.read_text().splitlines()) for f in out.iterdir()) == 17
    late = live.bounded(stream.withColumn("t", F.timestamp_seconds("vidx")), "t", "1 minute")
    assert late.isStreaming and "EventTimeWatermark" in late._jdf.queryExecution().analyzed().toString()
    q = live.live_mvn(stream, "k", "vidx", "x").writeStream.format("memory").queryName("live_mvn").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = [0.0] + [(v - np.mean(w)) / max(np.std(w), 1e-7) for w, v in (([0, 9, 9, 9, 0, 9, 9, 9][: i + 1], [0, 9, 9, 9, 0, 9, 9, 9][i]) for i in range(1, 8))]
    assert np.allclose([r["x_mvn"] for r in spark.table("live_mvn").where("k = 'a'").orderBy("vidx").collect()], want)


def test_live_sessions(spark, tmp_path):
    rows = spark.sql("select 'a' k, timestamp '2024-01-01 00:00:00' t, 1.0D x union all select 'a', timestamp '2024-01-01 00:20:00', 3.0D union all select 'a', timestamp '2024-01-01 05:00:00', 5.0D union all select 'a', timestamp '2024-01-02 00:00:00', 0.0D")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = live.live_sessions(stream, "t", "k", "x").writeStream.format("memory").queryName("live_sessions").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["n"], r["amean"]) for r in spark.table("live_sessions").collect()) == [(1, 0.0), (1, 5.0), (2, 2.0)]

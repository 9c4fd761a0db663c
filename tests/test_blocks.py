"""Long series in blocks: the same rows as one task a series gives."""

import math
from functools import reduce
from operator import add

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelathe.functions import spectral
from wavelathe.operators import blocks, contours, kernels, segments, windows
from wavelathe.operators.blocks import Blocks
from wavelathe.series import Series, of_level

KEYS = ("k",)
B = Blocks(KEYS, 8)


def contour(seed, n, levels=None):
    rng = np.random.default_rng(seed)
    x = np.cumsum(rng.normal(0, 1, n))
    return x if levels is None else np.round(rng.integers(0, levels, n).astype(float), 1)


@pytest.fixture(scope="module")
def data():
    """Series of many lengths: shorter than a block, one row, and many blocks."""
    return {0: contour(1, 61), 1: contour(2, 1), 2: contour(3, 5), 3: np.full(20, 2.0), 4: contour(4, 203, 3), 5: contour(5, 16), 6: np.zeros(9)}


@pytest.fixture(scope="module")
def level(spark, data):
    return spark.createDataFrame([(k, i, float(v)) for k, x in data.items() for i, v in enumerate(x)], "k int, vidx long, x double").repartition(5).cache()


def rows(df, *cols):
    out = sorted(tuple(r) for r in df.select(*cols).collect())
    return [tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in out]


def test_numbers_without_one_task_a_series(spark, level):
    mixed = level.select("k", (F.col("vidx") * 3 + 7).alias("t"), "x")
    s = Series(KEYS, ("t",))
    for ranges in (1, 7):
        got = blocks.numbered(mixed, s, {"x": "x"}, F.col("t").cast("double"), ranges)
        assert got.columns == ["k", "vidx", "time", "x"]
        assert rows(got, *got.columns) == rows(s.level(mixed, {"x": "x"}, F.col("t").cast("double")), *got.columns)


def test_row_frames(level):
    s = of_level("k")
    make = {
        "sma": lambda s: windows.sma(s, "x", 5), "delta": lambda s: windows.delta(s, "x", 3), "med": lambda s: windows.running_median(s, "x", 5),
        "pre": lambda s: windows.preemphasis(s, "x"), "buf": lambda s: windows.mvn(s, "x", "buffer", 12),
    }
    got = B.windowed(level, make, 12, 3)
    want = level.select("*", *[f(s).alias(n) for n, f in make.items()])
    assert rows(got, *want.columns) == rows(want, *want.columns)


@pytest.mark.parametrize(("size", "step"), [(4, 2), (20, 7), (3, 9)])
def test_frames(level, size, step):
    got = {(r["k"], r["segment"]): r["frame"] for r in B.frames(level, "x", size, step).collect()}
    want = {(r["k"], r["segment"]): r["frame"] for r in segments.frames(level, of_level("k"), "x", size, step).collect()}
    assert got == want


def test_aggregates_so_far_and_renumbering(level, data):
    got = B.running_mvn(level, "x")
    want = level.withColumn("x_mvn", windows.mvn(of_level("k"), "x", "running"))
    assert [r[:2] + (round(r[2], 5),) for r in rows(got, "k", "vidx", "x_mvn")] == [r[:2] + (round(r[2], 5),) for r in rows(want, "k", "vidx", "x_mvn")]
    some = B.renumbered(level.where("x > 0"))
    want = [(k, i, round(float(v), 8)) for k, x in data.items() for i, v in enumerate(x[x > 0])]
    assert rows(some, "k", "vidx", "x") == sorted(want)
    held = B.held(level, "last", F.when(F.col("vidx") % 13 == 5, F.col("x")))
    assert rows(held.na.fill(-99.0), "k", "vidx", "last") == sorted((k, i, round(float(x[(i - 5) // 13 * 13 + 5]) if i >= 5 else -99.0, 8)) for k, x in data.items() for i in range(len(x)))


def test_decays(level, data):
    got = {(r["k"], r["vidx"]): r["decayed"][0] for r in blocks.decayed(level, B, ["x"], 0.9, 0.5).collect()}
    for k, x in data.items():
        y = 0.0
        for i, v in enumerate(x):
            y = 0.9 * y + 0.5 * v
            assert math.isclose(got[k, i], y, rel_tol=1e-9, abs_tol=1e-12)
    got = {(r["k"], r["vidx"]): r["x_mvn"] for r in blocks.exponential_mvn(level, B, "x", 0.95).collect()}
    for k, x in data.items():
        m, q = x[0], x[0] ** 2
        for i, v in enumerate(x):
            m, q = 0.95 * m + 0.05 * v, 0.95 * q + 0.05 * v * v
            assert math.isclose(got[k, i], (v - m) / max(math.sqrt(max(q - m * m, 0)), 1e-7), rel_tol=1e-5, abs_tol=1e-5)


def test_rasta(level, data):
    df = level.select("k", "vidx", F.array("x", F.col("x") * 2).alias("bands"))
    got = {(r["k"], r["vidx"]): r["rasta"] for r in blocks.rasta(df, B, "bands").collect()}
    for k, x in data.items():
        want = kernels.rasta(np.stack([x, 2 * x], 1))
        assert np.allclose([got[k, i] for i in range(len(x))], want)
    assert all(r["rasta"] == [0.0, 0.0] for r in blocks.rasta(df, B, "bands", quiet=4).where("vidx < 4").collect())
    taps, pole = blocks.rasta_filter(0.01)
    assert abs(sum(taps)) < 1e-12 and 0.9 < pole < 1 and taps[0] == -taps[4]


@pytest.mark.parametrize(("pre", "post", "off"), [(0, 0, None), (1, 2, 0.5), (3, 1, 0.0)])
def test_turns(level, pre, post, off):
    got = blocks.turns(level, B, "x", 1.0, off, pre, post)
    want = windows.turns_between(level, of_level("k"), "x", 1.0, off, pre, post)
    assert rows(got, "k", "segment", "start", "stop") == rows(want, "k", "segment", "start", "stop")


@pytest.mark.parametrize("accuracy", [20, 100, 10000])
def test_percentiles(spark, level, accuracy, data):
    at = [0.0, 0.05, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {r["k"]: r for r in blocks.ranked_values(level, ["k"], "x", at, accuracy).collect()}
    near = {r["k"]: r["values"] for r in blocks.percentiles(level, ["k"], "x", at, False).collect()}
    want = {r["k"]: r["p"] for r in level.groupBy("k").agg(F.percentile("x", F.array(*map(F.lit, at))).alias("p")).collect()}
    for k in want:
        mine = [v["lo"] * (1 - v["weight"]) + v["hi"] * v["weight"] for v in got[k]["values"]]
        assert np.allclose(mine, want[k], rtol=1e-12, atol=1e-12), k
        x = np.sort(data[k])
        assert near[k] == [x[int(p * (len(x) - 1) + 0.5)] for p in at]
    assert blocks.percentiles(level.limit(0), ["k"], "x", at).count() == 0


def test_percentiles_when_a_sketch_misses(level, monkeypatch):
    """Bounds that enclose no place are found out, and ranks taken anew."""
    real = F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda c, p, a: F.transform(real(c, p, a), lambda _: F.lit(1e9)))
    got = {r["k"]: r["values"][0] for r in blocks.percentiles(level, ["k"], "x", [0.5]).collect()}
    want = {r["k"]: r["p"] for r in level.groupBy("k").agg(F.percentile("x", 0.5).alias("p")).collect()}
    assert got == pytest.approx(want)


# -- Contours, against the rules row by row --------------------------------


def borders_by_hand(x, kind, share, thresholds, most, least, average):
    n, m = len(x), least if least is not None else max(len(x) // most - 1, 2)
    lo, hi, mu = x.min(), x.max(), x.mean()
    width = average or n // (most // 2)
    last, out, was = -(m // 2), [], None
    for i in range(n):
        if kind in ("delta", "delt2"):
            if not width:
                continue
            over = x[i] - x[max(0, i + 1 - width) : i + 1].mean()
            hit = over > share * (hi - lo) and (kind == "delta" or (was is not None and was <= share * (hi - lo)))
            was = over
        else:
            now = x[i] if kind.startswith("na") else x[max(0, i - 2) : i + 1].mean()
            at = [{"relth": lo + (hi - lo) * t, "mrelth": mu * t, "absth": t}[kind.removeprefix("na")] for t in thresholds]
            hit = was is not None and any((now > t >= was) or (now < t <= was) for t in at)
            was = now
        if hit and i - last > m:
            out.append(i - last)
            last = i
    return out


def summary(lengths, most, grow=False):
    d = np.array(lengths if grow else lengths[:most], float)
    return (float(len(d)), d.mean(), d.max(), d.min(), d.std()) if len(d) else (0.0,) * 5


NAMES = ["x_numsegments", "x_meanseglen", "x_maxseglen", "x_minseglen", "x_seglenstddev"]


@pytest.mark.parametrize("far", [False, True])
@pytest.mark.parametrize(("kind", "how"), [
    ("delta", {}), ("delta", {"least": 1, "average": 4, "share": 0.1}), ("delt2", {"least": 3, "share": 0.05}), ("relth", {"thresholds": (0.3, 0.6)}),
    ("mrelth", {"thresholds": (1.0,), "least": 0}), ("absth", {"thresholds": (1.0,), "most": 4}), ("narelth", {}), ("namrelth", {"thresholds": (0.9,)}), ("naabsth", {"thresholds": (0.5, 1.5), "least": 2}),
])
def test_segments_between_borders(level, data, monkeypatch, kind, how, far):
    monkeypatch.setattr(contours, "SPREAD", -1 if far else 1024)
    b = Blocks(KEYS, 32)
    got = {r["k"]: tuple(r[n] for n in NAMES) for r in contours.segments(level, b, "x", kind, norm="frame", **how).collect()}
    for k, x in data.items():
        full = {"share": 0.2, "thresholds": (0.5,), "most": 20, "least": None, "average": None} | how
        assert got[k] == pytest.approx(summary(borders_by_hand(x, kind, **full), full["most"]), abs=1e-9), k


def regions_by_hand(hit, kind, least, pause):
    """Phases 0 out, 1 a beginning, 2 in, 3 (chx) a beginning of the other."""
    out, phase, run, gap, a, b = [], 0, 0, 0, 0, 0
    for i, h in enumerate(hit):
        if h:
            if phase == 1:
                gap, run = 0, run + 1
                if run >= least:
                    phase, run = 2, 0
                    if kind == "chx":
                        out.append(a - 1 - b)
            elif phase == 0:
                phase, run, gap, a = 1, run + 1, 0, i
            elif phase == 2:
                gap = 0
            elif phase == 3:
                run += 1
                if run >= least:
                    phase, run, gap = 2, 0, 0
        elif kind == "chx" and phase == 3:
            run, gap = 0, gap + 1
            if gap >= least:
                out.append(b - 1 - a)
                phase, gap = 0, 0
        elif kind == "chx" and phase == 2:
            phase, gap, b, run = 3, gap + 1, i, 0
        elif phase in (1, 2):
            gap += 1
            if gap >= pause:
                if phase == 2:
                    out.append(i - gap - a)
                phase, run, gap = 0, 0, 0
    n = len(hit)
    if phase == 2:
        out.append(n - 1 - a if kind == "chx" else n - 1 - gap - a)
    elif phase == 0 and kind == "chx":
        out.append(n - 1 - b)
    return [v for v in out if v >= 0]


@pytest.mark.parametrize(("least", "pause"), [(3, 2), (1, 1), (2, 4), (4, 3)])
@pytest.mark.parametrize("kind", ["eqx", "nonx", "chx", "gtx", "leqx"])
def test_segments_of_regions(level, data, kind, least, pause):
    got = {r["k"]: tuple(r[n] for n in NAMES) for r in contours.segments(level, B, "x", kind, value=1.0, least=least, pause=pause, grow=True, norm="frame").collect()}
    test = {"eqx": lambda v: v == 1, "nonx": lambda v: v != 1, "chx": lambda v: v != 1, "gtx": lambda v: v > 1, "leqx": lambda v: v <= 1}[kind]
    for k, x in data.items():
        assert got[k] == pytest.approx(summary(regions_by_hand(test(x), kind, least, pause), 0, True), abs=1e-9), (k, kind)


def test_norms_of_segments(level, data):
    frame, share, second = ({r["k"]: r for r in contours.segments(level, B, "x", "nonx", value=1.0, norm=n, period=0.5).collect()} for n in ("frame", "segment", "second"))
    for k, x in data.items():
        assert share[k]["x_numsegments"] == pytest.approx(frame[k]["x_numsegments"] / 20) and share[k]["x_meanseglen"] == pytest.approx(frame[k]["x_meanseglen"] / len(x))
        assert second[k]["x_numsegments"] == pytest.approx(frame[k]["x_numsegments"] / len(x) / 0.5) and second[k]["x_maxseglen"] == pytest.approx(frame[k]["x_maxseglen"] * 0.5)


def peaks_by_hand(x, rise, fall):
    span, low, peak, spot, out = np.ptp(x), 0.0, None, -1, []
    for i in range(len(x)):
        if i > 1 and x[i - 2] < x[i - 1] > x[i]:
            if peak is None and x[i - 1] - low > rise * span:
                peak, spot = x[i - 1], i - 1
            elif peak is not None and x[i - 1] > peak:
                peak, spot = x[i - 1], i - 1
        elif i > 1 and x[i - 2] > x[i - 1] < x[i]:
            low = x[i - 1]
        if peak is not None and (x[i] < peak - fall * span or i == len(x) - 1):
            out.append((spot, round(float(peak), 8)))
            peak = None
    return out


@pytest.mark.parametrize(("rows_", "rise", "fall"), [(4, 0.11, 0.09), (8, 0.02, 0.3), (8, 0.3, 0.01), (500, 0.11, 0.09), (3, 0.0, 0.0)])
def test_peaks(level, data, rows_, rise, fall):
    b = Blocks(KEYS, rows_)
    want = sorted((k, *p) for k, x in data.items() for p in peaks_by_hand(x, rise, fall))
    assert rows(contours.peaks_marked(level, b, "x", rise, fall), "k", "vidx", "height") == want
    got = {r["k"]: r for r in contours.peaks(level, b, "x", rise, fall).collect()}
    for k, x in data.items():
        p = peaks_by_hand(x, rise, fall)
        d = np.diff([s for s, _ in p])
        assert got[k]["x_numpeaks"] == len(p) and got[k]["x_meanpeakdist"] == pytest.approx(d.mean() if len(d) else len(x) + 1)
        assert got[k]["x_peakmeanmeandist"] == pytest.approx((np.mean([h for _, h in p]) if p else 0) - x.mean())


@pytest.mark.parametrize(("rows_", "need"), [(3, 0.1), (8, 0.02), (8, 0.4), (500, 0.1)])
def test_alternating_extrema(level, data, rows_, need):
    got = rows(contours.extrema_marked(level, Blocks(KEYS, rows_), "x", need), "k", "vidx", "kind", "height")
    want = []
    for k, x in data.items():
        tops, bottoms = kernels.extrema(x, need)
        want += [(k, i, 1, round(float(x[i]), 8)) for i in tops] + [(k, i, -1, round(float(x[i]), 8)) for i in bottoms]
    assert got == sorted(want)
    names = list(kernels.peaks2(data[0]))
    stats = {r["k"]: [r[f"x_{n}"] for n in names] for r in contours.peaks2(level, Blocks(KEYS, rows_), "x", need).collect()}
    for k, x in data.items():
        assert stats[k] == pytest.approx([kernels.peaks2(x, need)[n] for n in names], abs=1e-9), k


@pytest.mark.parametrize("off", [0.2, 1.0])
def test_onsets(level, data, off):
    got = {r["k"]: r for r in contours.onsets(level, B, "x", 1.0, off).collect()}
    for k, x in data.items():
        want = kernels.onsets(x, 1.0, off)
        assert {n: got[k][f"x_{n}"] for n in want} == pytest.approx(want)


def test_linear_prediction_and_modulation(level, data):
    lp = {r["k"]: r for r in contours.linear_prediction(level, B, "x", 4).collect()}
    how = {"period": 0.1, "size": 2.0, "step": 0.7, "resolution": 0.4, "low": 0.3, "high": 4.0}
    mod = {r["k"]: r for r in contours.modulation(level, B, "x", **how).collect()}
    for k, x in data.items():
        a, gain, _ = kernels.lpc(x, 4)
        assert [lp[k]["x_lpgain"], *(lp[k][f"x_lpc{i}"] for i in range(4))] == pytest.approx([gain / len(x), *a], abs=1e-6)
        want = kernels.modulation(x, **how)
        assert [mod[k][f"x_mod{i}"] for i in range(len(want))] == pytest.approx(want.tolist(), abs=1e-6)


def test_spline_matrix():
    rng = np.random.default_rng(2)
    for n in (3, 5, 40):
        x, y = np.sort(rng.uniform(0, 9, n)), rng.normal(size=n)
        at = np.concatenate([rng.uniform(x[0] - 1, x[-1] + 1, 50), x])
        assert np.allclose(spectral.spline_matrix(x, at) @ y, kernels.spline(x, y, at))


def test_empty_levels(level):
    none = level.limit(0)
    for df in (B.renumbered(none), B.running_mvn(none, "x"), blocks.turns(none, B, "x", 1.0), contours.peaks(none, B, "x"), contours.segments(none, B, "x"), contours.onsets(none, B, "x"), blocks.exponential_mvn(none, B, "x")):
        assert df.count() == 0


def test_segments_at_ties_of_the_average(spark):
    """Rows exactly as far over their average as the threshold go by plain sums; a series too short for an average has no segment, and null rows don't count."""
    x = [3.6, 0.4, 1.1, 1.8, 3.7, 2.2, 2.3, 2.3, 2.6, 0.2, 2.6, 3.1]
    hits = [i for i in range(12) if x[i] - reduce(add, x[max(0, i - 2) : i + 1]) / min(i + 1, 3) > 0.2 * (max(x) - min(x))]
    assert 3 in hits
    spans = np.diff([0, *hits])
    three = [(0, i, v) for i, v in enumerate(x)]
    short = [(1, i, float(i == 4)) for i in range(9)]
    gaps = [(2, i, None if i == 2 else float(10 * (i == 3))) for i in range(12)]  # 10 over 5, the mean of the two rows that hold a number
    df = spark.createDataFrame([*three, *short, *gaps], "k int, vidx long, x double")
    got = {r["k"]: r for r in contours.segments(df, B, "x", "delta", average=3, least=0, norm="frame").collect()}
    assert got[0]["x_numsegments"] == len(hits) and got[0]["x_meanseglen"] == pytest.approx(spans[spans > 0].sum() / len(hits))
    assert got[2]["x_numsegments"] == 1
    own = contours.segments(df.where("k = 1"), B, "x", "delta", least=0, norm="frame").first()
    assert own["x_numsegments"] == 0


def _dealt_to(df):
    """Tasks that have rows, where no join is a broadcast that the small size alone brings about."""
    spark, name = df.sparkSession, "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        return df.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set(name, was)


def test_aggregates_beside_rows_are_dealt_by_block(spark):
    one = spark.range(800).select(F.floor(F.col("id") / 1000).alias("k"), F.col("id").alias("vidx"), F.col("id").cast("double").alias("x"))
    got = B.shared(one, n=F.count("x"), top=F.max("x"))
    assert got.columns == ["k", "vidx", "x", "n", "top"] and got.where("n = 800 and top = 799").count() == 800
    assert _dealt_to(got) > 4


def test_few_bytes_are_dealt_to_all_tasks(spark):
    """Rows of which little is left behind compression are no one task's."""
    df = spark.range(8000).select((F.col("id") % 50).alias("k"), F.floor(F.col("id") / 50).alias("vidx"), F.lit(1.0).alias("x"))
    for got in (B.held(df, "last", F.col("x")), B.summed(df, "sum", F.col("x")), B.renumbered(df), B.windowed(df, {"was": lambda s: F.lag("x").over(s.ordered())}, 1, 0)):
        assert _dealt_to(got) > 4
        assert got.count() == 8000


def test_frames_are_cut_from_blocks(level):
    """A frame is made once, not a list for each row of the series."""
    plan = B.frames(level, "x", 4, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("collect_list(") == 1
    assert {len(r["frame"]) for r in B.frames(level, "x", 20, 7).collect()} == {20}


def test_listed_rows_stay_where_they_are(spark):
    """All series share the few buckets of a short list: rows are not dealt by them."""
    df = spark.range(0, 4000, 1, 8).select((F.col("id") % 100).alias("k"), F.floor(F.col("id") / 100).alias("vidx"), F.lit(1.0).alias("x"))
    spans = spark.createDataFrame([(0, 3, 9), (2, 20, 30)], "segment int, start long, stop long")
    got = segments.listed_in(df, spans)
    assert got.count() == 100 * 18
    assert _dealt_to(got) > 4

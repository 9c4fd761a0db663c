"""Functionals that follow a contour from row to row: segments, peaks, onsets, linear prediction, modulation.

Each is a machine along the series (see `blocks`), so a long series is cut into
blocks; what the machine marks are rows, and the statistics are aggregates of
those. Series without a mark get a row too. A level that is read by several
steps, and what a machine has marked, are written to the shared folder, so that
neither is made twice.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from ..functions.vectors import durbin, let
from ..storage import written
from .blocks import Blocks, machine, scanned, spaced_rows

SPREAD = 1024  # least distances up to this are a state of the machine


def _lag(name: str, by: int = 1):
    return lambda s: F.lag(name, by).over(s.ordered())


def _lengths(b: Blocks, marks: DataFrame, start: Column) -> DataFrame:
    """Marks (keys, vidx) counted anew as vidx, with their distance to the one before; that of the first is to `start`."""
    rows = b.renumbered(marks.withColumn("_spot", F.col("vidx")))
    rows = b.windowed(rows, {"_prev": _lag("_spot")}, 1, 0)
    return rows.withColumn("length", F.col("_spot") - F.coalesce("_prev", start))


def _next_far(hits: DataFrame, b: Blocks, most: int | None) -> DataFrame:
    """Of hits (keys, vidx, _least), those chosen in order as spaced_rows does, where few can be chosen: one job each, over all series."""
    keys, out = list(b.keys), []
    hits = written(hits, "segment-hits")
    last = hits.groupBy(*keys, "_least").agg(F.lit(0).alias("_")).select(*keys, (-F.floor(F.col("_least") / 2)).cast("long").alias("_last"))
    while most is None or len(out) < most:
        got = hits.join(last, keys).where(F.col("vidx") > F.col("_last") + F.col("_least"))
        got = written(got.groupBy(*keys, "_least").agg(F.min("vidx").alias("vidx")), "segment-next")
        if got.isEmpty():
            break
        out.append(got)
        last = got.select(*keys, F.col("vidx").alias("_last"))
    return reduce(DataFrame.unionByName, out) if out else hits.limit(0)


def _trailing_mean(rows: DataFrame, b: Blocks) -> tuple[DataFrame, Column]:
    """rows (with x, its series' mean _mu and _len), and x's mean over the last _len rows; null where that is none.

    Up to a block's rows, SPREAD at most, are added up in their order, so that a
    row as far from its mean as the threshold compares as plain sums do. Longer
    means come from running sums about the series' mean.
    """
    keys = list(b.keys)
    # _len is a table's fact: the frame reaches as far as its widest mean needs.
    rows = written(rows, "segment-rows")
    widest = rows.agg(F.max("_len")).first()[0] or 0
    reach = max(min(widest, SPREAD, b.rows) - 1, 0)
    rows = b.windowed(rows, {"_near": lambda s: F.collect_list(F.struct("x")).over(s.ordered().rowsBetween(-reach, 0))}, reach, 0)
    own = F.least(F.col("_len"), F.size("_near")).cast("int")
    own = F.filter(F.transform(F.slice("_near", F.size("_near") - own + 1, own), lambda r: r["x"]), lambda v: v.isNotNull())
    total = F.aggregate("_own", F.lit(0.0), lambda a, v: a + v)
    rows = rows.withColumn("_own", own).withColumn("_mean", F.when(F.size("_own") > 0, total / F.when(F.size("_own") > 0, F.size("_own")))).drop("_near", "_own")
    if widest <= reach + 1:
        return rows, F.col("_mean")
    far = F.col("_len") > reach + 1
    held = F.col("x").isNotNull().cast("long")
    rows = written(b.summed(b.summed(rows, "_sum", F.coalesce(F.col("x") - F.col("_mu"), F.lit(0.0))), "_held", held), "segment-sums")
    old = rows.where(far).select(*keys, (F.col("vidx") + F.col("_len")).alias("vidx"), F.col("_sum").alias("_old"), F.col("_held").alias("_gone"))
    count = F.col("_held") - F.coalesce("_gone", F.lit(0))
    long_mean = (F.col("_sum") - F.coalesce("_old", F.lit(0.0))) / F.when(count > 0, count) + F.col("_mu")
    return rows.join(old, [*keys, "vidx"], "left"), F.when(far, long_mean).otherwise(F.col("_mean"))


def _borders(df: DataFrame, b: Blocks, x: str, kind: str, share: float, thresholds: tuple, most: int, least: int | None, average: int | None, grow: bool) -> DataFrame:
    """keys, length of the segments between rows where the contour goes over its running average, or through a threshold."""
    keys = list(b.keys)
    rows = b.shared(df.select(*keys, "vidx", F.col(x).cast("double").alias("x")), _n=F.count(F.lit(1)), _lo=F.min("x"), _hi=F.max("x"), _mu=F.avg("x"))
    span = F.col("_hi") - F.col("_lo")
    if kind in ("delta", "delt2"):
        rows = rows.withColumn("_len", F.lit(average).cast("long") if average else F.floor(F.col("_n") / (most // 2)).cast("long"))
        rows, mean = _trailing_mean(rows, b)
        rows = rows.withColumn("_over", F.col("x") - mean)
        hit = F.col("_over") > share * span
        if kind == "delt2":
            rows = b.windowed(rows, {"_was": _lag("_over")}, 1, 0)
            hit = hit & (F.col("_was") <= share * span)
    else:
        raw = kind.startswith("na")
        frame = lambda lo, hi: lambda s: F.avg("x").over(s.ordered().rowsBetween(lo, hi))
        rows = b.windowed(rows, {"_now": frame(0, 0) if raw else frame(-2, 0), "_was": frame(-1, -1) if raw else frame(-3, -1)}, 3, 0)
        at = {"relth": lambda t: F.col("_lo") + span * t, "mrelth": lambda t: F.col("_mu") * t, "absth": lambda t: F.lit(float(t))}[kind.removeprefix("na")]
        now, was = F.col("_now"), F.col("_was")
        crossed = [((now > at(t)) & (was <= at(t))) | ((now < at(t)) & (was >= at(t))) for t in thresholds]
        hit = F.coalesce(reduce(lambda a, c: a | c, crossed), F.lit(False))
    gap = F.lit(least).cast("long") if least is not None else F.greatest(F.floor(F.col("_n") / most) - 1, F.lit(2)).cast("long")
    rows = written(rows.select(*keys, "vidx", F.coalesce(hit, F.lit(False)).alias("_hit"), gap.alias("_least")), "segment-borders")
    widest = least if least is not None else rows.agg(F.max("_least")).first()[0] or 0
    if widest <= min(SPREAD, b.rows - 1):
        marks = spaced_rows(rows.select(*keys, "vidx", "_hit", "_least"), b, F.col("_hit"), F.col("_least"), widest)
    else:
        marks = _next_far(rows.where("_hit").select(*keys, "vidx", "_least"), b, None if grow else most)
    return _lengths(b, written(marks.select(*keys, "vidx", "_least"), "segment-marks"), (-F.floor(F.col("_least") / 2)).cast("long")).select(*keys, "vidx", "length")


def _states(symbols: int, start: tuple, follow) -> tuple[list[list[int]], list[tuple]]:
    """All states that can be reached, and the table of the next ones by symbol."""
    states, table, at = [start], [[] for _ in range(symbols)], 0
    while at < len(states):
        for k in range(symbols):
            n = follow(states[at], k)
            if n not in states:
                states.append(n)
            table[k].append(states.index(n))
        at += 1
    return table, states


OUT, MAYBE, IN, LEAVING = range(4)


def _region(least: int, pause: int):
    """Regions of hits: (phase, hits of a beginning, rows since the last hit)."""

    def follow(state, hit):
        phase, run, gap = state
        if phase == OUT:
            return (MAYBE, 1, 0) if hit else state
        if hit:
            return (IN, 0, 0) if phase == IN or run + 1 >= least else (MAYBE, run + 1, 0)
        return (OUT, 0, 0) if gap + 1 >= pause else (phase, run, gap + 1)

    return _states(2, (OUT, 0, 0), follow)


def _both_regions(least: int, pause: int):
    """Regions of hits (IN) and of misses (OUT), each left through a beginning of the other."""

    def follow(state, hit):
        phase, run, gap = state
        if phase == OUT:
            return (MAYBE, 1, 0) if hit else state
        if phase == MAYBE:
            if hit:
                return (IN, 0, 0) if run + 1 >= least else (MAYBE, run + 1, 0)
            return (OUT, 0, 0) if gap + 1 >= pause else (MAYBE, run, gap + 1)
        if phase == IN:
            return (IN, 0, 0) if hit else (LEAVING, 0, 1)
        if hit:
            return (IN, 0, 0) if run + 1 >= least else (LEAVING, run + 1, gap)
        return (OUT, 0, 0) if gap + 1 >= least else (LEAVING, 0, gap + 1)

    return _states(2, (OUT, 0, 0), follow)


def _regions(df: DataFrame, b: Blocks, x: str, kind: str, value: float, relative: bool, least: int, pause: int) -> DataFrame:
    """keys, vidx (of the row that ends it), length of regions of rows that are, or are not, the value."""
    keys = list(b.keys)
    rows = b.shared(df.select(*keys, "vidx", F.col(x).cast("double").alias("x")), _lo=F.min("x"), _hi=F.max("x"), _end=F.max("vidx"))
    at = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * value if relative else F.lit(float(value))
    v = F.col("x")
    hit = {"eqx": v == at, "nonx": v != at, "chx": v != at, "ltx": v < at, "gtx": v > at, "leqx": v <= at, "geqx": v >= at}[kind]
    table, states = (_both_regions if kind == "chx" else _region)(least, pause)
    rows = written(machine(rows.select(*keys, "vidx", "_end", hit.cast("int").alias("_hit")), b, F.col("_hit"), table), "region-states")
    part = lambda name, k: F.get(F.array(*[F.lit(s[k]) for s in states]), F.col(name).cast("int"))
    rows = rows.withColumns({"_p": part("_was", 0), "_q": part("_is", 0), "_gap": part("_is", 2)})
    turn = lambda p, q: (F.col("_p") == p) & (F.col("_q") == q)
    rows = b.held(rows, "_a", F.when(turn(OUT, MAYBE), F.col("vidx")))
    ended, end = F.col("vidx") == F.col("_end"), F.col("_end")
    if kind == "chx":
        rows = b.held(rows, "_b", F.when(turn(IN, LEAVING), F.col("vidx")))
        first = F.coalesce("_b", F.lit(0))
        closed = F.when(turn(MAYBE, IN), F.col("_a") - 1 - first).when(turn(LEAVING, OUT), F.col("_b") - 1 - F.col("_a"))
        last = F.when(ended & (F.col("_q") == IN), end - F.col("_a")).when(ended & (F.col("_q") == OUT), end - first)
        rows = rows.withColumn("length", F.explode(F.array(closed, last))).where("length >= 0")
    else:
        closed = F.when(turn(IN, OUT), F.col("vidx") - pause - F.col("_a"))
        last = F.when(ended & (F.col("_q") == IN), end - F.col("_gap") - F.col("_a"))
        rows = rows.withColumn("length", F.coalesce(closed, last)).where("length is not null")
    return rows.select(*keys, "vidx", "length")


def segments(df: DataFrame, b: Blocks, x: str, kind: str = "delta", share: float = 0.2, thresholds: tuple = (0.5,), value: float = 0.0, relative: bool = False, most: int = 20, least: int | None = None, pause: int = 2, average: int | None = None, grow: bool = False, norm: str = "segment", period: float = 1.0) -> DataFrame:
    """keys and x_numsegments, x_meanseglen, x_maxseglen, x_minseglen, x_seglenstddev of each series.

    delta: a segment ends where the row is over the average of the last `average`
    rows (a share 2 / most of all) by more than a share of the range; delt2:
    where it goes over. relth, mrelth, absth: where the average of three rows goes
    through a threshold (of the range, the mean, or as it is), in either
    direction; narelth, namrelth, naabsth: where the row does. Ends are more than
    `least` rows apart (a share 1 / most of all, less one, and two at least), and
    the first counts from least / 2 rows ahead of the series; what follows the
    last end is no segment.

    eqx, nonx, ltx, gtx, leqx, geqx: regions of rows so related to the value (a
    share of the range if relative), begun by `least` (3) such rows that are less
    than `pause` rows apart, and ended by `pause` others; chx: regions of the
    value and of others in turn, each begun by `least` rows. A region's length is
    the distance from its first row to its last.

    Only the first `most` segments count, unless grow. norm: segment gives the
    number as a share of `most` and lengths as shares of the series; frame both
    as they are; second by seconds of `period` a row. No segments give zeros.
    """
    keys = list(b.keys)
    df = written(df.select(*keys, "vidx", x), "contour")
    if kind in ("delta", "delt2") or kind.endswith("th"):
        found = _borders(df, b, x, kind, share, thresholds, most, least, average, grow)
    else:
        found = b.renumbered(written(_regions(df, b, x, kind, value, relative, 3 if least is None else least, pause), "regions"))
    if not grow:
        found = found.where(F.col("vidx") < most)
    length = F.col("length").cast("double")
    stats = found.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(length).alias("mean"), F.max(length).alias("max"), F.min(length).alias("min"), F.stddev_pop(length).alias("std"))
    all_ = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(stats, keys, "left").na.fill(0.0, ["n", "mean", "max", "min", "std"])
    by = {"segment": (1.0 / most, 1 / F.col("_n")), "frame": (1.0, F.lit(1.0)), "second": (1 / (F.col("_n") * period), F.lit(period))}[norm]
    out = [(F.col("n") * by[0]).alias(f"{x}_numsegments")]
    out += [(F.col(c) * by[1]).alias(f"{x}_{name}") for c, name in (("mean", "meanseglen"), ("max", "maxseglen"), ("min", "minseglen"), ("std", "seglenstddev"))]
    return all_.select(*keys, *out)


# -- Peaks ----------------------------------------------------------------


class _Climb:
    """A block's rows as the peak machine sees them: x, the local maximum (or nan) and whether it may begin a peak."""

    def __init__(self, rows: pd.DataFrame):
        self.at = rows["vidx"].to_numpy(np.int64)
        self.x, self.top = rows["x"].to_numpy(float), rows["_top"].to_numpy(float)
        self.start = np.flatnonzero(rows["_begin"].to_numpy(bool))
        self.end = rows["_last"].to_numpy(bool)
        self.fall = float(rows["_fall"].iloc[0])

    def follow(self, i: int, peak: float | None, spot: float):
        """From row i on, outside a peak or in one with its highest maximum so far: (row behind its end or None, highest maximum, its place)."""
        for k in range(i, len(self.x)):
            if self.top[k] > peak:
                peak, spot = self.top[k], float(self.at[k] - 1)
            if self.x[k] < peak - self.fall or self.end[k]:
                return k + 1, peak, spot
        return None, peak, spot

    def begin(self, i: int) -> int | None:
        k = int(np.searchsorted(self.start, i))
        return int(self.start[k]) if k < len(self.start) else None


def peaks_marked(df: DataFrame, b: Blocks, x: str, rise: float = 0.11, fall: float = 0.09) -> DataFrame:
    """keys, vidx, height of peaks.

    A local maximum begins a peak if it is over the last local minimum (0 before
    the first) by more than a share of the range; the peak is the highest local
    maximum until a row is below that by more than a share of the range, or the
    series ends. The machine's state is the peak's highest maximum so far and its
    place. A block's map keeps, for each record low of the block, where a peak
    that ends there leads.
    """
    keys = list(b.keys)
    rows = b.shared(df.select(*keys, "vidx", F.col(x).cast("double").alias("x")), _lo=F.min("x"), _hi=F.max("x"), _end=F.max("vidx"))
    rows = b.windowed(rows, {"_p": _lag("x"), "_pp": _lag("x", 2)}, 2, 0)
    span = F.col("_hi") - F.col("_lo")
    high, low = (F.col("_pp") < F.col("_p")) & (F.col("_p") > F.col("x")), (F.col("_pp") > F.col("_p")) & (F.col("_p") < F.col("x"))
    rows = b.held(rows, "_low", F.when(low, F.col("_p")))
    rows = rows.select(
        *keys, "vidx", "x", F.when(high, F.col("_p")).otherwise(float("nan")).alias("_top"), (fall * span).alias("_fall"), (F.col("vidx") == F.col("_end")).alias("_last"),
        F.coalesce(high & (F.col("_p") - F.coalesce("_low", F.lit(0.0)) > rise * span), F.lit(False)).alias("_begin"),
    )

    def leave(c: _Climb, known: dict, i: int | None):
        """The state behind the block of what goes on outside a peak at row i, or is in one until its end."""
        chain = []
        while True:
            if i in known:
                got = known[i]
                break
            chain.append(i)
            s = c.begin(i)
            if s is None:
                got = (0.0, 0.0, 0.0)
                break
            i, peak, spot = c.follow(s, -np.inf, -1.0)
            if i is None:
                got = (1.0, peak, spot)
                break
        for k in chain:
            known[k] = got
        return got

    def fold(rows):
        c, known = _Climb(rows), {}
        behind, top, spot = c.follow(0, -np.inf, -1.0)  # of a peak whose maxima are the block's own
        stay = leave(c, known, behind) if behind is not None else (2.0, top, spot)
        lows, least = [], np.inf
        for k in range(len(c.x) if behind is None else behind):
            if c.x[k] < least:
                least = c.x[k]
                got = (least, *leave(c, known, k + 1))
                lows = [*lows[:-1], got] if lows and lows[-1][1:] == got[1:] else [*lows, got]
        return [c.fall, *leave(c, known, 0), *stay, *(v for t in lows for v in t)]

    def step(state, m):
        if not state[0]:
            return m[1:4]
        for at in range(7, len(m), 4):
            if m[at] < state[1] - m[0]:
                return m[at + 1 : at + 4]
        if m[4] < 2:
            return m[4:7]
        return state if state[1] >= m[5] else [1.0, m[5], m[6]]

    def replay(rows, state):
        c, out = _Climb(rows), []
        i, peak, spot = 0, state[1], state[2]
        inside = bool(state[0])
        while True:
            if not inside:
                i, peak, spot = c.begin(i), -np.inf, -1.0
                if i is None:
                    break
            i, peak, spot = c.follow(i, peak, spot)
            if i is None:
                break
            out.append((int(spot), peak))
            inside = False
        first = rows[keys].iloc[[0] * len(out)].reset_index(drop=True)
        return first.assign(_spot=np.array([s for s, _ in out], np.int64), height=np.array([h for _, h in out], float))

    found = scanned(rows, b, fold, step, [0.0, 0.0, 0.0], replay, keys, _spot=LongType(), height=DoubleType())
    return found.withColumnRenamed("_spot", "vidx")


def peaks(df: DataFrame, b: Blocks, x: str, rise: float = 0.11, fall: float = 0.09, norm: str = "frame", period: float = 1.0) -> DataFrame:
    """keys and x_numpeaks, x_meanpeakdist (rows + 1 if there is no distance), x_peakmean (0 without a peak), x_peakmeanmeandist (to the contour's mean), x_peakdiststddev."""
    keys = list(b.keys)
    df = written(df.select(*keys, "vidx", x), "contour")
    marks = _lengths(b, written(peaks_marked(df, b, x, rise, fall), "peaks"), F.lit(None).cast("long"))
    d = F.col("length").cast("double")
    stats = marks.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(d).alias("dist"), F.avg("height").alias("height"), F.stddev_pop(d).alias("std"))
    all_ = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(x).alias("_mu")).join(stats, keys, "left")
    by = {"segment": 1 / F.col("_n"), "frame": F.lit(1.0), "second": F.lit(period)}[norm]
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return all_.select(
        *keys, zero("n").alias(f"{x}_numpeaks"), (F.coalesce("dist", (F.col("_n") + 1).cast("double")) * by).alias(f"{x}_meanpeakdist"), zero("height").alias(f"{x}_peakmean"),
        (zero("height") - F.col("_mu")).alias(f"{x}_peakmeanmeandist"), (zero("std") * by).alias(f"{x}_peakdiststddev"),
    )


def onsets(df: DataFrame, b: Blocks, x: str, on: float = 0.0, off: float = 0.0) -> DataFrame:
    """keys and x_onsetpos, x_offsetpos, x_numonsets, x_numoffsets, x_onsetrate: rows where the size goes above `on`, and then falls to `off` (at most `on`) again."""
    if off > on:
        raise ValueError("off is above on")
    v, keys = F.abs(F.col(x)), list(b.keys)
    rows = b.held(df.select(*keys, "vidx", x), "_in", F.when(v > on, 1).when(v <= off, 0))
    rows = b.windowed(rows, {"_was": _lag("_in")}, 1, 0)
    up, down = (F.col("_in") == 1) & (F.coalesce("_was", F.lit(0)) != 1), (F.col("_in") == 0) & (F.col("_was") == 1)
    number = lambda c: F.coalesce(F.sum(F.when(c, 1.0)), F.lit(0.0))
    place = lambda f, c: F.coalesce(f(F.when(c, F.col("vidx"))), F.lit(0)).cast("double")
    return rows.groupBy(*keys).agg(
        place(F.min, up).alias(f"{x}_onsetpos"), place(F.max, down).alias(f"{x}_offsetpos"), number(up).alias(f"{x}_numonsets"), number(down).alias(f"{x}_numoffsets"),
        (number(up) / F.count(F.lit(1))).alias(f"{x}_onsetrate"),
    )


# -- Linear prediction and modulation ---------------------------------------


def linear_prediction(df: DataFrame, b: Blocks, x: str, order: int = 5) -> DataFrame:
    """keys and x_lpgain, x_lpc0, ...: of the contour's autocorrelation, by Levinson-Durbin; the gain is by the number of rows. Silence gives zeros."""
    keys = list(b.keys)
    lead = lambda k: lambda s: F.lead("x", k).over(s.ordered())
    rows = b.windowed(df.select(*keys, "vidx", F.col(x).cast("double").alias("x")), {f"_l{k}": lead(k) for k in range(1, order + 1)}, 0, order)
    lags = [F.sum(F.col("x") * F.col("x"))] + [F.coalesce(F.sum(F.col("x") * F.col(f"_l{k}")), F.lit(0.0)) for k in range(1, order + 1)]
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.array(*lags).alias("_r"))
    got = sums.select(*keys, "_n", let(F.col("_r"), lambda r: durbin(r, order)).alias("_p"))
    return got.select(*keys, (F.greatest(F.col("_p.e"), F.lit(0.0)) / F.col("_n")).alias(f"{x}_lpgain"), *[F.col("_p.a")[k].alias(f"{x}_lpc{k}") for k in range(order)])


def modulation_bins(period: float, size: float, resolution: float, low: float, high: float) -> tuple[int, int, list[tuple[int, int, float]]]:
    """Rows of a window, points of its transform, and for each wanted frequency the two bins it lies between with the upper one's weight."""
    rows = max(2, round(size / period))
    points = max(1 << (rows - 1).bit_length(), round(1 / (period * resolution)))
    at = np.minimum(np.arange(low, high + resolution / 2, resolution) * points * period, points // 2)
    lower = np.minimum(np.floor(at), points // 2 - 1).astype(int)
    return rows, points, [(int(k), int(k) + 1, float(a - k)) for k, a in zip(lower, at)]


def modulation(df: DataFrame, b: Blocks, x: str, period: float = 0.01, size: float = 4.0, step: float = 2.0, resolution: float = 0.5, low: float = 0.5, high: float = 20.0) -> DataFrame:
    """keys and x_mod0, ...: the mean magnitude, at frequencies from low to high, of windows of the contour less their mean under a Hamming window.

    A window that the series' end leaves with two thirds of its rows or fewer
    counts only if it is the first. Each row adds its terms to the windows it
    lies in, so windows and series split over tasks, and nothing is put together
    as an array.
    """
    keys, hop = list(b.keys), max(1, round(step / period))
    rows, points, spots = modulation_bins(period, size, resolution, low, high)
    v = b.shared(df.select(*keys, "vidx", F.col(x).cast("double").alias("x")), _n=F.count(F.lit(1)))
    first, last = F.greatest(F.ceil((F.col("vidx") - rows + 1) / hop), F.lit(0)), F.floor(F.col("vidx") / hop)
    v = v.where(first <= last).select("*", F.explode(F.sequence(first.cast("long"), last.cast("long"))).alias("_k"))
    v = v.withColumns({"_m": F.least(F.lit(rows), F.col("_n") - F.col("_k") * hop), "_j": F.col("vidx") - F.col("_k") * hop})
    v = v.where((F.col("_k") == 0) | (F.col("_m") > 2 * rows / 3))
    h = F.when(F.col("_m") > 1, 0.54 - 0.46 * F.cos(2 * math.pi * F.col("_j") / (F.col("_m") - 1))).otherwise(1.0)
    bins = sorted({k for a, c, _ in spots for k in (a, c)})
    terms = {}
    for k in bins:
        turn = F.col("_j") * (2 * math.pi * k / points)
        for name, wave in (("c", F.cos(turn)), ("s", F.sin(turn))):
            terms[f"_{name}{k}"], terms[f"_{name}{k}_x"] = F.sum(F.col("_h") * wave), F.sum(F.col("_h") * F.col("x") * wave)
    sums = v.withColumn("_h", h).groupBy(*keys, "_k").agg(F.avg("x").alias("_mu"), *[c.alias(n) for n, c in terms.items()])
    part = lambda n: F.col(f"{n}_x") - F.col("_mu") * F.col(n)
    sums = sums.select(*keys, *[F.sqrt(part(f"_c{k}") * part(f"_c{k}") + part(f"_s{k}") * part(f"_s{k}")).alias(f"_b{k}") for k in bins])
    return sums.groupBy(*keys).agg(*[F.avg(F.col(f"_b{a}") * (1 - w) + F.col(f"_b{c}") * w).alias(f"{x}_mod{i}") for i, (a, c, w) in enumerate(spots)])


# -- Alternating extrema ------------------------------------------------------


class _Swing:
    """A block's rows as the machine of alternating extrema sees them.

    Upwards (sign 1) it looks for a top: the highest row so far, once a row is
    below it by more than `need`; downwards (sign -1) for a bottom. A state is
    (sign, height, place), the height times the sign; from there all follows.
    """

    def __init__(self, rows: pd.DataFrame):
        self.at, self.x = rows["vidx"].to_numpy(np.int64), rows["x"].to_numpy(float)
        self.need = float(rows["_need"].iloc[0])
        self.known: dict = {}

    def until(self, sign: int, i: int, height: float, place: float):
        """From row i on in a direction: (row of the turn or None, height, place)."""
        y = sign * self.x
        for k in range(i, len(y)):
            if y[k] > height:
                height, place = y[k], float(self.at[k])
            if height - y[k] > self.need:
                return k, height, place
        return None, height, place

    def leave(self, sign: int, k: int) -> tuple:
        """The state behind the block after a turn into the direction at row k."""
        chain = []
        while True:
            if (sign, k) in self.known:
                got = self.known[sign, k]
                break
            chain.append((sign, k))
            turn, height, place = self.until(sign, k + 1, sign * self.x[k], float(self.at[k]))
            if turn is None:
                got = (float(sign), height, place)
                break
            sign, k = -sign, turn
        for c in chain:
            self.known[c] = got
        return got

    def map(self, sign: int) -> list[float]:
        """For a state ahead of the block in this direction: the turn by the block's own heights (its row, or none), the highest row,
        and for each record low the row and the state behind: a height over it by more than need turns there."""
        y = sign * self.x
        turn, height, place = self.until(sign, 0, -np.inf, -1.0)
        end = len(y) if turn is None else turn
        out = [-1.0 if turn is None else float(turn), *((0.0, height, place) if turn is None else self.leave(-sign, turn))]
        least, lows = np.inf, []
        for k in range(end):
            if y[k] < least:
                least = y[k]
                lows += [least, float(k), *self.leave(-sign, k)]
        return [float(len(lows) // 5), *out, *lows]


def _swung(m: np.ndarray, at: int, need: float, height: float):
    """Read a direction's map from place `at`: (row of the turn or None, state behind it), (highest row, place), and where the map ends."""
    n = int(m[at])
    own, behind, lows = m[at + 1], m[at + 2 : at + 5], m[at + 5 : at + 5 + 5 * n].reshape(n, 5)
    hit = np.flatnonzero(height - lows[:, 0] > need)
    if len(hit):
        got = int(lows[hit[0], 1]), lows[hit[0], 2:5]
    elif own >= 0:
        got = int(own), behind
    else:
        got = None, None
    return got, (behind[1], behind[2]), at + 5 + 5 * n


def extrema_marked(df: DataFrame, b: Blocks, x: str, relative: float = 0.1, absolute: float | None = None) -> DataFrame:
    """keys, vidx, kind (1 a top, -1 a bottom), height: alternating extrema that differ by more than a share of the range, or by a number.

    The first row is neither, and series of fewer than three rows, or of one
    value, have none. The state ahead of a block is the direction, and the
    highest (lowest) row since the last turn; until the first turn both.
    """
    keys = list(b.keys)
    rows = b.shared(df.select(*keys, "vidx", F.col(x).cast("double").alias("x")), _lo=F.min("x"), _hi=F.max("x"), _n=F.count(F.lit(1)))
    need = F.lit(float(absolute)) if absolute is not None else relative * (F.col("_hi") - F.col("_lo"))
    rows = rows.where((F.col("_n") > 2) & (F.col("_hi") > F.col("_lo"))).select(*keys, "vidx", "x", need.alias("_need"))

    def fold(part):
        s = _Swing(part)
        return [s.need, *s.map(1), *s.map(-1)]

    def step(state, m):
        """state: sign, height, place, and while the sign is 0 the lowest row's height (times -1) and place."""
        sign = int(state[0])
        up, high, end = _swung(m, 1, m[0], state[1] if sign >= 0 else -np.inf)
        down, low, _ = _swung(m, end, m[0], state[3] if sign == 0 else state[1] if sign < 0 else -np.inf)
        pick = lambda h, p, new: [h, p] if h >= new[0] else list(new)
        if sign == 0:
            if up[0] is None and down[0] is None:
                return [0.0, *pick(state[1], state[2], high), *pick(state[3], state[4], low)]
            first = up if down[0] is None or (up[0] is not None and up[0] <= down[0]) else down
            return [*first[1], 0.0, 0.0]
        turn, best = (up, high) if sign > 0 else (down, low)
        return [*turn[1], 0.0, 0.0] if turn[0] is not None else [float(sign), *pick(state[1], state[2], best), 0.0, 0.0]

    def replay(part, state):
        s, out, i = _Swing(part), [], 0
        sign, height, place = int(state[0]), state[1], state[2]
        if sign == 0:
            up, down = s.until(1, 0, state[1], state[2]), s.until(-1, 0, state[3], state[4])
            if up[0] is None and down[0] is None:
                return _marks(part, keys, out)
            sign, (i, height, place) = (1, up) if down[0] is None or (up[0] is not None and up[0] <= down[0]) else (-1, down)
            out.append((place, sign, sign * height))
            sign, height, place, i = -sign, -sign * s.x[i], float(s.at[i]), i + 1
        while True:
            i, height, place = s.until(sign, i, height, place)
            if i is None:
                return _marks(part, keys, out)
            out.append((place, sign, sign * height))
            sign, height, place, i = -sign, -sign * s.x[i], float(s.at[i]), i + 1

    start = lambda part: [0.0, part["x"].iloc[0], 0.0, -part["x"].iloc[0], 0.0]
    found = scanned(rows, b, fold, step, start, replay, keys, _spot=LongType(), kind=LongType(), height=DoubleType())
    return found.where("_spot > 0").withColumnRenamed("_spot", "vidx")


def _marks(part: pd.DataFrame, keys: list[str], out: list[tuple]) -> pd.DataFrame:
    first = part[keys].iloc[[0] * len(out)].reset_index(drop=True)
    return first.assign(_spot=np.array([o[0] for o in out], np.int64), kind=np.array([o[1] for o in out], np.int64), height=np.array([o[2] for o in out], float))


def peaks2(df: DataFrame, b: Blocks, x: str, relative: float = 0.1, absolute: float | None = None) -> DataFrame:
    """keys and statistics of alternating extrema: distances, heights and steps of the tops and of the bottoms, rising and falling slopes between neighbours."""
    keys = list(b.keys)
    df = written(df.select(*keys, "vidx", x), "contour")
    marks = written(extrema_marked(df, b, x, relative, absolute), "extrema")

    def neighbours(rows: DataFrame) -> DataFrame:
        rows = b.renumbered(rows.withColumn("_spot", F.col("vidx")))
        return b.windowed(rows, {"_s1": _lag("_spot"), "_s2": _lag("_spot", 2), "_h1": _lag("height")}, 2, 0)

    def stats(kind: int, names: dict) -> DataFrame:
        return neighbours(marks.where(F.col("kind") == kind)).groupBy(*keys).agg(*[c.alias(n) for n, c in names.items()])

    d, h, up = F.col("_spot") - F.col("_s1"), F.col("height"), F.abs(F.col("height") - F.col("_h1"))
    of = lambda p: {f"{p}range": F.max(h) - F.min(h), f"{p}mean": F.avg(h), f"{p}amp": F.avg(up), f"{p}ampstd": F.stddev_pop(up)}
    tops = stats(1, {"n": F.count(F.lit(1)), "dist": F.avg(d), "dd": F.avg(F.abs(d - (F.col("_s1") - F.col("_s2")))), "diststd": F.stddev_pop(d), **of("t")})
    bottoms = stats(-1, of("b"))
    slope = (h - F.col("_h1")) / F.when(d > 0, d)
    both = neighbours(marks)
    by = {}
    for name, kind in (("rising", 1), ("falling", -1)):
        v = F.when(F.col("kind") == kind, slope)
        by |= {f"mean{name}": F.avg(v), f"max{name}": F.max(v), f"min{name}": F.min(v), f"std{name}": F.stddev_pop(v)}
    slopes = both.groupBy(*keys).agg(*[c.alias(n) for n, c in by.items()])
    all_ = df.groupBy(*keys).agg(F.avg(x).alias("mu"), (F.max(x) - F.min(x)).alias("span"))
    for t in (tops, bottoms, slopes):
        all_ = all_.join(t, keys, "left")
    z = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0.0)).cast("double")
    over = lambda a, c: z(F.col(a) / F.when(F.col(c) != 0, F.col(c)))
    out = {"numpeaks": z("n"), "meanpeakdist": z("dist"), "meanpeakdistdelta": z("dd"), "peakdiststddev": z("diststd")}
    for name, p, word, apart in (("peak", "t", "ptp", F.col("tmean") - F.col("mu")), ("min", "b", "mtm", F.col("mu") - F.col("bmean"))):
        out |= {f"{name}rangeabs": z(f"{p}range"), f"{name}rangerel": over(f"{p}range", "span"), f"{name}meanabs": z(f"{p}mean"), f"{name}meanmeandist": z(apart), f"{name}meanrel": over(f"{p}mean", "mu")}
        out |= {f"{word}ampmeanabs": z(f"{p}amp"), f"{word}ampmeanrel": over(f"{p}amp", "span"), f"{word}ampstddevabs": z(f"{p}ampstd"), f"{word}ampstddevrel": over(f"{p}ampstd", "span")}
    for name in ("rising", "falling"):
        out |= {f"mean{name}slope": z(f"mean{name}"), f"max{name}slope": z(f"max{name}"), f"min{name}slope": z(f"min{name}"), f"stddev{name}slope": z(f"std{name}"), f"cov{name}slope": over(f"std{name}", f"mean{name}")}
    return all_.select(*keys, *[c.alias(f"{x}_{n}") for n, c in out.items()])

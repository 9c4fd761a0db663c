"""Row-frame window operators of a series: one row out for each row in.

Left of the first row stands the first row again, right of the last the last.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import _by, squares
from ..series import Series


def shifted(s: Series, x: str, by: int) -> Column:
    """x of the row `by` places on (back if negative), edges repeated."""
    w = s.ordered()
    if not by:
        return F.col(x)
    full = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if by < 0:
        return F.coalesce(F.lag(x, -by).over(w), F.first(x).over(full))
    return F.coalesce(F.lead(x, by).over(w), F.last(x).over(full))


def _total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def sma(s: Series, x: str, width: int = 3, skip_zeros: bool = False) -> Column:
    """Centred moving average of odd width; with skip_zeros zeros stay and are not averaged."""
    if width % 2 == 0:
        raise ValueError("the width must be odd")
    parts = [shifted(s, x, k) for k in range(-(width // 2), width // 2 + 1)]
    if not skip_zeros:
        return _total(parts) / width
    count = _total([F.when(p != 0, 1).otherwise(0) for p in parts])
    return F.when(F.col(x) == 0, 0.0).otherwise(_total(parts) / count)


def delta(s: Series, x: str, width: int = 2, absolute: bool = False, half_wave: bool = False, relative: bool = False, in_segments: bool = False) -> Column:
    """Regression delta; width 0 is the difference to the row before (0 for the first).

    relative divides by the value (0 where it is 0); in_segments leaves out
    pairs with a zero on either side, and is 0 where the row itself is 0.
    """
    if width == 0:
        d = F.col(x) - shifted(s, x, -1)
    else:
        pairs = [(i, shifted(s, x, i), shifted(s, x, -i)) for i in range(1, width + 1)]
        if in_segments:
            num = _total([F.when((a != 0) & (b != 0), i * (a - b)).otherwise(0.0) for i, a, b in pairs])
            den = _total([F.when((a != 0) & (b != 0), float(2 * i * i)).otherwise(0.0) for i, a, b in pairs])
            d = F.when((F.col(x) == 0) | (den == 0), 0.0).otherwise(num / F.when(den == 0, 1.0).otherwise(den))
        else:
            d = _total([i * (a - b) for i, a, b in pairs]) / (2.0 * sum(i * i for i in range(1, width + 1)))
    if relative:
        d = F.when(F.col(x) == 0, 0.0).otherwise(d / F.col(x))
    if half_wave:
        d = F.greatest(d, F.lit(0.0))
    return F.abs(d) if absolute else d


def preemphasis(s: Series, x: str, k: float = 0.97, de: bool = False) -> Column:
    """x[n] - k x[n-1], or + with de."""
    return F.col(x) + (k if de else -k) * shifted(s, x, -1)


def _median(values: Column) -> Column:
    """Of an array; null for none."""
    a = F.array_sort(values)
    n = F.size(a)
    return F.when(n > 0, (F.get(a, F.floor((n - 1) / 2).cast("int")) + F.get(a, F.floor(n / 2).cast("int"))) / 2)


def running_median(s: Series, x: str, width: int = 3) -> Column:
    """Median of the centred window, cut at the ends."""
    return _median(F.collect_list(x).over(s.ordered().rowsBetween(-(width // 2), width // 2)))


def mean_norm(s: Series, x: str, kind: str = "amean", exclude_zeros: bool = False, clip: bool = False, symmetric: bool = False) -> Column:
    """x less its series' mean: amean, absmean or rqmean (root of the mean square); symmetric takes it off the size, towards 0."""
    w = s.whole()
    v = F.when(F.col(x) != 0, F.col(x)) if exclude_zeros else F.col(x)
    m = F.coalesce({"amean": F.avg(v).over(w), "absmean": F.avg(F.abs(v)).over(w), "rqmean": F.sqrt(F.avg(v * v).over(w))}[kind], F.lit(0.0))
    d = F.signum(x) * F.greatest(F.abs(x) - F.abs(m), F.lit(0.0)) if symmetric else F.col(x) - m
    return F.greatest(d, F.lit(0.0)) if clip else d


def spectral_floor(s: Series, x: str, share: float = 0.1, floor: float = 1e-10) -> Column:
    """x less its series' mean, but no less than a share of x, nor than the floor."""
    return F.greatest(F.col(x) - F.avg(x).over(s.whole()), share * F.col(x), F.lit(floor))


def mvn(s: Series, x: str, mode: str = "full", rows: int = 100, floor: float = 1e-7, ddof: int = 0) -> Column:
    """(x - mean) / standard deviation: of the series, of the rows so far (running) or of the last rows (buffer)."""
    w = {"full": s.whole(), "running": s.upto(), "buffer": s.upto(rows)}[mode]
    sd = F.greatest((F.stddev_samp if ddof else F.stddev_pop)(x).over(w), F.lit(floor))
    return (F.col(x) - F.avg(x).over(w)) / sd


def learned(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """by, mean, deviation, least and largest of x: a transform to write, read again and apply to other rows."""
    return df.groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("deviation"), F.min(x).alias("least"), F.max(x).alias("largest"))


def applied(df: DataFrame, transform: DataFrame, by: list[str], x: str, mode: str = "mvn", floor: float = 1e-7) -> DataFrame:
    """df with x transformed by a learned table: mvn, mean or range; rows whose `by` it lacks stay as they are."""
    v = F.col(x)
    span = F.col("largest") - F.col("least")
    new = {"mvn": (v - F.col("mean")) / F.greatest("deviation", F.lit(floor)), "mean": v - F.col("mean"), "range": F.when(span > 0, (v - F.col("least")) / F.when(span > 0, span)).otherwise(0.0)}[mode]
    return df.join(transform, by, "left").withColumn(x, F.coalesce(new, v)).select(*df.columns)


def range_norm(s: Series, x: str, low: float = 0.0, high: float = 1.0) -> Column:
    """x scaled from its series' range to low..high; a range of 0 gives low."""
    lo, hi = F.min(x).over(s.whole()), F.max(x).over(s.whole())
    return F.when(hi == lo, low).otherwise(low + (high - low) * (F.col(x) - lo) / (hi - lo))


def log_energy_norm(s: Series, x: str) -> Column:
    """x - max + 1 of the series."""
    return F.col(x) - F.max(x).over(s.whole()) + 1.0


def exponential_mvn(df: DataFrame, s: Series, x: str, alpha: float = 0.995, floor: float = 1e-7, rows: int = 1 << 16) -> DataFrame:
    """A level with <x>_mvn, adaptive normalisation with exponential weights: a recurrence, in blocks of so many rows."""
    from . import blocks

    return blocks.exponential_mvn(df, blocks.Blocks(tuple(s.keys), rows), x, alpha, floor)


def above(s: Series, x: str, threshold: float = 1.0, adaptive: int = 0, invert: bool = False, allow_equal: bool = False) -> Column:
    """The row filter's predicate: x over the threshold, or over the mean of the last `adaptive` rows."""
    t = F.avg(x).over(s.upto(adaptive)) if adaptive else F.lit(threshold)
    v = F.col(x)
    hit = v < t if invert else v > t
    return hit | (v == t) if allow_equal else hit


def cens(s: Series, df: DataFrame, chroma: str, width: int = 41, every: int = 10) -> DataFrame:
    """keys, vidx, <chroma>_cens: quantised chroma (array), smoothed with a Hann window over rows, each `every`-th row kept, of length 1.

    Each row sends its bins to the kept rows that it lies near, so nothing is made for the others.
    """
    half, out = width // 2, f"{chroma}_cens"
    quantised = F.transform(chroma, lambda c: sum((F.when(c > t, 1.0).otherwise(0.0) for t in (0.05, 0.1, 0.2, 0.4)), F.lit(0.0)))
    rows = df.select(*s.keys, "vidx", quantised.alias("q"), F.max("vidx").over(s.whole()).alias("last"))
    near = F.sequence(F.ceil(F.greatest(F.col("vidx") - half, F.lit(0)) / every), F.floor(F.least(F.col("vidx") + half, F.col("last")) / every))
    spread = rows.where(F.ceil(F.greatest(F.col("vidx") - half, F.lit(0)) / every) <= F.floor(F.least(F.col("vidx") + half, F.col("last")) / every))
    spread = spread.select(*s.keys, "vidx", "q", F.explode(near).alias("to")).withColumn("to", F.col("to") * every)
    weight = 0.5 - 0.5 * F.cos(2 * math.pi * (F.col("vidx") - F.col("to") + half + 1) / (width + 1))
    bins = spread.select(*s.keys, "to", weight.alias("w"), F.posexplode("q").alias("bin", "q"))
    sums = bins.groupBy(*s.keys, "to", "bin").agg(F.sum(F.col("w") * F.col("q")).alias("v"))
    rows = sums.groupBy(*s.keys, "to").agg(F.transform(F.array_sort(F.collect_list(F.struct("bin", "v"))), lambda r: r["v"]).alias("v"))
    return rows.select(*s.keys, F.col("to").cast("long").alias("vidx"), _by(F.col("v"), F.sqrt(squares(F.col("v")))).alias(out))


def held(s: Series, x: str) -> Column:
    """x where it is above 0, else the last such value before; 0 before the first."""
    return F.coalesce(F.last(F.when(F.col(x) > 0, F.col(x)), ignorenulls=True).over(s.upto()), F.lit(0.0))


def smoothed_formant(s: Series, x: str, f0: str, width: int = 5) -> Column:
    """Median of the voiced rows of the centred window where f0 is above 0, else 0."""
    w = s.ordered().rowsBetween(-(width // 2), width // 2)
    return F.when(F.col(f0) > 0, F.coalesce(_median(F.collect_list(F.when((F.col(f0) > 0) & (F.col(x) > 0), F.col(x))).over(w)), F.lit(0.0))).otherwise(0.0)


def without_spikes(s: Series, x: str) -> Column:
    """Rows that alone are above 0, or alone are 0, between two others: 0, or the others' mean."""
    was, will, v = F.lag(x).over(s.ordered()), F.lead(x).over(s.ordered()), F.col(x)
    return F.when((v > 0) & (was == 0) & (will == 0), 0.0).when((v == 0) & (was > 0) & (will > 0), (was + will) / 2).otherwise(v)


def octave_corrected(s: Series, f0: str, rows: int = 20, margin: float = 0.2) -> Column:
    """f0 doubled or halved where that brings it within the margin of the mean of the voiced rows before it."""
    w = s.ordered().rowsBetween(-rows, -1)
    v, mean = F.col(f0), F.avg(F.when(F.col(f0) > 0, F.col(f0))).over(w)
    near = lambda k: F.abs(v * k / mean - 1) < margin
    return F.when((v <= 0) | mean.isNull() | (mean <= 0) | near(1.0), v).when(near(2.0), v * 2).when(near(0.5), v / 2).otherwise(v)


def gated_mvn(keys: tuple[str, ...], x: str, turn: str, reset: bool = True, floor: float = 1e-7) -> Column:
    """(x - mean) / deviation by the rows inside turns so far: of the same turn with reset, else of all. Null where turn is null."""
    by = [*keys, turn] if reset else list(keys)
    w = Window.partitionBy(*by).orderBy("vidx").rowsBetween(Window.unboundedPreceding, 0)
    v = F.when(F.col(turn).isNotNull(), F.col(x))
    return (v - F.avg(v).over(w)) / F.greatest(F.stddev_pop(v).over(w), F.lit(floor))


def turns_between(df: DataFrame, s: Series, x: str, on: float, off: float | None = None, pre: int = 2, post: int = 2) -> DataFrame:
    """keys, segment, start, stop (inclusive) of turns: entered after more than pre rows in a row above `on`, left after more than post at or below `off`.

    For off <= on, where no row is both, the state machine is windows over runs
    of such rows: the pre + 1st row of a run above enters, the post + 1st of a
    run below leaves, and of equal events in a row the first counts.
    """
    off = on if off is None else off
    if off > on:
        raise ValueError("off is above on")
    w = s.ordered()
    rows = df.select(*s.keys, "vidx", (F.col(x) > on).alias("up"), (F.col(x) <= off).alias("down"), F.max("vidx").over(s.whole()).alias("last"))
    for c in ("up", "down"):
        rows = rows.withColumn(f"_{c}", F.sum(F.when(F.col(c), 0).otherwise(1)).over(s.upto()))
        run = Window.partitionBy(*s.keys, f"_{c}").orderBy("vidx").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn(f"n_{c}", F.sum(F.when(F.col(c), 1).otherwise(0)).over(run))
    tail = F.last(F.when(F.col("down"), F.col("n_down")).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("tail", tail)
    events = rows.where((F.col("up") & (F.col("n_up") == pre + 1)) | (F.col("down") & (F.col("n_down") == post + 1)))
    events = events.withColumn("was", F.lag("up").over(w))
    events = events.where((F.col("up") & ~F.coalesce("was", F.lit(False))) | (F.col("down") & F.coalesce("was", F.lit(False))))
    out = events.withColumn("left", F.lead("vidx").over(w)).where("up")
    return out.select(*s.keys, (F.row_number().over(w) - 1).cast("long").alias("segment"), (F.col("vidx") - pre).alias("start"), F.coalesce(F.col("left") - post - 1, F.col("last") - F.col("tail")).alias("stop"))


def syllable_starts(s: Series, f0: str, energy: str, threshold: float, least: int = 4) -> Column:
    """1 at each row that completes a pseudo-syllable, a run of `least` rows that are voiced and loud; the run's further rows are 0."""
    good = (F.col(f0) > 0) & (F.col(energy) > threshold)
    before = [F.coalesce(F.lag(good, k).over(s.ordered()), F.lit(False)) for k in range(1, least + 1)]
    return F.when(reduce(lambda a, b: a & b, [good, *before[:-1]]) & ~before[-1], 1.0).otherwise(0.0)


def speaking_rate(s: Series, syllable: str, rows: int = 100, period: float = 0.01) -> Column:
    """Syllables a second over the last rows."""
    return F.sum(syllable).over(s.upto(rows)) / (rows * period)


def _voiced_means(s: Series, f0: str, long_rows: int, short_rows: int) -> tuple[Column, Column]:
    v = F.when(F.col(f0) > 0, F.col(f0))
    return F.avg(v).over(s.upto(short_rows)), F.avg(v).over(s.upto(long_rows))


def pitch_direction(s: Series, f0: str, long_rows: int = 20, short_rows: int = 5, margin: float = 0.02) -> Column:
    """1 rising, -1 falling, 0 flat: the short running mean of voiced f0 against the long one."""
    near, far = _voiced_means(s, f0, long_rows, short_rows)
    return F.when(near > far * (1 + margin), 1).when(near < far * (1 - margin), -1).otherwise(0)


def direction_score(s: Series, f0: str, long_rows: int = 20, short_rows: int = 5) -> Column:
    """The short running mean of voiced f0 less the long one; 0 without a voiced row."""
    near, far = _voiced_means(s, f0, long_rows, short_rows)
    return F.coalesce(near - far, F.lit(0.0))

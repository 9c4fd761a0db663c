"""Segments of series: fixed, full, listed and run-length windows, and joins of levels.

Each function adds a segment column and may repeat rows (overlapping windows);
aggregate with groupBy(keys, segment) once for all functionals.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import Series, join_periodic


def fixed(df: DataFrame, s: Series, size: int, step: int | None = None, incomplete: bool = False, centre: int = 0) -> DataFrame:
    """Windows of `size` rows, one each `step`, window k from k * step - centre on; a short last one is dropped unless incomplete."""
    step = step or size
    first = F.greatest(F.lit(0), F.ceil((F.col("vidx") + centre - size + 1) / step))
    last = F.floor((F.col("vidx") + centre) / step)
    out = df
    if not incomplete:
        out = out.withColumn("_n", F.count(F.lit(1)).over(s.whole()))
        last = F.least(last, F.floor((F.col("_n") + centre - size) / step))
    out = out.withColumn("_first", first.cast("long")).withColumn("_last", last.cast("long")).where("_first <= _last")
    return out.withColumn("segment", F.explode(F.sequence("_first", "_last"))).drop("_first", "_last", "_n")


def full(df: DataFrame) -> DataFrame:
    return df.withColumn("segment", F.lit(0).cast("long"))


def zero_padded(df: DataFrame, s: Series, fields: list[str], size: int, step: int | None = None) -> DataFrame:
    """df with rows of zeros behind each series' end, so that a last window of `size` begun in it is full."""
    step = step or size
    ends = df.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("n"))
    starts = F.floor((F.col("n") - 1) / step) * step
    more = ends.where(starts + size > F.col("n")).select(*s.keys, F.explode(F.sequence(F.col("n"), starts + size - 1)).alias("vidx"))
    return df.select(*s.keys, "vidx", *fields).unionByName(more.select(*s.keys, F.col("vidx").cast("long").alias("vidx"), *[F.lit(0.0).alias(f) for f in fields]))


def parse_list(text: str, period: float) -> list[tuple[int, int]]:
    """Inclusive row intervals of a list such as `0-9,1.5s-2s,25`; a bare number is a length behind the last end.

    Seconds become rows by floor at the start and ceiling at the end.
    """
    out, at = [], 0
    for part in filter(None, (p.strip() for p in text.split(","))):
        m = re.fullmatch(r"([0-9.]+)(s?)(?:-([0-9.]+)(s?))?", part)
        if not m:
            raise ValueError(f"not an interval: {part}")
        a, sa, b, sb = m.groups()
        low = int(float(a) / period + 1e-9) if sa else int(float(a))
        if b is None:
            out.append((at, at + max(low, 1) - 1))
        else:
            out.append((low, int(-(-float(b) // period)) if sb else int(float(b))))
        at = out[-1][1] + 1
    return out


def listed_in(df: DataFrame, intervals: DataFrame, least: int = 1, bucket: int = 64) -> DataFrame:
    """Rows of each inclusive interval of vidx of a table (segment, start, stop), the same for all series; shorter ones are left out.

    The table goes to all tasks: dealt by its buckets alone, which all series
    share, the rows would come to a few.
    """
    own = intervals.where(F.col("stop") - F.col("start") + 1 >= least)
    t = own.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("stop") / bucket))))
    return df.withColumn("_b", F.floor(F.col("vidx") / bucket)).join(F.broadcast(t), "_b").where("vidx between start and stop").drop("_b", "start", "stop")


def listed(df: DataFrame, intervals: list[tuple[int, int]]) -> DataFrame:
    """Rows of each inclusive interval of vidx; the list is given by hand, so it is small."""
    spots = F.array(*[F.struct(F.lit(i).cast("long").alias("segment"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b")) for i, (a, b) in enumerate(intervals)])
    own = F.filter(spots, lambda r: (F.col("vidx") >= r["a"]) & (F.col("vidx") <= r["b"]))
    return df.withColumn("_s", F.explode(own)).withColumn("segment", F.col("_s.segment")).drop("_s")


def interval_join(df: DataFrame, turns: DataFrame, s: Series, bucket: int = 64) -> DataFrame:
    """Rows of df with the turns (keys, segment, start, stop; inclusive) they lie in.

    Both sides are dealt by (keys, vidx bucket), an equi-join, so long series
    and many turns split over tasks.
    """
    t = turns.withColumn("_b", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("stop") / bucket))))
    x = df.withColumn("_b", F.floor(F.col("vidx") / bucket))
    return x.join(t, [*s.keys, "_b"]).where("vidx between start and stop").drop("_b")


def runs(df: DataFrame, s: Series, by: str | Column) -> DataFrame:
    """A segment ends where the value changes."""
    c = F.col(by) if isinstance(by, str) else by
    w = s.ordered()
    new = F.when(F.lag(c).over(w).isNull() | (F.lag(c).over(w) != c), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("segment", (F.sum("_new").over(s.upto()) - 1).cast("long")).drop("_new")


def sessions(df: DataFrame, s: Series, time: str, gap: float) -> DataFrame:
    """A segment ends where the next row is more than gap seconds away."""
    w = s.ordered()
    far = F.when(F.lag(time).over(w).isNull() | (F.col(time) - F.lag(time).over(w) > gap), 1).otherwise(0)
    return df.withColumn("_new", far).withColumn("segment", (F.sum("_new").over(s.upto()) - 1).cast("long")).drop("_new")


def join_levels(keys: tuple[str, ...], *levels: DataFrame, force: bool = False) -> DataFrame:
    """Rows that all levels have, by keys and vidx; time comes from the first, and known periods must agree unless forced."""
    return join_periodic(keys, *levels, force=force)


def frames(df: DataFrame, s: Series, x: str, size: int, step: int | None = None) -> DataFrame:
    """Windows as array columns, values in order."""
    cut = fixed(df, s, size, step)
    return cut.groupBy(*s.keys, "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("vidx", x))), lambda r: r[x]).alias("frame"))


def overlap_add(df: DataFrame, s: Series, frame: str, step: int, normalise: bool = False) -> DataFrame:
    """The series from overlapping frames: values at the same place are added (or averaged)."""
    rows = df.select(*s.keys, "segment", F.posexplode(frame).alias("_i", "x"))
    how = F.avg("x") if normalise else F.sum("x")
    return rows.groupBy(*s.keys, (F.col("segment") * step + F.col("_i")).alias("vidx")).agg(how.alias("x"))

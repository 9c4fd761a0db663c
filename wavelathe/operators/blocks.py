"""Long series over many tasks: blocks of rows in place of one task a series.

A level's series is cut into blocks of equal length by vidx, and work is dealt by
(keys, block). Four forms cover the operators:

* row frames of bounded reach: a block borrows the rows next to it (`windowed`);
* aggregates of the whole series: tasks' partial aggregates are merged and joined
  back (`shared`), or summed over the blocks before a row's own (`running`);
* recurrences whose step is a map that composes with others: a block's map is
  found without knowing what comes before, the maps are applied one after the
  other, one value a block, and each block is run again from its own start
  (`scanned`). Decays (affine maps), state machines (functions of a finite set)
  and cheapest paths (min-plus matrices) are such maps;
* order statistics: a sketch bounds each rank's value, rows below are counted and
  values inside are ranked (`ranked_values`).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..functions.vectors import let
from ..series import Series
from ..storage import written

ROWS = 1 << 16


def numbered(df: DataFrame, s: Series, values: dict[str, str | Column], time: str | Column | None = None, ranges: int | None = None) -> DataFrame:
    """The level of df (as Series.level gives it) without one task a series.

    Rows are sorted in ranges of (keys, order); a row's vidx is its place in its
    range and the rows of its series in the ranges before. Needs the shared
    folder, since a range's rows must be the same when counted and when numbered.
    """
    keys = list(s.keys)
    cols = [F.col(k) for k in keys] + [(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in values.items()]
    if time is not None:
        cols.append((F.col(time) if isinstance(time, str) else time).alias("time"))
    order = [F.col(f"_o{i}") for i in range(len(s.order))]
    rows = df.select(*cols, *[F.col(o).alias(f"_o{i}") for i, o in enumerate(s.order)])
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(ranges, *keys, *order).sortWithinPartitions(*keys, *order).drop(*[f"_o{i}" for i in range(len(s.order))])
    rows = written(rows.withColumn("_at", F.monotonically_increasing_id()), "level").withColumn("_range", F.shiftright("_at", 33))
    aggs = [F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")] + ([F.min("time").alias("_t")] if time is not None else [])
    parts = rows.groupBy(*keys, "_range").agg(*aggs)
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*keys, "_range", "_first", before.alias("_before"), *([F.min("_t").over(w).alias("_t")] if time is not None else []))
    vidx = (F.col("_before") + F.col("_at") - F.col("_first")).cast("long").alias("vidx")
    out = rows.join(parts, [*keys, "_range"])
    return out.select(*keys, vidx, *([(F.col("time") - F.col("_t")).alias("time")] if time is not None else []), *values)


@dataclass(frozen=True)
class Blocks:
    """keys: the columns that name a series of a level; rows: how many of its rows are a block. Rows with a null key are of no series, and left out."""

    keys: tuple[str, ...]
    rows: int = ROWS

    @property
    def by(self) -> list[str]:
        return [*self.keys, "_block"]

    def series(self) -> Series:
        """Each block as a series, for the row-frame expressions of `windows`."""
        return Series(tuple(self.by), ("vidx",))

    def own(self, df: DataFrame) -> DataFrame:
        return df.withColumn("_block", F.floor(F.col("vidx") / self.rows).cast("long"))

    def dealt(self, df: DataFrame) -> DataFrame:
        """own(df), dealt by block into a number of tasks of its own: rows of small numbers are few bytes, and else all would be put into one task."""
        return self.own(df).repartition(_tasks(df), *self.by)

    def windowed(self, df: DataFrame, columns: dict[str, Callable[[Series], Column]], before: int, after: int) -> DataFrame:
        """df with columns of row frames that reach at most so many rows before and after.

        A block gets those rows of its neighbours too, and gives results for its
        own alone. At the ends of a series there is nothing to borrow, so the
        expressions see its edge. vidx must have no gaps.
        """
        first = F.greatest(F.floor((F.col("vidx") - after) / self.rows), F.lit(0)).cast("long")
        last = F.floor((F.col("vidx") + before) / self.rows).cast("long")
        near = df.withColumn("_block", F.explode(F.sequence(first, last))).repartition(_tasks(df), *self.by)
        s = self.series()
        out = near.select("*", *[make(s).alias(n) for n, make in columns.items()])
        return out.where(F.col("_block") == F.floor(F.col("vidx") / self.rows)).drop("_block")

    def shared(self, df: DataFrame, **aggregates: Column) -> DataFrame:
        """df with aggregates of its whole series beside each row. Null and missing keys are alike.

        Each block gets the aggregates for itself, so that no task has a series.
        """
        facts = df.groupBy(*self.keys).agg(*[c.alias(n) for n, c in aggregates.items()], F.max("vidx").alias("_final"))
        facts = facts.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_final") / self.rows).cast("long")))).drop("_final")
        return self.dealt(df).join(facts, self.by).drop("_block")

    def renumbered(self, df: DataFrame) -> DataFrame:
        """df with vidx counted anew, without gaps, in the order of the old one."""
        own = self.dealt(df)
        counts = own.groupBy(*self.by).agg(F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(Window.partitionBy(*self.keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
        counts = counts.select(*self.by, F.coalesce(before, F.lit(0)).alias("_before"))
        place = F.row_number().over(Window.partitionBy(*self.by).orderBy("vidx")) - 1
        return own.join(counts, self.by).withColumn("vidx", (F.col("_before") + place).cast("long")).drop("_block", "_before")

    def held(self, df: DataFrame, name: str, value: Column) -> DataFrame:
        """df with the last value that is not null, of the rows up to each one; null before the first."""
        own = self.dealt(df.withColumn(name, value))
        blocks = own.groupBy(*self.by).agg(F.max(F.when(F.col(name).isNotNull(), F.struct("vidx", name)))[name].alias("_last"))
        w = Window.partitionBy(*self.keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select(*self.by, F.last("_last", ignorenulls=True).over(w).alias("_before"))
        so_far = F.last(name, ignorenulls=True).over(Window.partitionBy(*self.by).orderBy("vidx").rowsBetween(Window.unboundedPreceding, 0))
        return own.join(blocks, self.by).withColumn(name, F.coalesce(so_far, "_before")).drop("_block", "_before")

    def summed(self, df: DataFrame, name: str, value: Column) -> DataFrame:
        """df with the sum of the value over the rows up to each one."""
        own = self.dealt(df.withColumn(name, value))
        w = Window.partitionBy(*self.keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = own.groupBy(*self.by).agg(F.sum(name).alias("_sum")).select(*self.by, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_before"))
        so_far = F.sum(name).over(Window.partitionBy(*self.by).orderBy("vidx").rowsBetween(Window.unboundedPreceding, 0))
        return own.join(blocks, self.by).withColumn(name, so_far + F.col("_before")).drop("_block", "_before")

    def running(self, df: DataFrame, x: str) -> DataFrame:
        """df with _n, _mean, _m2 and _dev: count, mean and sum of squared deviations of x in the rows up to each one, and x less that mean.

        Moments of a block's rows so far are merged with those of the blocks
        before, which are taken about the series' mean so that little cancels.
        """
        own = self.dealt(self.shared(df, _mu=F.avg(x)))
        d = F.col(x) - F.col("_mu")
        blocks = own.groupBy(*self.by).agg(F.count(x).alias("_bn"), F.sum(d).alias("_bs"), F.sum(d * d).alias("_bq"))
        w = Window.partitionBy(*self.keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select(*self.by, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in ("_bn", "_bs", "_bq")])
        so_far = Window.partitionBy(*self.by).orderBy("vidx").rowsBetween(Window.unboundedPreceding, 0)
        out = own.join(blocks, self.by).select(
            *df.columns, "_mu", F.count(x).over(so_far).alias("_an"), F.coalesce(F.avg(d).over(so_far), F.lit(0.0)).alias("_am"),
            (F.coalesce(F.var_pop(d).over(so_far), F.lit(0.0)) * F.count(x).over(so_far)).alias("_aq"), "_bn", "_bs", "_bq",
        )
        n, bn = F.col("_an") + F.col("_bn"), F.when(F.col("_bn") > 0, F.col("_bn"))
        bm = F.coalesce(F.col("_bs") / bn, F.lit(0.0))
        apart = F.col("_am") - bm
        m2 = F.col("_aq") + F.greatest(F.col("_bq") - F.coalesce(F.col("_bs") * F.col("_bs") / bn, F.lit(0.0)), F.lit(0.0)) + apart * apart * F.col("_an") * F.col("_bn") / F.when(n > 0, n)
        middle = (F.col("_am") * F.col("_an") + F.col("_bs")) / F.when(n > 0, n)
        return out.select(*df.columns, n.alias("_n"), (F.col("_mu") + middle).alias("_mean"), m2.alias("_m2"), (d - middle).alias("_dev"))

    def running_mvn(self, df: DataFrame, x: str, floor: float = 1e-7) -> DataFrame:
        """df with <x>_mvn: x less the mean, by the deviation, of the rows so far."""
        sd = F.sqrt(F.greatest(F.col("_m2") / F.col("_n"), F.lit(0.0)))
        return self.running(df, x).withColumn(f"{x}_mvn", F.col("_dev") / F.greatest(sd, F.lit(floor))).drop("_n", "_mean", "_m2", "_dev")

    def frames(self, df: DataFrame, x: str, size: int, step: int | None = None) -> DataFrame:
        """keys, segment, frame: windows of `size` rows, one each `step`, as arrays. A window is made in the block where its first row stands, cut from the block's values; incomplete ones are left out. vidx must have no gaps."""
        step = step or size
        first = F.greatest(F.floor((F.col("vidx") - size + 1) / self.rows), F.lit(0)).cast("long")
        last = F.floor(F.col("vidx") / self.rows).cast("long")
        near = df.select(*self.keys, "vidx", x, F.explode(F.sequence(first, last)).alias("_block"))
        near = near.repartition(_tasks(df), *self.by)
        parts = near.groupBy(*self.by).agg(F.array_sort(F.collect_list(F.struct("vidx", x))).alias("_rows"))
        start = F.col("_block") * self.rows

        def cut(rows: Column) -> Column:
            least = F.ceil(start / step).cast("long")
            most = F.floor(F.least(start + self.rows - 1, start + F.size(rows) - size) / step).cast("long")
            frame = lambda k: F.transform(F.slice(rows, (k * step - start + 1).cast("int"), size), lambda r: r[x])
            return F.transform(F.when(least <= most, F.sequence(least, most)), lambda k: F.struct(k.alias("segment"), frame(k).alias("frame")))

        return parts.select(*self.keys, F.inline(let(F.col("_rows"), cut)))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _kind(df: DataFrame, names, **more) -> StructType:
    return StructType([*[df.schema[n] for n in names], *[StructField(n, t) for n, t in more.items()]])


def scanned(df: DataFrame, b: Blocks, fold: Callable, step: Callable | None, start, replay: Callable, names: list[str], along: Callable | None = None, **made) -> DataFrame:
    """A recurrence along each series, block by block; see the module.

    fold(rows) is a block's map as a flat array, step(state, map) the state
    behind the block from the one ahead of it, replay(rows, state) the block's
    output, in columns `names` of df and `made` (name=type). start is the state
    ahead of the first block, or start(rows of the first block). Rows are a
    pandas frame of the block in vidx order. In place of step, along(maps, start)
    may give the states of all blocks at once, such as ones that depend on what
    follows. Blocks and outputs stay on the executors; one task has one map a
    block of a series.
    """
    keys, by = list(b.keys), b.by
    n = _tasks(df)
    own = b.dealt(df)
    head = callable(start)

    def maps(batches):
        for parts in _groups(batches, by):
            out = [[*key, np.asarray(fold(rows), float), np.asarray(start(rows) if head else start, float)] for key, rows in parts]
            yield pd.DataFrame(out, columns=[*by, "_map", "_start"])

    array = ArrayType(DoubleType())
    folded = own.sortWithinPartitions(*by, "vidx").mapInPandas(maps, _kind(own, by, _map=array, _start=array))

    def forward(maps, state):
        out = []
        for m in maps:
            out.append(state)
            state = np.asarray(step(state, m), float)
        return out

    def states(batches):
        for parts in _groups(batches, keys):
            out = []
            for key, rows in parts:
                got = (along or forward)([np.asarray(m, float) for m in rows["_map"]], np.asarray(rows["_start"].iloc[0], float))
                out += [[*key, block, np.asarray(v, float)] for block, v in zip(rows["_block"], got)]
            yield pd.DataFrame(out, columns=[*by, "_state"])

    starts = folded.repartition(n, *keys).sortWithinPartitions(*keys, "_block").mapInPandas(states, _kind(own, by, _state=array))

    def run(batches):
        for parts in _groups(batches, by):
            yield pd.concat([replay(rows, np.asarray(rows["_state"].iloc[0], float))[[*names, *made]] for _, rows in parts])

    return own.join(starts, by).sortWithinPartitions(*by, "vidx").mapInPandas(run, _kind(own, names, **made))


def _groups(batches, by: list[str]):
    """From batches of sorted rows, one after the other, lists of (key, rows) of the groups that end in each."""
    held, last = [], None
    for pdf in batches:
        if not len(pdf):
            continue
        new = np.zeros(len(pdf), bool)
        for c in by:
            v = pdf[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        edges = [0, *np.flatnonzero(new).tolist(), len(pdf)]
        out = []
        for lo, hi in zip(edges[:-1], edges[1:]):
            key = tuple(pdf[c].iat[lo] for c in by)
            if held and key != last:
                out.append((last, _whole(held)))
                held = []
            held.append(pdf.iloc[lo:hi])
            last = key
        if out:
            yield out
    if held:
        yield [(last, _whole(held))]


def _whole(parts: list[pd.DataFrame]) -> pd.DataFrame:
    return (pd.concat(parts) if len(parts) > 1 else parts[0]).reset_index(drop=True)


# -- Affine maps ----------------------------------------------------------


def decay(x: np.ndarray, pole: float, y: np.ndarray) -> np.ndarray:
    """y[t] = pole y[t-1] + x[t] of the columns of x, from y ahead of its first row: by triangles of 64 rows at a time."""
    n, width = len(x), 64
    k = np.arange(width)
    powers = np.where(k[:, None] >= k, np.power(float(pole), np.maximum(k[:, None] - k, 0)), 0.0)
    full = np.zeros((-(-n // width) * width, x.shape[1]))
    full[:n] = x
    parts = powers @ full.reshape(-1, width, x.shape[1])
    fall = np.power(float(pole), k + 1)[:, None]
    for part in parts:
        part += fall * y
        y = part[-1]
    return parts.reshape(-1, x.shape[1])[:n]


def decayed(df: DataFrame, b: Blocks, columns: list[str], pole: float, gain: float = 1.0, from_first: bool = False, out: str = "decayed") -> DataFrame:
    """df with an array column of y[t] = pole y[t-1] + gain x[t] for each of the columns, which are doubles, or one array of them.

    Ahead of the first row y is 0, or the first row's own x with from_first.
    """
    matrix = lambda rows: np.stack([np.asarray(v, float) for v in rows[columns[0]]]) if isinstance(rows[columns[0]].iloc[0], (list, np.ndarray)) else rows[columns].to_numpy(float)

    def fold(rows):
        x = gain * matrix(rows)
        return np.append(pole ** len(rows), decay(x, pole, np.zeros(x.shape[1]))[-1])

    def replay(rows, state):
        return rows.assign(**{out: decay(gain * matrix(rows), pole, state).tolist()})

    start = (lambda rows: matrix(rows)[0]) if from_first else (lambda rows: np.zeros(matrix(rows).shape[1]))
    return scanned(df, b, fold, lambda y, m: m[0] * y + m[1:], start, replay, df.columns, **{out: ArrayType(DoubleType())})


def exponential_mvn(df: DataFrame, b: Blocks, x: str, alpha: float = 0.995, floor: float = 1e-7) -> DataFrame:
    """df with <x>_mvn: x less its exponentially weighed mean, by its deviation."""
    rows = df.withColumns({"_x": F.col(x).cast("double"), "_q": F.col(x).cast("double") * F.col(x)})
    y = decayed(rows, b, ["_x", "_q"], alpha, 1 - alpha, True, "_y")
    mean = F.col("_y")[0]
    sd = F.sqrt(F.greatest(F.col("_y")[1] - mean * mean, F.lit(0.0)))
    return y.withColumn(f"{x}_mvn", (F.col("_x") - mean) / F.greatest(sd, F.lit(floor))).drop("_x", "_q", "_y")


def rasta(df: DataFrame, b: Blocks, bands: str, numerator: tuple = (0.2, 0.1, 0.0, -0.1, -0.2), pole: float = 0.94, quiet: int = 0, out: str = "rasta") -> DataFrame:
    """df with the RASTA band-pass of an array of log bands along the series: a five-row slope, then a decay. The first `quiet` rows are given as zeros.

    Left of the first row stands the first row again.
    """
    from .windows import shifted

    taps = [(k, c) for k, c in enumerate(numerator) if c]

    def slope(s: Series) -> Column:
        all_ = F.arrays_zip(*[shifted(s, bands, -k).alias(f"t{k}") for k, _ in taps])
        return F.transform(all_, lambda r: sum((c * r[f"t{k}"] for k, c in taps), F.lit(0.0)))

    rows = b.windowed(df, {"_slope": slope}, len(numerator) - 1, 0)
    y = decayed(rows, b, ["_slope"], pole, out=out).drop("_slope")
    return y.withColumn(out, F.when(F.col("vidx") < quiet, F.transform(out, lambda _: F.lit(0.0))).otherwise(F.col(out))) if quiet else y


def rasta_filter(period: float, low: float = 1.0, high: float = 29.0) -> tuple[tuple, float]:
    """Numerator and pole of the band-pass between two frequencies for rows of a period in seconds."""
    turn = math.cos(2 * math.pi * high * period)
    a, c = 2.0, -4.0 * turn
    norm = 2 * sum(k * k for k in (1, 2))  # of a slope over five rows
    return (a / norm, c / norm, 0.0, -c / norm, -a / norm), 1 - math.sin(2 * math.pi * low * period)


# -- Finite state machines ------------------------------------------------


def composed(symbols: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The function of states that the symbols' functions (rows of table) make one after the other, two by two."""
    maps = table[symbols]
    while len(maps) > 1:
        odd = maps[-1:] if len(maps) % 2 else maps[:0]
        maps = np.concatenate([np.take_along_axis(maps[1::2], maps[: len(maps) // 2 * 2 : 2], 1), odd])
    return maps[0] if len(maps) else np.arange(table.shape[1])


def visited(symbols: np.ndarray, table: np.ndarray, state: int) -> np.ndarray:
    """The state behind each symbol."""
    rows, out = table.tolist(), []
    for s in symbols.tolist():
        state = rows[s][state]
        out.append(state)
    return np.array(out, np.int64)


def machine(df: DataFrame, b: Blocks, symbol: Column, table, start: int = 0) -> DataFrame:
    """df with _was and _is, the machine's states ahead of and behind each row; table[symbol][state] is the next state."""
    table = np.asarray(table, np.int64)
    states = table.shape[1]

    def fold(rows):
        return composed(rows["_symbol"].to_numpy(np.int64), table)

    def replay(rows, state):
        is_ = visited(rows["_symbol"].to_numpy(np.int64), table, int(state[0]))
        return rows.assign(_was=np.concatenate([[int(state[0])], is_[:-1]]).astype(np.int64), _is=is_)

    assert table.min() >= 0 and table.max() < states
    rows = df.withColumn("_symbol", symbol.cast("long"))
    return scanned(rows, b, fold, lambda s, m: [m[int(s[0])]], [float(start)], replay, df.columns, _was=LongType(), _is=LongType())


def turns(df: DataFrame, b: Blocks, x: str, on: float, off: float | None = None, pre: int = 2, post: int = 2) -> DataFrame:
    """keys, segment, start, stop (inclusive) of turns, as windows.turns_between gives them, by blocks.

    The machine's states are the rows in a row above `on` (outside a turn, 0 to
    pre) and at or below `off` (inside, 0 to post).
    """
    off = on if off is None else off
    inside = pre + 1
    table = []
    for up, down in ((0, 0), (1, 0), (0, 1)):  # neither, above, below
        outside = [(n + 1 if n < pre else inside) if up else 0 for n in range(pre + 1)]
        within = [(inside + n + 1 if n < post else 0) if down else inside for n in range(post + 1)]
        table.append(outside + within)
    symbol = F.when(F.col(x) > on, 1).when(F.col(x) <= off, 2).otherwise(0)
    # The machine runs once; what follows reads its rows several times.
    rows = written(machine(df.select(*b.keys, "vidx", x), b, symbol, table), "turn-states")
    entered, left = (F.col("_was") < inside) & (F.col("_is") >= inside), (F.col("_was") >= inside) & (F.col("_is") < inside)
    rows = b.held(b.shared(rows, _end=F.max("vidx")), "_start", F.when(entered, F.col("vidx") - pre))
    open_ = (F.col("vidx") == F.col("_end")) & (F.col("_is") >= inside)
    stop = F.when(left, F.col("vidx") - post - 1).when(open_, F.col("vidx") - (F.col("_is") - inside))
    found = rows.where(left | open_).select(*b.keys, "vidx", F.col("_start").alias("start"), stop.alias("stop"))
    return b.renumbered(written(found, "turns")).select(*b.keys, F.col("vidx").alias("segment"), "start", "stop")


def spaced(candidates: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of candidates (ascending places): the number of the next choice behind each, and the last choice if each is one."""
    nxt = np.searchsorted(candidates, candidates + least + 1)
    end = candidates.copy()
    for i in range(len(candidates) - 1, -1, -1):
        if nxt[i] < len(candidates):
            end[i] = end[nxt[i]]
    return nxt, end


def spaced_rows(df: DataFrame, b: Blocks, candidate: Column, least: Column, most: int) -> DataFrame:
    """Rows of df chosen in order: a candidate more than `least` rows behind the last one chosen, the first more than `least` behind place -(least div 2).

    least is the same for all rows of a series and at most `most`, which is below
    the rows of a block. A block's state is how many of its first rows are still
    barred; its map gives that of the next block for each.
    """
    if most >= b.rows:
        raise ValueError("a block must have more rows than the least distance")

    def spots(rows):
        at = rows["vidx"].to_numpy(np.int64)
        return at[rows["_hit"].to_numpy(bool)], int(rows["_block"].iloc[0]) * b.rows, int(rows["_least"].iloc[0])

    def fold(rows):
        hits, first, gap = spots(rows)
        _, end = spaced(hits, gap)
        bars = np.arange(gap + 2)
        entry = np.searchsorted(hits, first + bars)
        out = np.maximum(bars - b.rows, 0)
        some = entry < len(hits)
        out[some] = np.maximum(end[entry[some]] + gap + 1 - (first + b.rows), 0)
        return out

    def replay(rows, state):
        hits, first, gap = spots(rows)
        nxt, _ = spaced(hits, gap)
        i, chosen = int(np.searchsorted(hits, first + int(state[0]))), []
        while i < len(hits):
            chosen.append(hits[i])
            i = int(nxt[i])
        return rows[np.isin(rows["vidx"].to_numpy(np.int64), np.array(chosen, np.int64))]

    def start(rows):
        gap = int(rows["_least"].iloc[0])
        return [gap + 1 - gap // 2]

    rows = df.withColumns({"_hit": F.coalesce(candidate, F.lit(False)), "_least": least.cast("long")})
    return scanned(rows, b, fold, lambda s, m: [m[int(s[0])]], start, replay, df.columns)


# -- Order statistics -----------------------------------------------------


def ranked_values(df: DataFrame, keys: list[str], x: str, at: list[float], accuracy: int = 10_000) -> DataFrame:
    """keys, n and values: for each share p of `at`, x at places floor(p (n - 1)) and the next one, as structs (lo, hi, weight of hi).

    Exact, and no task holds a group: a mergeable sketch gives bounds that enclose
    both places; rows below are counted, and the distinct values between the
    bounds are counted and ranked, about 8 n / accuracy rows a share. Should a
    sketch's bounds miss a place, its share is ranked anew between the group's ends.
    """
    slack = 4.0 / accuracy
    lows, highs = [max(p - slack, 0.0) for p in at], [min(p + slack, 1.0) for p in at]
    rows = df.select(*keys, F.col(x).cast("double").alias("_x")).where("_x is not null")
    sketch = rows.groupBy(*keys).agg(
        F.count("_x").alias("n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"),
        F.percentile_approx("_x", lows, accuracy).alias("_lo"), F.percentile_approx("_x", highs, accuracy).alias("_hi"),
    )
    spots = [F.struct(F.lit(i).alias("i"), F.when(F.lit(p - slack <= 0), F.col("_min")).otherwise(F.col("_lo")[i]).alias("lo"), F.when(F.lit(p + slack >= 1), F.col("_max")).otherwise(F.col("_hi")[i]).alias("hi"), F.floor(p * (F.col("n") - 1)).alias("place")) for i, p in enumerate(at)]
    bounds = written(sketch.select(*keys, "n", "_min", "_max", F.array(*spots).alias("_spots")), "rank-bounds")

    def found(spots: DataFrame) -> DataFrame:
        """keys, i, lo, hi: values at the places; null where the bounds miss one."""
        below = rows.join(spots, keys).select(*keys, "_x", F.explode("_spots").alias("_s")).where("_x <= _s.hi")
        # Rows below the bound count as one value; the others by value.
        held = below.groupBy(*keys, F.col("_s.i").alias("i"), F.col("_s.lo").alias("_lo"), F.col("_s.place").alias("_place"), F.when(F.col("_x") >= F.col("_s.lo"), F.col("_x")).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
        w = Window.partitionBy(*keys, "i").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0)
        ranks = held.select("*", F.sum("_c").over(w).alias("_upto"))
        value = lambda k: F.min(F.when((F.col("_upto") > F.col("_place") + k) & (F.col("_upto") - F.col("_c") <= F.col("_place") + k), F.col("_v")))
        return ranks.groupBy(*keys, "i").agg(value(0).alias("lo"), value(1).alias("hi"), F.first("_place").alias("_place"))

    got = written(found(bounds.select(*keys, "_spots")), "rank-values")
    all_ = bounds.select(*keys, "n", "_min", "_max", F.explode("_spots").alias("_s")).select(*keys, "n", "_min", "_max", F.col("_s.i").alias("i"), F.col("_s.place").alias("_place"))
    joined = all_.join(got.drop("_place"), [*keys, "i"], "left")
    missed = joined.where("lo is null or (hi is null and _place + 1 < n)")
    if not missed.isEmpty():
        again = missed.groupBy(*keys).agg(F.collect_list(F.struct("i", F.col("_min").alias("lo"), F.col("_max").alias("hi"), F.col("_place").alias("place"))).alias("_spots"))
        fixed = found(again).select(*keys, "i", F.col("lo").alias("_l"), F.col("hi").alias("_h"))
        joined = joined.join(fixed, [*keys, "i"], "left").withColumns({"lo": F.coalesce("_l", "lo"), "hi": F.coalesce("_h", "hi")}).drop("_l", "_h")
    share = F.element_at(F.array(*map(F.lit, at)), F.col("i") + 1) * (F.col("n") - 1) - F.col("_place")
    one = F.struct("i", "lo", F.coalesce("hi", "lo").alias("hi"), share.alias("weight"))
    return joined.groupBy(*keys).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(one)).alias("values"))


def percentiles(df: DataFrame, keys: list[str], x: str, at: list[float], interpolated: bool = True) -> DataFrame:
    """keys and values, an array of the percentiles of x: between two places interpolated, or the nearer one (the upper of two as near)."""
    got = ranked_values(df, keys, x, at)
    pick = (lambda v: v["lo"] * (1 - v["weight"]) + v["hi"] * v["weight"]) if interpolated else (lambda v: F.when(v["weight"] >= 0.5, v["hi"]).otherwise(v["lo"]))
    return got.select(*keys, F.transform("values", pick).alias("values"))

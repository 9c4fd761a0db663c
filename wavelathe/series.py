"""What a series is: keys, a total order, and value columns.

A level is a DataFrame with the keys, vidx (0-based place in the series), time
in seconds from the series' start, and value columns (doubles or arrays).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    """keys: the columns that name a series; order: columns of a total order in it."""

    keys: tuple[str, ...]
    order: tuple[str, ...]

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def whole(self) -> WindowSpec:
        return Window.partitionBy(*self.keys)

    def upto(self, rows: int | None = None) -> WindowSpec:
        """The last `rows` rows with the current one, or all so far."""
        return self.ordered().rowsBetween(Window.unboundedPreceding if rows is None else 1 - rows, 0)

    def level(self, df: DataFrame, values: dict[str, str | Column], time: str | Column | None = None) -> DataFrame:
        """The level of df: keys, vidx, time and the named values."""
        w = self.ordered()
        cols = [F.col(k) for k in self.keys] + [(F.row_number().over(w) - 1).cast("long").alias("vidx")]
        if time is not None:
            t = F.col(time) if isinstance(time, str) else time
            cols.append((t - F.min(t).over(self.whole())).alias("time"))
        return df.select(*cols, *[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in values.items()])


def seconds(column: str) -> Column:
    """A timestamp as seconds; without zone, it is read as UTC."""
    return F.unix_micros(F.col(column).cast("timestamp")) / F.lit(1e6)


def of_level(*keys: str) -> Series:
    return Series(keys, ("vidx",))


def with_period(df: DataFrame, period: float) -> DataFrame:
    """df as a level of one row each `period` seconds; 0 marks an aperiodic one. The period is kept with vidx."""
    return df.withColumn("vidx", F.col("vidx").alias("vidx", metadata={"period": float(period)}))


def period_of(df: DataFrame) -> float | None:
    """The level's period, if it was given one."""
    return df.schema["vidx"].metadata.get("period")


def join_periodic(keys: tuple[str, ...], *levels: DataFrame, force: bool = False) -> DataFrame:
    """Rows that all levels have, by keys and vidx, time from the first. Levels of differing known periods are refused unless forced."""
    known = [p for p in map(period_of, levels) if p is not None]
    if not force and known and max(known) - min(known) > 1e-9:
        raise ValueError(f"levels of differing periods: {sorted(set(known))}")
    out = levels[0]
    for other in levels[1:]:
        out = out.join(other.drop("time", "length_sec"), [*keys, "vidx"])
    return with_period(out, known[0]) if known else out

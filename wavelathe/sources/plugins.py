"""Sources of one's own: the Python data source interface, pushed rows, and pictures."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _SignalReader(DataSourceReader):
    def __init__(self, options: dict):
        self.rows, self.parts = int(options.get("rows", 100)), int(options.get("parts", 4))
        self.period, self.frequency = float(options.get("period", 0.01)), float(options.get("frequency", 1.0))

    def partitions(self):
        edges = [self.rows * i // self.parts for i in range(self.parts + 1)]
        return [_Rows(a, b) for a, b in zip(edges, edges[1:]) if a < b]

    def read(self, partition: _Rows):
        for i in range(partition.first, partition.last):
            yield i, i * self.period, math.sin(2 * math.pi * self.frequency * i * self.period)


class SignalSource(DataSource):
    """spark.read.format("wavelathe_signal"): vidx, time, x of a sine; options rows, parts, period, frequency."""

    @classmethod
    def name(cls) -> str:
        return "wavelathe_signal"

    def schema(self) -> str:
        return "vidx long, time double, x double"

    def reader(self, schema):
        return _SignalReader(self.options)


def register(spark: SparkSession, *sources: type[DataSource]) -> None:
    """Make data sources known to the session by their names; without any, the library's own."""
    for s in sources or (SignalSource,):
        spark.dataSource.register(s)


def pushed(spark: SparkSession, frames, fields: dict[str, int], period: float = 0.0) -> DataFrame:
    """Rows that the caller's program holds: each a flat list of numbers, cut into fields of the given sizes (1: a number, more: an array)."""
    rows = []
    for i, frame in enumerate(frames):
        row, at = [i, i * period], 0
        for size in fields.values():
            part = [float(x) for x in frame[at : at + size]]
            row.append(part[0] if size == 1 else part)
            at += size
        rows.append(tuple(row))
    kinds = ", ".join(f"`{n}` {'double' if size == 1 else 'array<double>'}" for n, size in fields.items())
    return spark.createDataFrame(rows, f"vidx long, time double, {kinds}")


def random_rows(spark: SparkSession, rows: int, fields: int = 1, seed: int = 1) -> DataFrame:
    """vidx and fields x0, x1, ... of seeded numbers from 0 to 1."""
    return spark.range(rows).select(F.col("id").alias("vidx"), *[F.rand(seed + k).alias(f"x{k}") for k in range(fields)])


def picture_histograms(pixels: Column, hue_bins: int = 8, saturation_bins: int = 8, value_bins: int = 8) -> Column:
    """struct(hue, saturation, value, lbp): shares of a picture's pixels in equal bins of each, and in the 256 patterns of local brightness.

    pixels is an array of rows of arrays [r, g, b] (0 to 255); null and empty pictures give null.
    """

    @F.pandas_udf("hue array<double>, saturation array<double>, value array<double>, lbp array<double>")
    def run(flat: pd.Series, height: pd.Series) -> pd.DataFrame:
        out = [_histograms(p, h, hue_bins, saturation_bins, value_bins) for p, h in zip(flat, height)]
        return pd.DataFrame(out, columns=["hue", "saturation", "value", "lbp"])

    return run(F.flatten(F.flatten(pixels)), F.size(pixels))


def _histograms(flat, height, hue_bins: int, saturation_bins: int, value_bins: int):
    if flat is None or not len(flat):
        return None, None, None, None
    a = np.asarray(flat, float).reshape(int(height), -1, 3) / 255
    hi, lo = a.max(2), a.min(2)
    span = np.where(hi > lo, hi - lo, 1.0)
    r, g, b = a[..., 0], a[..., 1], a[..., 2]
    hue = np.where(hi == r, ((g - b) / span) % 6, np.where(hi == g, (b - r) / span + 2, (r - g) / span + 4)) / 6
    hue[hi == lo] = 0
    saturation = np.where(hi > 0, (hi - lo) / np.where(hi > 0, hi, 1), 0)
    shares = lambda v, n: (np.bincount(np.minimum((v.ravel() * n).astype(int), n - 1), minlength=n) / v.size).tolist()
    grey = a.mean(2)
    h, w = grey.shape
    if min(h, w) < 3:
        return shares(hue, hue_bins), shares(saturation, saturation_bins), shares(hi, value_bins), [0.0] * 256
    code = np.zeros((h - 2, w - 2), int)
    for k, (dy, dx) in enumerate(((0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (1, 0))):
        code |= (grey[dy : dy + h - 2, dx : dx + w - 2] >= grey[1:-1, 1:-1]).astype(int) << k
    lbp = (np.bincount(code.ravel(), minlength=256) / code.size).tolist()
    return shares(hue, hue_bins), shares(saturation, saturation_bins), shares(hi, value_bins), lbp

"""Live normalisation inside turns: state over two streams, the rows and the turns found in them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .turns import STORE, _milliseconds

_COLUMNS = ["vidx", "_x", "segment", "start", "stop"]


class _Processor(StatefulProcessor):
    def __init__(self, keys, reset, floor, most, forget):
        self.keys, self.reset, self.floor, self.most, self.forget = keys, reset, floor, most, forget

    def init(self, handle):
        self.handle = handle
        self.rows = handle.getListState("rows", "vidx long, x double")
        self.turns = handle.getListState("turns", "start long, stop long, segment long")
        self.moments = handle.getValueState("moments", "n long, mean double, m2 double, gone long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        pdf.columns = [*self.keys, *_COLUMNS]
        new = pdf[pdf["start"].isna()]
        held = sorted([(int(v), float(x)) for v, x in (self.rows.get() if self.rows.exists() else [])] + [(int(v), float(x)) for v, x in zip(new["vidx"], new["_x"])])
        spans = pdf[pdf["start"].notna()]
        turns = sorted([tuple(map(int, t)) for t in (self.turns.get() if self.turns.exists() else [])] + [(int(a), int(b), int(s)) for a, b, s in zip(spans["start"], spans["stop"], spans["segment"])])
        n, mean, m2, gone = self.moments.get() if self.moments.exists() else (0, 0.0, 0.0, 0)
        out, lost = [], 0
        while turns and held and held[-1][0] >= turns[0][1]:
            start, stop, segment = turns.pop(0)
            if self.reset:
                n, mean, m2 = 0, 0.0, 0.0
            for vidx, x in held:
                if start <= vidx <= stop:
                    n += 1
                    d = x - mean
                    mean += d / n
                    m2 += d * (x - mean)
                    out.append((vidx, segment, (x - mean) / max((max(m2, 0.0) / n) ** 0.5, self.floor), 0))
            held = [r for r in held if r[0] > stop]
        if self.most and len(held) > self.most:
            lost = len(held) - self.most
            held = held[lost:]
            out.append((gone + lost, -1, float("nan"), lost))
        self.rows.put(held) if held else self.rows.clear()
        self.turns.put(turns) if turns else self.turns.clear()
        self.moments.update((n, mean, m2, gone + lost))
        if self.forget:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = list(self.rows.get()) if self.rows.exists() else []
        gone = self.moments.get()[3] if self.moments.exists() else 0
        for state in (self.rows, self.turns, self.moments):
            state.clear()
        yield self._frame(key, [(gone + len(held), -1, float("nan"), len(held))] if held else [])

    def _frame(self, key, out) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=["vidx", "segment", "mvn", "lost"])
        for k, v in reversed(list(zip(self.keys, key))):
            pdf.insert(0, k, v)
        return pdf

    def close(self) -> None:
        pass


def live_gated_mvn(rows: DataFrame, turns: DataFrame, keys: list[str], x: str, reset: bool = True, floor: float = 1e-7, most: int = 0, forget: str | None = None) -> DataFrame:
    """keys, vidx, segment, mvn, lost: each row inside a turn less the mean, by the deviation, of the rows of its turn so far (or of all turns so far).

    rows (keys, vidx, x) and turns (keys, segment, start, stop) are streams; a
    turn is given out once its last row is there, and rows wait until their turn
    has ended. Rows outside turns give nothing. At most `most` rows of a key wait
    (0: no limit): beyond that the oldest go, and a row with segment -1 says how
    many (lost) and how many in all (vidx). A key without input for `forget`
    loses its state, and the rows that waited are counted so too.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    none = F.lit(None).cast("long")
    both = rows.select(*keys, "vidx", F.col(x).cast("double").alias("_x"), none.alias("segment"), none.alias("start"), none.alias("stop"))
    both = both.unionByName(turns.select(*keys, none.alias("vidx"), F.lit(None).cast("double").alias("_x"), "segment", "start", "stop"))
    kind = StructType([*[rows.schema[k] for k in keys], StructField("vidx", LongType()), StructField("segment", LongType()), StructField("mvn", DoubleType()), StructField("lost", LongType())])
    wait = _milliseconds(forget)
    return both.groupBy(*keys).transformWithStateInPandas(_Processor(list(keys), reset, floor, most, wait), kind, "append", "processingTime" if wait else "none")

"""The live turn detector, whole: a state machine a key in transformWithState.

Rows of a key are counted as they come; a turn is entered after more than `pre`
rows in a row above `on`, and left after more than `post` at or below `off`.
State is kept by key over batches and restarts, with a timer for keys that fall
silent, a list of turns given beforehand, and commands from a second stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENTS = ["event", "vidx", "segment", "start", "stop", "complete", "forced"]
_FIELDS = ["row", "inside", "start", "above", "below", "active", "up", "down", "force", "since", "blocked", "count", "turns"]


@dataclass(frozen=True)
class TurnRules:
    """Lengths are in rows.

    longest: a turn of more rows ends at its first row without voice, and after
    `grace` more at once (0: no limit). every: an event in a turn at each so many
    rows (0: none), of the last `window` rows at most (0: of the whole turn so
    far). at_end: at a turn's end no event of its span (0), one of the whole
    (1), or of its last `window` rows (2), unless the turn has fewer than
    `least` rows. pre_roll, post_roll: added to the spans' starts and ends.
    first: rows at the front that are taken as silent. calm: rows after an
    unblock that are still silent. status_only: a block holds back status events
    alone. invert: rows at or below the thresholds are the voice.
    """

    on: float
    off: float | None = None
    pre: int = 2
    post: int = 2
    longest: int = 0
    grace: int = 0
    every: int = 0
    window: int = 0
    at_end: int = 1
    least: int = 0
    pre_roll: int = 0
    post_roll: int = 0
    first: int = 0
    calm: int = 60
    status_only: bool = False
    invert: bool = False


class Turns:
    """One key's machine. Events are (event, vidx, segment, start, stop, complete, forced), stop inclusive."""

    def __init__(self, rules: TurnRules, state: tuple | None = None, given: list[tuple[int, int]] = ()):
        self.rules, self.given = rules, list(given)
        for name, v in zip(_FIELDS, state or (-1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0)):
            setattr(self, name, int(v))

    def state(self) -> tuple:
        return tuple(getattr(self, n) for n in _FIELDS)

    def command(self, what: str) -> None:
        """block, or unblock."""
        if what == "block":
            self.blocked = 1
        elif what == "unblock":
            self.blocked, self.count = 0, self.rules.calm

    def _span(self, stop: int, rolled: bool) -> tuple[int, int] | None:
        r = self.rules
        start = self.start + r.pre_roll
        if r.window and (r.at_end == 2 or not rolled) and stop - r.window + 1 > self.start:
            start = stop - r.window + 1
        start, stop = max(start, 0), stop + (r.post_roll if rolled else 0)
        return (start, stop) if stop >= start else None

    def _leave(self, stop: int, complete: int, forced: int) -> list[tuple]:
        out = [("turnEnd", self.row, self.turns, self.start, stop, complete, forced)]
        span = self._span(stop, True)
        if self.rules.at_end and span and stop - self.start + 1 >= self.rules.least:
            out.append(("turnFrameTime", self.row, self.turns, *span, complete, forced))
        self.inside = self.above = self.below = self.force = self.since = 0
        self.turns += 1
        return out

    def end(self, forced: int = 2) -> list[tuple]:
        """The input ends, or has paused too long: an open turn ends with its last voiced row."""
        return self._leave(self.row - self.below, 0, forced) if self.inside else []

    def _given(self) -> list[tuple]:
        out = []
        for start, stop in self.given:
            if start == self.row:
                self.inside, self.start = 1, start
                out.append(("turnStart", self.row, self.turns, start, start, 1, 0))
            if stop == self.row and self.inside:
                self.below = 0
                out += self._leave(stop, 1, 0)
        return out

    def take(self, x: float) -> list[tuple]:
        """The next row."""
        r, out = self.rules, []
        self.row += 1
        if self.given:
            return self._given()
        at = (r.on if r.off is None else r.off) if self.inside else r.on
        voice = x <= at if r.invert else x > at
        ended = False
        if self.inside and r.longest and not self.force:
            length = self.row - self.start
            if (length > r.longest and not voice and r.grace) or length > r.longest + r.grace:
                self.force, ended = 1, True
        held = self.blocked or self.count > 0
        if held and self.count > 0:
            self.count -= 1
        if (held and not r.status_only) or self.force or self.row < r.first:
            voice = False
        if voice:
            self.below = self.down = 0
            if not self.active:
                self.up += 1
                if self.up > 1:
                    self.active, self.up = 1, 0
                    if not held:
                        out.append(("speaking", self.row, self.turns, self.row - 1, self.row - 1, 1, 0))
            if not self.inside:
                self.above += 1
                if self.above > r.pre:
                    self.inside, self.start, self.above, self.below, self.since = 1, self.row - self.above + 1, 0, 0, 0
                    out.append(("turnStart", self.row, self.turns, self.start, self.start, 1, 0))
        else:
            self.above = self.up = 0
            if self.active:
                self.down += 1
                if self.down > 5:
                    self.active = self.down = 0
                    if not held:
                        out.append(("silent", self.row, self.turns, self.row - 2, self.row - 2, 1, 0))
            self.below += 1
            if self.inside and (ended or self.below > r.post):
                out += self._leave(self.row if ended else self.row - r.post - 1, 1, int(ended))
        if self.inside and r.every:
            self.since += 1
            if self.since >= r.every:
                self.since = 0
                span = self._span(self.row, False)
                if span:
                    out.append(("turnFrameTime", self.row, self.turns, *span, 0, 0))
        return out


def turn_events(df: DataFrame, keys: list[str], order: list[str], x: str, rules: TurnRules, control: DataFrame | None = None, preloaded: DataFrame | None = None) -> DataFrame:
    """Batch form: keys and events of each series, which ends with its last row; one task a series.

    control (keys, order columns, command) takes effect ahead of the row of the
    same place; preloaded (keys, start, stop) are given turns, in place of the
    rows' values.
    """
    kind = StructType([*[df.schema[k] for k in keys], *_event_fields()])
    rows = df.select(*keys, *order, F.col(x).cast("double").alias("_x"), F.lit(1).alias("_last"))
    if control is not None:
        rows = rows.unionByName(control.select(*keys, *order, F.lit(None).cast("double").alias("_x"), F.lit(0).alias("_last"), "command"), True)

    def run(machine: Turns, pdf: pd.DataFrame) -> pd.DataFrame:
        out = _taken(machine, pdf, order)
        return _frame(dict(zip(keys, pdf[keys].iloc[0])), out + machine.end(), keys)

    if preloaded is None:
        return rows.groupBy(*keys).applyInPandas(lambda pdf: run(Turns(rules), pdf), kind)

    def both(pdf, spans):
        return run(Turns(rules, given=[tuple(map(int, s)) for s in spans[["start", "stop"]].itertuples(index=False)]), pdf) if len(pdf) else pd.DataFrame([], columns=kind.names)

    return rows.groupBy(*keys).cogroup(preloaded.groupBy(*keys)).applyInPandas(both, kind)


def _event_fields() -> list[StructField]:
    return [StructField("event", StringType()), *[StructField(n, LongType()) for n in EVENTS[1:]]]


def _frame(key: dict, events: list[tuple], keys: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(events, columns=EVENTS)
    for k in reversed(keys):
        out.insert(0, k, key[k])
    return out[[*keys, *EVENTS]]


def _taken(machine: Turns, pdf: pd.DataFrame, order: list[str]) -> list[tuple]:
    """Commands and rows in order; a command stands ahead of the rows of its place."""
    pdf = pdf.sort_values([*order, "_last"], kind="stable")
    commands = pdf["command"] if "command" in pdf else [None] * len(pdf)
    out = []
    for v, c in zip(pdf["_x"], commands):
        if isinstance(c, str):
            machine.command(c)
        else:
            out += machine.take(v)
    return out


class _Processor(StatefulProcessor):
    def __init__(self, keys, order, rules, silence, forget):
        self.keys, self.order, self.rules, self.silence, self.forget = keys, order, rules, silence, forget

    def init(self, handle):
        self.handle = handle
        kind = ", ".join(f"{n} long" for n in _FIELDS)
        self.machine = handle.getValueState("machine", kind, self.forget)
        self.given = handle.getListState("given", "start long, stop long")

    def _load(self) -> Turns:
        return Turns(self.rules, self.machine.get() if self.machine.exists() else None, [(int(a), int(b)) for a, b in self.given.get()] if self.given.exists() else [])

    def _set_timer(self, now: int) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.silence:
            self.handle.registerTimer(now + self.silence)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        pdf.columns = [*self.keys, *self.order, "_x", "_last", "command", "_end"]  # Spark renames those that begin with an underscore
        machine = self._load()
        out = _taken(machine, pdf, self.order)
        if pdf["_end"].fillna(False).any():
            out += machine.end()
        self.machine.update(machine.state())
        if self.silence:
            self._set_timer(timerValues.getCurrentProcessingTimeInMs())
        yield _frame(dict(zip(self.keys, key)), out, self.keys)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        machine = self._load()
        out = machine.end()
        self.machine.update(machine.state())
        yield _frame(dict(zip(self.keys, key)), out, self.keys)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        for a, b in initialState[["start", "stop"]].itertuples(index=False):
            self.given.appendValue((int(a), int(b)))

    def close(self) -> None:
        pass


def _milliseconds(text: str | None) -> int | None:
    return None if text is None else int(pd.Timedelta(text).total_seconds() * 1000)


def live_turn_events(stream: DataFrame, keys: list[str], order: list[str], x: str, rules: TurnRules, control: DataFrame | None = None, preloaded: DataFrame | None = None, timeout: str | None = None, end: str | None = None, forget: str | None = None) -> DataFrame:
    """Events as they come about, of the rules' machine, with state in RocksDB.

    control is a stream (keys, order columns, command: block or unblock), sorted
    in with the rows of its batch. preloaded is a table (keys, start, stop) of
    turns that stand in place of the rows' values. A key without rows for
    `timeout` has its open turn ended; its count of rows and turns goes on, so
    that a key that comes back has no second segment 0. A true `end` column marks
    a key's last row. `forget` drops a key's state that long after its last row.
    Rows of a key must come in order from batch to batch.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = stream.select(*keys, *order, F.col(x).cast("double").alias("_x"), F.lit(1).alias("_last"), F.lit(None).cast("string").alias("command"), (F.col(end) if end else F.lit(False)).alias("_end"))
    if control is not None:
        rows = rows.unionByName(control.select(*keys, *order, F.lit(None).cast("double").alias("_x"), F.lit(0).alias("_last"), "command", F.lit(False).alias("_end")))
    kind = StructType([*[stream.schema[k] for k in keys], *_event_fields()])
    silence = _milliseconds(timeout)
    given = preloaded.select(*keys, "start", "stop").groupBy(*keys) if preloaded is not None else None
    return rows.groupBy(*keys).transformWithStateInPandas(
        _Processor(list(keys), list(order), rules, silence, _milliseconds(forget)), kind, "append", "processingTime" if silence or forget else "none", given
    )

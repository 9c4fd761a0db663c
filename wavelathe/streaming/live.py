"""Live input: Structured Streaming forms of windows, sessions, turns and adaptive normalisation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(stream: DataFrame, time: str, key: str, x: str, size: str = "1 hour", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Aggregates of event-time windows; rows later than the watermark are dropped."""
    w = F.window("_t", size, slide) if slide else F.window("_t", size)
    return stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("amean"), F.max(x).alias("max"), F.min(x).alias("min")).select(key, F.col("w.start").alias("start"), "n", "amean", "max", "min")


def live_sessions(stream: DataFrame, time: str, key: str, x: str, gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    s = stream.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return s.groupBy(key, F.session_window("_t", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("amean")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n", "amean")


def live_turns(stream: DataFrame, key: str, order: str, x: str, on: float, off: float | None = None, pre: int = 2, post: int = 2, longest: int = 0, timeout: str | None = None, end: str | None = None) -> DataFrame:
    """Turns as they end; the state of a key is its row number and four counters.

    longest ends a turn after so many rows. A key without rows for `timeout`
    (processing time, such as `10 minutes`) has its open turn ended. A true
    `end` column marks a key's last row, which ends its open turn too. A key that
    comes back goes on with its numbers of rows and turns, which stay in the
    state; `turns.live_turn_events` can forget them after a time.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    low = on if off is None else off
    milliseconds = None if timeout is None else int(pd.Timedelta(timeout).total_seconds() * 1000)

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        i, start, above, below, done = state.get if state.exists else (0, -1, 0, 0, 0)
        out = []
        if state.hasTimedOut:
            if start >= 0:
                out.append((k[0], done, start, i - 1 - below))
                done += 1
            state.update((i, -1, 0, 0, done))
            yield pd.DataFrame(out, columns=[key, "segment", "start", "stop"])
            return
        pdf = pd.concat(list(batches)).sort_values(order, kind="stable")
        over = False
        for v, last in zip(pdf[x], pdf[end] if end else [False] * len(pdf)):
            if start < 0:
                above = above + 1 if v > on else 0
                if above > pre:
                    start, below = i - above + 1, 0
            else:
                below = below + 1 if v <= low else 0
                if below > post:
                    out.append((k[0], done, start, i - below))
                    start, above, done = -1, 0, done + 1
                elif longest and i - start + 1 >= longest:
                    out.append((k[0], done, start, i))
                    start, above, done = -1, 0, done + 1
            i += 1
            over = over or bool(last)
        if over:
            if start >= 0:
                out.append((k[0], done, start, i - 1 - below))
                done += 1
            state.update((i, -1, 0, 0, done))
        else:
            state.update((i, start, above, below, done))
            if milliseconds is not None:
                state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame(out, columns=[key, "segment", "start", "stop"])

    kind = stream.select(key).schema.simpleString()[7:-1].replace(":", " ")
    how = GroupStateTimeout.NoTimeout if timeout is None else GroupStateTimeout.ProcessingTimeTimeout
    return stream.groupBy(key).applyInPandasWithState(run, f"{kind}, segment long, start long, stop long", "i long, start long, above long, below long, done long", "append", how)


def live_mvn(stream: DataFrame, key: str, order: str, x: str, floor: float = 1e-7, timeout: str | None = None) -> DataFrame:
    """Each row less the mean, by the deviation, of its key's rows so far. A key without rows for `timeout` loses its state, and begins anew."""
    milliseconds = None if timeout is None else int(pd.Timedelta(timeout).total_seconds() * 1000)

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [], order: [], f"{x}_mvn": []})
            return
        n, mean, m2 = state.get if state.exists else (0, 0.0, 0.0)
        pdf, out = pd.concat(list(batches)).sort_values(order, kind="stable"), []
        for v in pdf[x]:
            n += 1
            d = v - mean
            mean += d / n
            m2 += d * (v - mean)
            out.append((v - mean) / max((m2 / n) ** 0.5, floor))
        state.update((n, mean, m2))
        if milliseconds is not None:
            state.setTimeoutDuration(milliseconds)
        yield pd.DataFrame({key: k[0], order: pdf[order], f"{x}_mvn": out})

    kind = stream.select(key, order).schema.simpleString()[7:-1].replace(":", " ")
    return stream.groupBy(key).applyInPandasWithState(run, f"{kind}, {x}_mvn double", "n long, mean double, m2 double", "append", "NoTimeout" if timeout is None else "ProcessingTimeTimeout")


def to_sink(stream: DataFrame, write, name: str, checkpoint: str, mode: str = "append", once: bool = True):
    """A query that hands each micro-batch to write(df, batch number): the caller's callback, or another system's writer."""
    w = stream.writeStream.outputMode(mode).queryName(name).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (w.trigger(availableNow=True) if once else w).start()


def forwarded(stream: DataFrame, send, name: str, checkpoint: str, once: bool = True):
    """A query that sends each event row as one JSON text: send(list of texts) is called for each partition on its executor."""

    def write(df: DataFrame, number: int) -> None:
        texts = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
        texts.foreachPartition(lambda rows: send([r["value"] for r in rows]))

    return to_sink(stream, write, name, checkpoint, once=once)


def run_until(query, seconds: float = 60.0, rows: int | None = None) -> int:
    """Let a streaming query run until it ends, the time is over, or its sources have given so many rows; then stop it. The number of rows seen."""
    import time

    until, seen, last = time.monotonic() + seconds, 0, -1
    while query.isActive and time.monotonic() < until and (rows is None or seen < rows):
        query.awaitTermination(0.2)
        for p in query.recentProgress:
            if p["batchId"] > last:
                last, seen = p["batchId"], seen + p["numInputRows"]
    for p in query.recentProgress:
        if p["batchId"] > last:
            last, seen = p["batchId"], seen + p["numInputRows"]
    if query.isActive:
        query.stop()
    return seen


def bounded(stream: DataFrame, time: str, late: str = "1 hour") -> DataFrame:
    """The stream with a watermark: aggregates and joins over it drop rows later than that, and say how many in the query's progress. `gated.live_gated_mvn` bounds what waits by its number, and gives the losses out."""
    return stream.withWatermark(time, late)


def messages(df: DataFrame, x: str, test: str, value: float, name: str) -> DataFrame:
    """An event row in JSON for each row that passes the test (eq, gteq, gt, leeq, le)."""
    c = F.col(x)
    hit = {"eq": c == value, "gteq": c >= value, "gt": c > value, "leeq": c <= value, "le": c < value}[test]
    return df.where(hit).select(F.to_json(F.struct(F.lit(name).alias("msgname"), *df.columns)).alias("message"))

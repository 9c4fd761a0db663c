"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of token ids, its documents end to end. A mixing window
is a run of `run` sequences; window after window, the queues take turns to fill
it, each with its share of the window's tokens. What a queue has given beyond
or short of its share is its deficit, which carries over: its k-th token is due
when its share has come to k - 1/2 tokens, and tokens go out in the order in
which they fall due, ties by queue. So after any number of windows a queue has
given its share to within half a token and the half token of each queue that
the window's end may hold back. What has gone out before a window follows from
the window's number alone, so any partition can compute it for any window, and
deficits carry across windows and partitions without a chain of tasks. A queue
of less than a token a window is served in the window where its token falls
due. In a window the queues follow each other, so a document is cut only where
a sequence or a queue's turn ends, and every sequence but the last is full.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import documents, give_back, no_collector, prepare, small, text_of, written


@dataclass(frozen=True)
class Plan:
    """totals: tokens of each queue, each above 0."""

    totals: tuple[int, ...]
    length: int = 4096
    run: int = 16

    @property
    def window(self) -> int:
        return self.length * self.run

    def given(self, w: int) -> tuple[int, ...]:
        """Tokens that each queue has given before window w."""
        return _given(self.totals, w * self.window)

    def window_of(self, queue: int, k: int) -> int:
        """The window that takes the queue's token k (from 0): the last before which the queue has given k tokens at most."""
        total = sum(self.totals)
        windows = -(-total // self.window)
        low, step = k * total // (self.totals[queue] * self.window), 1
        while low > 0 and self.given(low)[queue] > k:
            low, step = max(low - step, 0), 2 * step
        high, step = low + 1, 1
        while high < windows and self.given(high)[queue] <= k:
            low, high, step = high, high + step, 2 * step
        high = min(high, windows)
        while low < high - 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.given(middle)[queue] <= k else (low, middle)
        return low

    def pieces(self, queue: int, start: int, stop: int):
        """(place in the queue, tokens, sequence, offset) of the queue's tokens start..stop-1."""
        w, then = -1, (start,) * (queue + 1)
        while start < stop:
            if then[queue] <= start:
                w = self.window_of(queue, start)
                now, then = self.given(w), self.given(w + 1)
            at = sum(b - a for a, b in zip(now[:queue], then[:queue])) + start - now[queue]
            n = min(then[queue] - start, stop - start, self.length - at % self.length)
            yield start, n, w * self.run + at // self.length, at % self.length
            start += n


@lru_cache(maxsize=1 << 14)
def _given(totals: tuple[int, ...], tokens: int) -> tuple[int, ...]:
    """How the first `tokens` tokens due divide over the queues. Token k of a queue is due at (2k - 1) / (2 * its total) of the whole."""
    whole = sum(totals)
    tokens = min(tokens, whole)
    out = [(2 * tokens * t + whole) // (2 * whole) for t in totals]
    over = sum(out) - tokens
    # Take back the last due, or add the next due; a queue that is done has none.
    step = 1 if over < 0 else -1
    key = lambda i: (step * Fraction(2 * out[i] + step, totals[i]), step * i, i)
    heap = [key(i) for i, n in enumerate(out) if (n < totals[i] if step > 0 else n)]
    heapq.heapify(heap)
    for _ in range(abs(over)):
        i = heapq.heappop(heap)[2]
        out[i] += step
        if out[i] < totals[i] if step > 0 else out[i]:
            heapq.heappush(heap, key(i))
    return tuple(out)


def queues(totals: dict[str, int], length: int, run: int) -> tuple[Plan, dict[str, int]]:
    """The plan, and the queue of each source."""
    names = sorted(totals)
    return Plan(tuple(totals[n] for n in names), length, run), {n: i for i, n in enumerate(names)}


def tokenized(docs: DataFrame, vocabulary: str, end_id: int, vocabulary_path: str | None = None) -> DataFrame:
    """(part, queue, start, doc_id, n, ids): documents where they stand, start counted in the part's own queue.

    A null source is a queue of its own; a null or empty text has the end id alone.
    """
    spark = prepare(docs.sparkSession)
    source = F.coalesce(F.concat(F.lit("s"), docs["source"]), F.lit("n"))

    def encode(batches):
        from pyspark import TaskContext

        enc = encoder(vocabulary, vocabulary_path)
        end, part, at = np.array([end_id], enc.dtype).tobytes(), TaskContext.get().partitionId(), {}
        for pdf in batches:
            with no_collector():
                ids = [enc.encode(t) + end for t in pdf["text"]]
            n = [len(x) // enc.dtype.itemsize for x in ids]
            start = []
            for q, k in zip(pdf["queue"], n):
                start.append(at.get(q, 0))
                at[q] = start[-1] + k
            yield pd.DataFrame({"part": part, "queue": pdf["queue"], "start": start, "doc_id": pdf["doc_id"].astype("Int64"), "n": n, "wide": enc.dtype.itemsize, "ids": ids})
        give_back()

    rows = docs.select("doc_id", source.alias("queue"), text_of(docs).alias("text"))
    made = rows.mapInPandas(encode, "part int, queue string, start long, doc_id long, n long, wide int, ids binary")
    return written(made, "packing-ids")


def packed(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, length: int = 4096, run: int = 16, ids: bool = False, vocabulary_path: str | None = None) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with ids=True the ids.

    Sequences hold `length` tokens; the last may hold fewer and is padded. The
    number of sources is taken to be small enough for the driver. Repeated rows
    and null ids are documents each; columns other than doc_id, source and text
    are ignored; no documents give no pieces.
    """
    rows = tokenized(docs, vocabulary, end_id, vocabulary_path)
    per_part = rows.groupBy("queue", "part").agg(F.sum("n").alias("n"))
    totals = {r["queue"]: r["n"] for r in per_part.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    plan, places = queues(totals, length, run)
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def cut(batches):
        for pdf in batches:
            out = []
            for queue, base, start, doc_id, n, wide, raw in zip(pdf["queue"], pdf["base"], pdf["start"], pdf["doc_id"].astype("Int64"), pdf["n"], pdf["wide"], pdf["ids"]):
                q, first = places[queue], int(base) + int(start)
                own = np.frombuffer(raw, f"<u{wide}").astype("<u4")
                for at, k, seq, offset in plan.pieces(q, first, first + int(n)):
                    piece = own[at - first : at - first + k]
                    out.append((doc_id, at - first, k, zlib.crc32(piece.tobytes()), n, seq, offset, *([piece.tolist()] if ids else [])))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if ids else [])]
            frame = pd.DataFrame(out, columns=names)
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    kind = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * ids
    return rows.join(small(bases), ["queue", "part"]).mapInPandas(cut, kind)


def op5_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))

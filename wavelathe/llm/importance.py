"""Importance resampling towards a target distribution, by word tries.

A task walks the words of its texts down a trie: a node is a run of words, and
holds how often the run occurred and the CRC state of its bytes, from which a
child's state follows. A full trie is summed into buckets and begun anew, so a
task's memory is bounded; the bucket totals of all tasks are added up by Spark.
A second pass walks the same paths with the buckets' gains attached and gives
each document its mean gain, and Gumbel noise of its id makes the draw of the
highest scores a sample by importance. The draw's order is a range sort with
counts of its parts, so no task holds more than its share.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, frugal, numbered, prepare, text_of, written
from .texthash import pieces

BUCKETS = 10_000
NODES = 200_000  # of a trie before it is summed up
#: Digits, letters (A-Z become a-z) and all bytes beyond ASCII stay; the others part words.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


class Node(dict):
    """A run of words: its children by their last word, its CRC state, and a count or a gain."""

    __slots__ = ("crc", "value", "trie")

    def __init__(self, trie: Trie, crc: int | None):
        super().__init__()
        self.trie, self.crc, self.value = trie, crc, 0

    def __missing__(self, word: bytes) -> Node:
        crc = zlib.crc32(word) if self.crc is None else zlib.crc32(word, zlib.crc32(b" ", self.crc))
        child = self[word] = Node(self.trie, crc)
        child.value = self.trie.first_value(crc)
        self.trie.nodes += 1
        return child


class Trie:
    """Runs of up to `longest` words. With gains (of buckets), nodes begin with their gain; else with a count of 0."""

    def __init__(self, longest: int = 1, gains: list[int] | None = None):
        self.longest, self.gains = longest, gains
        self.clear()

    def clear(self) -> None:
        self.root, self.nodes = Node(self, None), 0

    def first_value(self, crc: int) -> int:
        return 0 if self.gains is None else self.gains[crc % len(self.gains)]

    def add(self, words: list[bytes], fresh: int = 0) -> None:
        """Count all runs of the words but those that end before word `fresh`."""
        root, longest = self.root, self.longest
        if longest == 1:
            for w in words[fresh:]:
                root[w].value += 1
            return
        for i in range(len(words)):
            node = root
            for j in range(i, min(i + longest, len(words))):
                node = node[words[j]]
                if j >= fresh:
                    node.value += 1

    def gain(self, words: list[bytes], fresh: int = 0) -> tuple[int, int]:
        """The gains' sum and the number of the runs that add() would count."""
        root, longest = self.root, self.longest
        if longest == 1:
            own = words[fresh:]
            return sum([root[w].value for w in own]), len(own)
        total = number = 0
        for i in range(len(words)):
            node = root
            for j in range(i, min(i + longest, len(words))):
                node = node[words[j]]
                if j >= fresh:
                    total, number = total + node.value, number + 1
        return total, number

    def totals(self, buckets: int) -> np.ndarray:
        """The counts of all nodes by bucket."""
        crcs, counts, open_ = [], [], [self.root]
        while open_:
            for child in open_.pop().values():
                crcs.append(child.crc)
                counts.append(child.value)
                if child:
                    open_.append(child)
        out = np.zeros(buckets, np.int64)
        np.add.at(out, np.array(crcs, np.int64) % buckets, np.array(counts, np.int64))
        return out


def parts_of(raw: bytes, longest: int):
    """Yield (words, number of words carried over): a long text in parts, each begun with the last words of the one before."""
    carried: list[bytes] = []
    for piece in pieces(raw):
        words = carried + piece.translate(_WORD_BYTES).split()
        yield words, len(carried)
        carried = words[len(words) - longest + 1 :] if 1 < longest <= len(words) else words if longest > 1 else []


def bucket_totals(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket. Null texts have none; no texts give zeros. The driver gets one row a bucket."""

    @frugal
    def count(batches):
        trie, total = Trie(longest), np.zeros(buckets, np.int64)
        for pdf in batches:
            for raw in pdf["text"]:
                for words, carried in parts_of(raw, longest):
                    trie.add(words, carried)
                    if trie.nodes > NODES:
                        total += trie.totals(buckets)
                        trie.clear()
        total += trie.totals(buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    rows = texts.select(text_of(texts).cast("binary").alias("text")).mapInPandas(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """1000 times the log of each bucket's share in the target by that in the corpus, one added to each count, rounded down."""
    size, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return [math.floor(1000 * math.log((t + 1) * (s_all + size) / ((s + 1) * (t_all + size)))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist())]


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise of an id in thousandths, rounded down; a null id is an empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: list[int], longest: int = 1, seed: int = 2024) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and tie (the text's hash) of every row."""
    given = docs.sparkSession.sparkContext.broadcast(gains)  # one number a bucket

    @frugal
    def score(batches):
        trie = Trie(longest, given.value)
        for pdf in batches:
            out = []
            for doc_id, raw in zip(pdf["doc_id"], pdf["text"]):
                total = number = n_words = 0
                for words, carried in parts_of(raw, longest):
                    t, n = trie.gain(words, carried)
                    total, number, n_words = total + t, number + n, n_words + len(words) - carried
                    if trie.nodes > NODES:
                        trie.clear()
                weight = total // number if number else 0
                out.append((n_words, number, weight, weight + noise(seed, None if pd.isna(doc_id) else int(doc_id))))
            columns = pd.DataFrame(out, columns=["n_words", "n_features", "weight", "score"])
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "tie": pdf["tie"]}).reset_index(drop=True).join(columns)

    # A nullable id comes to pandas as a decimal, so that a long keeps all its digits.
    rows = docs.select(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), F.xxhash64(text_of(docs)).alias("tie"), text_of(docs).cast("binary").alias("text"))
    return rows.mapInPandas(score, "doc_id long, tie long, n_words long, n_features long, weight long, score long")


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank is null for rows that are not drawn.

    docs has doc_id and text, target has text; other columns are not read. Null
    and empty texts have no feature and weight 0, and take part only where
    least_words is 0. Repeated rows count, and may be drawn, each. Of equal
    scores the smaller doc_id is first (null ids last), then the smaller hash of
    the text; rows alike in all that stand in any order. No docs give no rows; an
    empty target makes all gains those of a target without features.
    """
    prepare(docs.sparkSession)
    gains = bucket_gains(bucket_totals(docs, longest, buckets), bucket_totals(target, longest, buckets))
    rows = written(scored(docs, gains, longest, seed), "importance-scores")
    part = rows.where(F.col("n_words") >= least_words)
    drawn = part.count() * percent // 100
    placed = numbered(part, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")], "rank", "importance-order")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))

"""Exact top-k search by inner product with pivot-table elimination.

Vectors of whole numbers lie in Euclidean space, where x.q = (x.x + q.q -
d(x, q)**2) / 2. A table holds every vector's distances to a set of pivots; the
triangle inequality makes the largest difference of two rows of the table a
lower bound of their distance, and so gives an upper bound of the inner
product. A query meets the candidates of a block in the order of that bound
and stops, exactly, when the bound falls below its k-th score so far.

Vectors stay where they are: queries come to them in blocks of bounded size,
one job a block, and a task carries each query's k best from block of vectors
to block of vectors. Only these, k a query and task, are shuffled.
"""

from __future__ import annotations

import heapq
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import drop, let_go, prepare, table_path, written

PIVOTS = 32
BLOCK = 4096  # candidates of a block
QUERIES = 16384  # queries of a block at most,
QUERY_VALUES = 1 << 22  # and their components
_STEP = 256  # candidates evaluated at a time
_EXACT = 2.0**52  # sums of whole doubles below it are exact
_END = Decimal(1 << 63)
_KEY = "query_id long, vec_id long, key string"


def whole_vectors(rows: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v): components as floor(scale * x), x as double, in doubles (which hold such numbers exactly).

    Left out: null ids, null or empty vectors, and vectors with a null or
    non-finite component (x or scale * x). scale is a power of two.
    """
    rows = rows.select("vec_id", F.transform("embedding", lambda c: c.cast("double") * scale).alias("x")).where("vec_id is not null and x is not null and size(x) > 0")
    good = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # From 2**52 on a double has no fraction.
    whole = F.transform("x", lambda c: F.when(F.abs(c) < _EXACT, F.floor(c).cast("double")).otherwise(c))
    return rows.where(good).select("vec_id", whole.alias("v"))


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Up to count rows of the sample, each farthest from those before it."""
    if not len(sample):
        return sample
    got, gap = [0], np.full(len(sample), np.inf)
    while len(got) < min(count, len(sample)):
        gap = np.minimum(gap, np.linalg.norm(sample - sample[got[-1]], axis=1))
        if not gap.max():
            break
        got.append(int(gap.argmax()))
    return sample[got]


def _distances(a: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * a @ pivots.T, 0))


def _scores(rows: np.ndarray, query: np.ndarray, most: float) -> list[int]:
    """Exact inner products; most bounds the sums of their terms' sizes."""
    if most < _EXACT:
        return (rows @ query).astype(np.int64).tolist()
    q = [int(x) for x in query]
    return [sum(int(a) * b for a, b in zip(r, q)) for r in rows]


class Search:
    """Queries of one length, their k best so far, and the pivots."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, pivots: np.ndarray, k: int):
        self.ids, self.queries, self.pivots, self.k = query_ids, queries, pivots, k
        with np.errstate(over="ignore", invalid="ignore"):
            self.table, self.squares = _distances(queries, pivots), (queries * queries).sum(1)
        self.sizes = np.abs(queries).max(1)
        self.best: list[list[tuple[int, int]]] = [[] for _ in query_ids]  # (-score, vec_id), ascending

    def block(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Let all queries meet a block of vectors."""
        with np.errstate(over="ignore", invalid="ignore"):
            table, squares = _distances(vectors, self.pivots), (vectors * vectors).sum(1)
        size = np.abs(vectors).max() * vectors.shape[1]
        for i, query in enumerate(self.queries):
            best = self.best[i]
            with np.errstate(over="ignore", invalid="ignore"):
                low = np.abs(table - self.table[i]).max(1)
                both = squares + self.squares[i]
                # For rounding the bound of the distance is a little less, and that of the score a little more.
                low = np.maximum(low - 1e-7 * np.sqrt(both) - 1e-3, 0)
                most = (both - low * low) / 2 + 1e-9 * both + 1
            most[np.isnan(most)] = np.inf
            most[ids == self.ids[i]] = -np.inf
            seq = np.flatnonzero(most >= -best[-1][0]) if len(best) >= self.k else np.flatnonzero(most > -np.inf)
            seq = seq[np.argsort(-most[seq], kind="stable")]
            for at in range(0, len(seq), _STEP):
                part = seq[at : at + _STEP]
                if len(best) >= self.k and most[part[0]] < -best[-1][0]:
                    break
                new = zip((-s for s in _scores(vectors[part], query, float(size * self.sizes[i]))), ids[part].tolist())
                if len(best) >= self.k:
                    last = best[-1]
                    new = [x for x in new if x < last]
                best = heapq.nsmallest(self.k, [*best, *new])
            self.best[i] = best

    def found(self):
        for q, best in zip(self.ids.tolist(), self.best):
            for s, v in best:
                yield q, v, -s


_NINES = str.maketrans("0123456789", "9876543210")


def order_key(score: int) -> str:
    """A text that sorts as the whole number does, however long."""
    d = str(abs(score))
    return f"1{len(d):04d}{d}" if score >= 0 else f"0{9999 - len(d):04d}{d.translate(_NINES)}"


def _as_long(key: Column) -> Column:
    """The number of an order_key, or the end of a long that it lies beyond."""
    up, d = F.substring(key, 1, 1) == "1", F.substring(key, 6, 9999)
    d = F.when(up, d).otherwise(F.translate(d, "0123456789", "9876543210"))
    size = F.coalesce(F.when(F.length(d) < 30, d).cast("decimal(30,0)"), F.lit(_END))
    return F.when(up, F.least(size, F.lit(_END - 1))).otherwise(-F.least(size, F.lit(_END))).cast("long")


def _query_blocks(queries: DataFrame):
    """Blocks {length: (ids, matrix)} of bounded size, streamed from a written table."""
    held, values, rows = {}, 0, 0
    for r in queries.toLocalIterator():
        held.setdefault(len(r["v"]), []).append((r["query_id"], r["v"]))
        values, rows = values + len(r["v"]), rows + 1
        if rows >= QUERIES or values >= QUERY_VALUES:
            yield held
            held, values, rows = {}, 0, 0
    if held:
        yield held


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, pivots: int = PIVOTS, sample: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries (query_id, v) against vectors (vec_id, v).

    A query's own row is no candidate. Vectors meet only queries of their own
    length. Fewer candidates than k give fewer rows; no vectors or queries, none.
    Repeated vectors are candidates each. An id that asks more than once asks
    once, with the least of its vectors in array order. Scores are exact, and
    ranked so; those beyond a long are given as its end. Pivots come from a
    bounded sample of the vectors; they decide how much is skipped, never the
    result.
    """
    spark = prepare(vectors.sparkSession)
    vectors, queries = written(vectors, "topk-vectors"), written(queries.groupBy("query_id").agg(F.min("v").alias("v")), "topk-queries")
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    by_len: dict[int, list] = {}
    for r in picked:
        by_len.setdefault(len(r["v"]), []).append(r["v"])
    chosen = {n: choose_pivots(np.array(v, np.float64), pivots) for n, v in by_len.items()}
    path = table_path(spark, "topk-found")
    spark.createDataFrame([], _KEY).write.parquet(path)
    for held in _query_blocks(queries):
        block = spark.sparkContext.broadcast({n: (np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows], np.float64)) for n, rows in held.items()})

        def search(batches, block=block):
            let_go()
            running, waiting = {}, {}

            def meet(n):
                ids, rows = zip(*waiting.pop(n))
                x = np.stack(rows)
                if n not in running:
                    running[n] = Search(*block.value[n], chosen.get(n, x[:1]), k)
                running[n].block(np.array(ids, np.int64), x)

            for pdf in batches:
                for i, v in zip(pdf["vec_id"], pdf["v"]):
                    if len(v) in block.value:
                        part = waiting.setdefault(len(v), [])
                        part.append((i, v))
                        if len(part) >= BLOCK:
                            meet(len(v))
            for n in list(waiting):
                meet(n)
            out = [(q, v, order_key(s)) for r in running.values() for q, v, s in r.found()]
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "key"])

        vectors.mapInPandas(search, _KEY).write.mode("append").parquet(path)
        block.unpersist()
    drop(vectors, queries)
    found = spark.read.schema(_KEY).parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("key"), "vec_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", _as_long(F.col("key")).alias("score"))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    v = whole_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(v, v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"))

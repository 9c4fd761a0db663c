"""Mixing sources to target weights by the cube method of balanced sampling.

A source that is to give m times its words takes every document floor(m) times
for certain, and once more with the inclusion probability m - floor(m). The
flight moves these probabilities along vectors that leave the number of
documents and of words as they are, until each is 0 or 1. It runs in chunks of
a source; a chunk leaves two documents at most undecided, and those of many
chunks fly again together, until so few are left in a source that the landing
chooses the rounding whose words come nearest.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns_of, documents, prepare, written

CHUNK = 2000  # documents that fly together
_EPS = 1e-9


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities after the flight: sums of p and of p * size stay, at most two are not 0 or 1."""
    p = p.astype(float).copy()
    live = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    draws = iter(rng.random(len(live) + 3))
    hand, rest = live[:3], iter(live[3:])
    while len(hand) == 3:
        a, b, c = hand
        u = (float(size[c] - size[b]), float(size[a] - size[c]), float(size[b] - size[a]))
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[i]) / x if x > 0 else -p[i] / x) for i, x in zip(hand, u) if x)
        down = min((p[i] / x if x > 0 else (p[i] - 1) / x) for i, x in zip(hand, u) if x)
        step = up if next(draws) * (up + down) < down else -down
        keep = []
        for i, x in zip(hand, u):
            p[i] += step * x
            if p[i] < _EPS:
                p[i] = 0.0
            elif p[i] > 1 - _EPS:
                p[i] = 1.0
            else:
                keep.append(i)
        hand = keep + list(itertools.islice(rest, 3 - len(keep)))
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the undecided few so that the words come nearest, then the number of documents."""
    p = p.copy()
    live = [i for i in range(len(p)) if _EPS < p[i] < 1 - _EPS]
    if live:
        words, rows = float(p[live] @ size[live]), float(p[live].sum())
        best = min(itertools.product((0, 1), repeat=len(live)), key=lambda t: (abs(float(np.dot(t, size[live])) - words), abs(sum(t) - rows), t))
        p[live] = best
    return p


def targets(sizes: dict, share: float = 1.5, most: float = 2.0, weights: tuple = (3, 1, 2)) -> dict:
    """Words that each source is to give: by weight, at most `most` times its own, the excess shared again by weight."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, out, free = share * sum(sizes.values()), {}, list(names)
    while free:
        total = sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / total > most * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in free}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        free = [s for s in free if s not in out]
    return out


def sized(docs: DataFrame) -> DataFrame:
    """docs with _size: its words, runs of anything but a blank and code points 9 to 13."""
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.withColumn("_size", words.cast("long"))


def _fly(rows: DataFrame, chunks: DataFrame, level: int) -> DataFrame:
    """One level of flights over (source, n, doc_id, size, p); chunks has each source's number of chunks.

    Rows enter a flight in the order of doc_id, text hash and size, with a seed
    from the source and the chunk, so reruns agree.
    """

    def one(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "tie", "size"], kind="stable", na_position="last").reset_index(drop=True)
        text = "" if pd.isna(key[0]) else str(key[0])
        rng = np.random.default_rng([level, int(key[1]), *text.encode("utf-8", "surrogatepass"), int(pd.isna(key[0]))])
        p = flight(pdf["p"].to_numpy(), pdf["size"].to_numpy(), rng)
        if key[2] == 1:
            p = landing(p, pdf["size"].to_numpy().astype(float))
        pdf["p"] = p
        return pdf[["source", "doc_id", "tie", "size", "copy", "p"]]

    chunked = rows.join(chunks, rows["source"].eqNullSafe(chunks["of"])).drop("of")
    chunked = chunked.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "tie", F.lit(level)), F.col("chunks")))
    return chunked.groupBy("source", "chunk", "chunks").applyInPandas(one, "source string, doc_id long, tie long, size long, copy int, p double")


def sample(rows: DataFrame, wanted: dict, sizes: dict) -> DataFrame:
    """From (source, doc_id, tie, size), the same with copies: how often the mix takes each row.

    The numbers of sources and of undecided rows per source come to the driver;
    both are small. Rows of no words are taken as their source's whole part says.
    """
    spark = rows.sparkSession
    plan = []
    for s, n in sizes.items():
        m = wanted[s] / n if n else 0.0
        whole = int(m)
        plan.append((s, whole, m - whole))
    part = spark.createDataFrame(plan, "of string, copy int, p double")
    state = rows.join(F.broadcast(part), rows["source"].eqNullSafe(part["of"])).drop("of")  # a row per source
    done, level, tables = [], 0, []
    while True:
        state = written(state.select("source", "doc_id", "tie", "size", "copy", "p"), f"mix-{level}")
        tables.append(state)
        open_ = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
        done.append(state.where(~open_))
        left = {r["source"]: r["n"] for r in state.where(open_).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not left:
            break
        chunks = spark.createDataFrame([(s, max(1, -(-n // CHUNK))) for s, n in left.items()], "of string, chunks long")
        state = _fly(state.where(open_), F.broadcast(chunks), level)
        level += 1
    out = done[0]
    for d in done[1:]:
        out = out.union(d)
    return out.select("source", "doc_id", "tie", "size", (F.col("copy") + F.round("p").cast("int")).cast("long").alias("copies"))


def mixed(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = (3, 1, 2)) -> DataFrame:
    """doc_id, source, tie, size, source_size, target, copies of every row of docs.

    tie is a hash of the text, which tells rows of one doc_id apart. Null
    sources are a source of their own, last; null texts have no words. A source
    without words has the target 0 and is not taken. An empty table gives an
    empty result.
    """
    prepare(docs.sparkSession)
    rows = sized(docs.select("doc_id", "source", "text"))
    rows = rows.select(F.col("source").cast("string").alias("source"), "doc_id", F.xxhash64("text").alias("tie"), F.col("_size").alias("size"))
    rows = written(rows, "mix-rows")
    sizes = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    wanted = targets(sizes, share, most, weights)
    known = docs.sparkSession.createDataFrame([(s, int(sizes[s]), float(wanted[s])) for s in sizes], "of string, source_size long, target double")
    out = sample(rows, wanted, sizes)
    return out.join(F.broadcast(known), out["source"].eqNullSafe(known["of"])).drop("of")  # a row per source


def mixed_documents(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = (3, 1, 2)) -> DataFrame:
    """docs as the mix takes them: a row for each copy, the columns unchanged."""
    m = mixed(docs, share, most, weights).select(F.col("doc_id").alias("__wl_d"), F.col("tie").alias("__wl_t"), F.col("source").alias("__wl_s"), "copies")
    m = m.groupBy("__wl_d", "__wl_t", "__wl_s").agg(F.sum("copies").alias("__wl_c"), F.count(F.lit(1)).alias("__wl_n"))
    base = docs.withColumn("__wl_tie", F.xxhash64("text"))
    on = base["doc_id"].eqNullSafe(m["__wl_d"]) & base["__wl_tie"].eqNullSafe(m["__wl_t"]) & base["source"].eqNullSafe(m["__wl_s"])
    out = base.join(m, on).withColumn("__wl_k", F.col("__wl_c"))
    if not m.where("__wl_n > 1").isEmpty():
        # Of rows alike in id, text and source, each gets an equal part of the copies, the rest going to the first of them by all columns.
        out = out.withColumn("__wl_order", F.xxhash64(*columns_of(docs)))
        nth = F.row_number().over(Window.partitionBy("__wl_d", "__wl_t", "__wl_s").orderBy("__wl_order")) - 1
        out = out.withColumn("__wl_k", F.floor(F.col("__wl_c") / F.col("__wl_n")) + F.when(nth < F.col("__wl_c") % F.col("__wl_n"), 1).otherwise(0))
    out = out.where("__wl_k > 0")
    return out.withColumn("__wl_i", F.explode(F.sequence(F.lit(1), F.col("__wl_k").cast("int")))).select(*columns_of(docs))


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


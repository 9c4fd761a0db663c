"""Quality classifier: supervised subword embeddings.

A document's vector is the mean of learned vectors of its hashed words and of
the character n-grams (bytes, 3 to 5) inside its words; a softmax over two
classes reads it. Training is stochastic gradient descent in numpy on a bounded
sample of labelled rows. As the output is linear in the mean, scoring needs one
learned number per bucket: the difference of the two class weights applied to
the bucket's vector. So every whole text costs one pass of table look-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, groups_of_bytes, let_go, prepare, text_of
from .texthash import pieces, word_hashes

_MULT = np.uint64(0x9E3779B97F4A7C15)
_GRAM = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class Settings:
    """sample: the most labelled rows to fit on, taken by the hash of their id."""

    sample: int = 4000
    bits: int = 18
    dim: int = 16
    epochs: int = 6
    rate: float = 0.5
    seed: int = 7


def _buckets(raws: list[bytes], bits: int):
    """Yield (buckets, text index) arrays for words and each n-gram length; index ascends."""
    shift = np.uint64(64 - bits)
    words, counts = word_hashes(raws)
    yield ((words * _MULT) >> shift).astype(np.int64), np.repeat(np.arange(len(raws)), counts)
    b = np.frombuffer(b" " + b"  ".join(raws) + b" ", np.uint8)
    owner = np.repeat(np.arange(len(raws)), [len(r) + 2 for r in raws])
    blank = (b == 32) | ((b >= 9) & (b <= 13))
    seen = np.concatenate([[0], np.cumsum(blank)])
    wide = b.astype(np.uint64)
    wide[blank] = 32
    h = wide[:-1] * _GRAM + wide[1:]
    for n in (3, 4, 5):
        if len(b) < n:
            return
        h = h[: len(b) - n + 1] * _GRAM + wide[n - 1 :]
        whole = seen[n - 1 : len(b)] == seen[1 : len(b) - n + 2]  # no blank but at the ends
        yield (((h[whole] + np.uint64(n)) * _MULT) >> shift).astype(np.int64), owner[: len(h)][whole]


def _groups(texts):
    """As groups_of_bytes, with a very long text cut at white space into parts of its own."""
    for first, raws in groups_of_bytes(texts):
        if len(raws) == 1:
            for part in pieces(raws[0]):
                yield first, [part]
        else:
            yield first, raws


def _bags(texts, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their shares of its features."""
    held: list[list[np.ndarray]] = [[] for _ in texts]
    for first, raws in _groups(texts):
        for bucket, owner in _buckets(raws, bits):
            for k, part in enumerate(np.split(bucket, np.searchsorted(owner, np.arange(1, len(raws))))):
                held[first + k].append(part)
    out = []
    for parts in held:
        idx, n = np.unique(np.concatenate(parts or [np.empty(0, np.int64)]), return_counts=True)
        out.append((idx.astype("<u4"), (n / max(n.sum(), 1)).astype("<f4")))
    return out


def train(bags, labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Per-bucket log-odds weights and the bias."""
    rng = np.random.default_rng(s.seed)
    vec = rng.uniform(-1 / s.dim, 1 / s.dim, (1 << s.bits, s.dim)).astype(np.float32)
    out = np.zeros((2, s.dim), np.float32)
    bias = np.zeros(2, np.float32)
    steps, done = max(1, s.epochs * len(bags)), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(bags)):
            rate = s.rate * (1 - done / steps)
            done += 1
            idx, share = bags[i]
            rows = vec[idx]
            mean = share @ rows
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = out.T @ p
            out -= rate * np.outer(p, mean)
            bias -= rate * 0.1 * p
            vec[idx] = rows - rate * len(idx) ** 0.5 * share[:, None] * back
    return vec.astype(np.float64) @ (out[1] - out[0]).astype(np.float64), float(bias[1] - bias[0])


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, y): one row per id with a usable label; the mean decides among several, 0.5 up is 1."""
    good = labels.where("doc_id is not null and quality in (0, 1)")
    return good.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    """Fit on at most s.sample labelled documents, one row an id: (weights of buckets, bias).

    The sample's features, bounded by the setting, meet in one task, which
    trains; the driver gets the weights alone.
    Without usable labels, or with one class only, weights are 0 and the bias
    gives the (smoothed) share of class 1.
    """
    picked = (
        labelled(labels)
        .join(docs.select("doc_id").distinct(), "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(s.sample)
    )
    # At most s.sample narrow rows: their size is bounded by the setting.
    both = docs.select("doc_id", text_of(docs).alias("text")).join(F.broadcast(picked), "doc_id")
    # Of an id that several rows have, the text with the least hash is the sample's.
    both = both.groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), F.xxhash64("text")).alias("r")).select("doc_id", "r.text", "r.y")
    bits = s.bits

    @frugal
    def features(batches):
        for pdf in batches:
            bags = _bags(pdf["text"].tolist(), bits)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "y": pdf["y"], "idx": [a.tobytes() for a, _ in bags], "share": [b.tobytes() for _, b in bags]})

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(zip(pdf["doc_id"], pdf["y"], pdf["idx"], pdf["share"]), key=lambda r: (r[0], r[2]))
        y = np.array([r[1] for r in rows], np.int64)
        if y.min() == y.max():
            weights, bias = _prior(y, bits)
        else:
            weights, bias = train([(np.frombuffer(i, "<u4"), np.frombuffer(v, "<f4")) for _, _, i, v in rows], y, s)
        return pd.DataFrame([(weights.tobytes(), bias)], columns=["weights", "bias"])

    rows = both.mapInPandas(features, "doc_id long, y int, idx binary, share binary")
    made = rows.withColumn("__wl_all", F.lit(0)).groupBy("__wl_all").applyInPandas(learn, "weights binary, bias double").collect()
    if not made:
        return _prior(np.empty(0, np.int64), bits)
    return np.frombuffer(bytes(made[0]["weights"])), made[0]["bias"]


def _prior(y: np.ndarray, bits: int) -> tuple[np.ndarray, float]:
    p = (y.sum() + 1) / (len(y) + 2)
    return np.zeros(1 << bits), float(np.log(p / (1 - p)))


def log_odds(texts, weights: np.ndarray, bias: float) -> np.ndarray:
    bits = int(len(weights)).bit_length() - 1
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for first, raws in _groups(texts):
        for bucket, owner in _buckets(raws, bits):
            total[first : first + len(raws)] += np.bincount(owner, weights[bucket], len(raws))
            count[first : first + len(raws)] += np.bincount(owner, minlength=len(raws))
    return total / np.maximum(count, 1) + bias


def scored(docs: DataFrame, model: tuple[np.ndarray, float], column: str = "score") -> DataFrame:
    """docs with a double column: the chance of class 1. Null texts count as empty; those get the bias's score. A column of that name is replaced."""
    spark = prepare(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)  # 2**bits numbers, whatever the input

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        let_go()
        weights, bias = held.value
        return pd.Series(1 / (1 + np.exp(-np.clip(log_odds(text.tolist(), weights, bias), -500, 500))))

    return docs.withColumn(column, score(docs["text"]))


def training_rows(labels: DataFrame) -> DataFrame:
    """The labels that may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, training_rows(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    out = scored(docs, model).select("doc_id", held.alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

"""SimHash near duplicates by bit-sliced comparison.

1. A document's fingerprint is the majority of its shingles' 64-bit hashes, bit
   by bit.
2. Fingerprints within r bits of each other agree on all but r of any bands of
   bits. A table for each choice of bands that may agree deals the distinct
   fingerprints by their bits there; the number of bands follows from how many
   fingerprints there are, so that a table's block stays at some hundreds.
3. In a block, the fingerprints stand as bit planes: plane b holds bit b of all.
   A query differs from 64 of them at a time in one exclusive or; differences
   are added up in carry-save counters, one bit of the count a plane, and a carry
   out of the last marks those beyond the radius. Queries all of whose block is
   beyond it are left out, and the block is left once no query remains.
4. A block gives a star for each connected part of it, not its pairs. Blocks of
   very many fingerprints are cut into tiles that meet each other two by two.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, documents, frugal, prepare, small, spread_join, text_of, written
from .texthash import pieces

PARTS = 32
BLOCK = 256  # fingerprints of a block, about
TILE = 4096  # of a tile of a large block
QUERIES = 256  # that meet a block at a time
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _bits(hashes: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones a hash, the lowest bit first."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def fingerprint(raw: bytes, words: int = 3, seed: int = 42) -> int:
    """Bits set in over half of the hashes of a text's word shingles, A-Z in lower case; 0 for no words."""
    ones, number, carried = np.zeros(64, np.int64), 0, []
    for piece in pieces(raw):
        w = carried + piece.lower().split()
        n = len(w) - words + 1
        if n > 0:
            shingles = map(b" ".join, zip(*(w[k : k + n] for k in range(words))))
            bits = _bits(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n))
            ones += bits.sum(0, dtype=np.int64)
            number += n
        carried = w[max(n, 0) :]
    if not number and carried:
        ones, number = _bits(np.array([xxhash.xxh64_intdigest(b" ".join(carried), seed)], np.uint64))[0].astype(np.int64), 1
    return int(np.packbits(2 * ones > number, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, tie (the text's hash) and fp (a long of the same bits) of every row."""

    @frugal
    def find(batches):
        for pdf in batches:
            fp = np.array([fingerprint(raw, words, seed) for raw in pdf["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "tie": pdf["tie"], "fp": fp})

    rows = docs.select(F.col("doc_id").cast("decimal(20,0)").alias("doc_id"), F.xxhash64(text_of(docs)).alias("tie"), text_of(docs).cast("binary").alias("text"))
    return rows.mapInPandas(find, "doc_id long, tie long, fp long")


def planes_of(fps: np.ndarray) -> np.ndarray:
    """The bits of fingerprints, stored vertically: 64 rows, each of one bit a fingerprint, in words of 64."""
    packed = np.packbits(_bits(fps).T, axis=1, bitorder="little")
    out = np.zeros((64, -(-len(fps) // 64) * 8), np.uint8)
    out[:, : packed.shape[1]] = packed
    return out.view("<u8")


def within(queries: np.ndarray, planes: np.ndarray, size: int, radius: int, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query's place, fingerprint's place) that differ in at most `radius` of the given bits, of which there is an even number."""
    width = max(radius.bit_length(), 1)
    rows = np.arange(len(queries))
    wanted = np.where(_bits(queries) == 1, _FULL, np.uint64(0))
    spare = (1 << width) - 1 - radius  # counts begin here, so that the carry out marks radius + 1
    count = [np.full((len(rows), planes.shape[1]), _FULL if spare >> k & 1 else np.uint64(0)) for k in range(width)]
    over = np.zeros_like(count[0])
    tail = size % 64
    if tail:
        over[:, -1] = _FULL << np.uint64(tail)
    for i in range(0, len(bits), 2):
        a = planes[bits[i]] ^ wanted[:, bits[i], None]
        b = planes[bits[i + 1]] ^ wanted[:, bits[i + 1], None]
        either = a ^ b
        carry = (a & b) | (count[0] & either)
        count[0] ^= either
        for k in range(1, width):
            count[k], carry = count[k] ^ carry, count[k] & carry
        over |= carry
        if i % 8 == 6:
            live = (over != _FULL).any(axis=1)
            if not live.all():
                rows, wanted, over, count = rows[live], wanted[live], over[live], [c[live] for c in count]
                if not len(rows):
                    break
    near = np.unpackbits((~over).view(np.uint8).reshape(len(rows), planes.shape[1] * 8), axis=1, bitorder="little")
    q, f = np.nonzero(near)
    return rows[q], f


def merge(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Let root, which names each place's part by its least place, hold the links (a, b) too."""
    while True:
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            return
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def star(left: np.ndarray, right: np.ndarray | None, radius: int, bits: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that connect all fingerprints of left (and right) within the radius across the two, or in left alone."""
    held = left if right is None else np.concatenate([left, right])
    base = 0 if right is None else len(left)
    block = left if right is None else right
    root, planes = np.arange(len(held)), planes_of(block)
    for at in range(0, len(left), QUERIES):
        q, f = within(left[at : at + QUERIES], planes, len(block), radius, bits)
        merge(root, q + at, f + base)
    moved = np.flatnonzero(root != np.arange(len(held)))
    return held[moved], held[root[moved]]


def tables_for(number: int, radius: int) -> list[list[int]]:
    """For each table, the bits that deal the fingerprints: of some bands of all that may be the ones without a difference.

    Blocks are of about BLOCK fingerprints; more of these take more bands, and
    so more bits and more tables.
    """
    want = max(4, (max(number, 1) // BLOCK).bit_length())
    bands = radius + 1
    while (bands - radius) * (64 // bands) < want and bands < radius + 9:
        bands += 1
    free = bands - radius
    each = min(64 // bands, -(-want // free))
    return [[band * (64 // bands) + k for band in chosen for k in range(each)] for chosen in combinations(range(bands), free)]


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints (fp, a written table) as all pairs within the radius do."""
    tables = tables_for(fps.count(), radius)
    keys = []
    for number, bits in enumerate(tables):
        key = F.lit(number).cast("long")
        for b in bits:
            key = F.shiftleft(key, 1).bitwiseOR(F.shiftright("fp", b).bitwiseAND(F.lit(1)))
        keys.append(key)
    dealt = fps.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = dealt.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TILE)
    tiles = small(written(large.select("key", F.ceil(F.col("n") / (TILE // 2)).alias("tiles")), "simhash-large"))
    rows = dealt.join(tiles, "key", "left").select("key", "fp", F.coalesce("tiles", F.lit(1)).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda t: F.struct(F.least(own, t).alias("i"), F.greatest(own, t).alias("j"), F.when(own > t, 1).otherwise(0).alias("side")))
    rows = rows.select("key", "fp", F.inline(meets))
    place = ["key", "i", "j", "side"]
    size = len(tables[0])
    spare = [[b for b in range(64) if b not in bits] for bits in tables]
    # The bits that deal a block are alike in it. Bits are taken two by two.
    spare = [s if len(s) % 2 == 0 else [*s, t[0]] for s, t in zip(spare, tables)]

    @frugal
    def compare(batches):
        held: list[pd.DataFrame] = []

        def meet(pdf):
            names = pdf[["key", "i", "j", "side"]].to_numpy()
            fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
            block = np.flatnonzero(np.concatenate([[True], (names[1:, :3] != names[:-1, :3]).any(axis=1), [True]]))
            out = []
            for lo, hi in zip(block[:-1], block[1:]):
                key, i, j = names[lo, :3]
                bits = spare[int(key) >> size]
                cut = lo + int((names[lo:hi, 3] == 0).sum())
                if i == j and hi - lo > 1:
                    out.append(star(fp[lo:hi], None, radius, bits))
                elif i != j and lo < cut < hi:
                    out.append(star(fp[lo:cut], fp[cut:hi], radius, bits))
            if out:
                yield pd.DataFrame({"a": np.concatenate([a for a, _ in out]).view(np.int64), "b": np.concatenate([b for _, b in out]).view(np.int64)})

        # The last block of a batch may go on in the next one.
        for pdf in batches:
            if not len(pdf):
                continue
            last = (pdf[["key", "i", "j"]] != pdf[["key", "i", "j"]].iloc[-1]).any(axis=1)
            done = int(np.flatnonzero(last.to_numpy())[-1]) + 1 if last.any() else 0
            first = pdf[["key", "i", "j"]].iloc[0]
            goes_on = held and (held[-1][["key", "i", "j"]].iloc[-1] == first).all()
            if held and not goes_on:
                yield from meet(pd.concat(held))
                held = []
            if done:
                yield from meet(pd.concat([*held, pdf.iloc[:done]]))
                held = [pdf.iloc[done:]]
            else:
                held.append(pdf)
        if held:
            yield from meet(pd.concat(held))

    rows = rows.repartition("key", "i", "j").sortWithinPartitions(*place)
    return rows.mapInPandas(compare, "a long, b long")


def component_ids(docs: DataFrame, radius: int = 3, words: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs (doc_id and text; other columns are not read).

    Null, empty and blank texts have fingerprint zero, and are linked like any
    other; so are repeated rows. Texts of fewer words than a shingle are one
    shingle. A component's id is its least doc_id; rows with a null doc_id take
    it too, and null where the component has no other. No docs give no rows.
    """
    prepare(docs.sparkSession)
    own = written(fingerprints(docs, words, seed), "simhash-documents")
    fps = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(fps.select("fp"), radius), "simhash-cc")
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = written(spread_join(named.select("root", "fp"), least, "root", "fp", PARTS).select("fp", "component_id"), "simhash-components")
    rows = spread_join(own, facts, "fp", "doc_id", PARTS, "tie")
    return rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_ids(documents(spark, sf_dir))

"""Token files: ids bit-packed at the vocabulary's fixed width.

A segment is one binary value: a header, the ids of its documents, their
lengths, the offsets of its blocks, and the blocks. A block holds `BLOCK` ids
in `width` bits each, so block k begins at byte offsets[k] and any id range is
unpacked by numpy from the blocks that hold it alone. Segments lie in Parquet
files (which any store that Spark reaches can hold), ordered by file and
segment; documents in them ascend by doc_id.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .common import documents, no_collector, prepare, shared_dir, shuffle_partitions, small, table_path, text_of

MAGIC = b"WLBP"
BLOCK = 4096  # a multiple of 8, so that blocks end at whole bytes
_HEAD = struct.Struct("<4sBxxxIQII")
_SEGMENT_IDS = 1 << 18


def width_of(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, width: int) -> bytes:
    """ids below 2**width as a little-endian bit string, padded to groups of 8 ids."""
    groups = -(-len(ids) // 8)
    lanes = np.zeros(groups * 8, np.uint64)
    lanes[: len(ids)] = ids
    lanes = lanes.reshape(groups, 8)
    out = np.zeros((groups, width), np.uint8)
    for k in range(8):
        at, shift = divmod(k * width, 8)
        v = lanes[:, k] << np.uint64(shift)
        for j in range(-(-(shift + width) // 8)):
            out[:, at + j] |= ((v >> np.uint64(8 * j)) & np.uint64(255)).astype(np.uint8)
    return out.tobytes()


def unpack_bits(raw, width: int, n: int) -> np.ndarray:
    groups = -(-n // 8)
    b = np.frombuffer(raw, np.uint8, groups * width).reshape(groups, width)
    out = np.empty((groups, 8), np.uint32)
    for k in range(8):
        at, shift = divmod(k * width, 8)
        v = np.zeros(groups, np.uint64)
        for j in range(-(-(shift + width) // 8)):
            v |= b[:, at + j].astype(np.uint64) << np.uint64(8 * j)
        out[:, k] = (v >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    return out.reshape(-1)[:n]


def write_segment(doc_ids: list, id_arrays: list[np.ndarray], width: int) -> bytes:
    """One segment; a null doc_id is kept as such."""
    ids = np.concatenate(id_arrays) if id_arrays else np.empty(0, np.uint32)
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    lengths = np.array([len(a) for a in id_arrays], "<u8")
    blocks = -(-len(ids) // BLOCK)
    offsets = np.minimum(np.arange(blocks + 1) * BLOCK, -(-len(ids) // 8) * 8) * width // 8
    head = _HEAD.pack(MAGIC, width, len(doc_ids), len(ids), BLOCK, blocks)
    return head + keys.tobytes() + nulls.tobytes() + lengths.tobytes() + offsets.astype("<u8").tobytes() + pack_bits(ids, width)


class Segment:
    """A segment for reading: doc_ids, lengths, and ids(i, j) of any range."""

    def __init__(self, raw: bytes):
        magic, self.width, docs, self.n_ids, self.block, blocks = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = _HEAD.size
        keys = np.frombuffer(raw, "<i8", docs, at)
        nulls = np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
        self.doc_ids = [None if z else int(k) for k, z in zip(keys, nulls)]
        self.lengths = np.frombuffer(raw, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1, at + 17 * docs)
        self.raw, self.base = raw, at + 17 * docs + 8 * (blocks + 1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """ids start..stop-1, read from their blocks alone."""
        stop = min(stop, self.n_ids)
        if start >= stop:
            return np.empty(0, np.uint32)
        first, last = start // self.block, (stop - 1) // self.block
        a, b = int(self.offsets[first]), int(self.offsets[last + 1])
        n = min((last + 1) * self.block, self.n_ids) - first * self.block
        part = unpack_bits(self.raw[self.base + a : self.base + b], self.width, n)
        return part[start - first * self.block : stop - first * self.block]


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, vocabulary_path: str | None = None) -> None:
    """Encode docs (doc_id, text) and write their files under path, doc_id ascending, nulls first.

    Null and empty texts have the end id alone. Rows with the same doc_id are
    kept, in the order of their texts.
    """
    n = shuffle_partitions(docs.sparkSession)
    ordered = docs.select("doc_id", text_of(docs).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches):
        from pyspark import TaskContext

        enc = encoder(vocabulary, vocabulary_path)
        width, file_no, end = width_of(enc.size), TaskContext.get().partitionId(), np.array([end_id], enc.dtype).tobytes()
        segment, first, keys, arrays, held = 0, 0, [], [], 0
        for pdf in batches:
            made = []
            with no_collector():
                coded = [enc.encode(t) + end for t in pdf["text"]]
            for d, raw in zip(pdf["doc_id"].astype("Int64"), coded):
                ids = np.frombuffer(raw, enc.dtype)
                keys.append(None if d is pd.NA else int(d))
                arrays.append(ids)
                held += len(ids)
                if held >= _SEGMENT_IDS:
                    made.append((file_no, segment, first, held, write_segment(keys, arrays, width)))
                    segment, first, keys, arrays, held = segment + 1, first + held, [], [], 0
            yield pd.DataFrame(made, columns=["file_no", "segment", "first", "n_ids", "data"])
        if keys:
            yield pd.DataFrame([(file_no, segment, first, held, write_segment(keys, arrays, width))], columns=["file_no", "segment", "first", "n_ids", "data"])

    made = ordered.mapInPandas(encode, "file_no int, segment int, first long, n_ids long, data binary")
    made.write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32, and with ids=True its ids."""
    files = spark.read.schema("file_no int, segment int, first long, n_ids long, data binary").parquet(path)
    # One row per file: bounded by the number of files, not by the documents.
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = files.groupBy("file_no").agg(F.sum("n_ids").alias("n")).select("file_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))

    def decode(batches):
        for pdf in batches:
            for base, first, raw in zip(pdf["base"], pdf["first"], pdf["data"]):
                s = Segment(raw)
                ends = np.cumsum(s.lengths)
                found = [s.ids(int(e - n), int(e)) for e, n in zip(ends, s.lengths)] if len(ends) < 2 else np.split(s.ids(0, s.n_ids), ends[:-1])
                out = pd.DataFrame({"doc_id": pd.array(s.doc_ids, "Int64"), "start": base + first + ends - s.lengths, "n_tokens": s.lengths, "ids_crc32": [zlib.crc32(x.astype("<u4", copy=False).tobytes()) for x in found]})
                if ids:
                    out["ids"] = [x.astype(np.int64) for x in found]
                yield out

    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    return files.join(small(bases), "file_no").mapInPandas(decode, kind)


def op2_token_bit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    shared_dir(spark)
    path = table_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path, "byte_bpe_50k.json", 2)
    return read_tokens(spark, path)

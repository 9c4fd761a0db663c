"""Substring dedup by sliding spans of sentences.

A sentence ends behind a word that ends in a full stop, question or exclamation
mark, and at a line's end. A sentence of more than `phrase` words is cut into
phrases where its own words say so: of any `phrase` words in a row in it, one
begins at the word of least hash (the last such). So a passage pasted into the
middle of another sentence falls into the same phrases there, but for its edges.

Every run of consecutive sentences and phrases, from each of them on until it
has `least` words, is hashed, ASCII case and white space aside; so is the
shortest such run up to the text's end. A hash that occurs more than once in
the whole corpus is a repeated span. Its first occurrence, by doc_id, text and
place, stays, and so does what overlaps that in the same text; what lies under
all others is removed. Any passage of
least + 4 * phrase - 3 words or more (51 as given) that occurs twice holds a
whole run, whatever stands around it, so it is found.

Runs are counted in two steps. A tile, the runs of some megabytes of texts,
keeps of equal runs the first, with what overlaps it, and settles the others
itself, so a run that stands in a third of all texts is sent once a tile. Then the tiles' runs meet
in blocks by hash, and what repeats there is gathered by text. A tile's part
of a block is one row of binary values, and where blocks are very many it is a
run at least, so rows never exceed runs.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_count, columns_of, documents, even_labels, frugal, groups_of_bytes, let_go, mix64, prepare, text_of, written
from .texthash import PIECE, pieces, words_at

LEAST = 38  # words of a span
PHRASE = 4  # words of a phrase at most
_TILE_RUNS = 400_000
_FACTOR = 0x9E3779B97F4A7C15
_BACK = pow(_FACTOR, -1, 1 << 64)
_STOPS = np.zeros(256, bool)
_STOPS[[33, 46, 63]] = True
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_RUN = np.dtype([("key", "<u8"), ("doc", "<u4"), ("at", "<u4"), ("many", "<u4")])


class _Powers:
    """Powers of the factor and of its inverse, made as far as they are asked for."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 18)
            first = np.ones(1, np.uint64)
            self.up = np.cumprod(np.append(first, np.full(size, _FACTOR, np.uint64)), dtype=np.uint64)
            self.down = np.cumprod(np.append(first, np.full(size, _BACK, np.uint64)), dtype=np.uint64)
        return self.up, self.down


_POWERS = _Powers()


def _sentence_words(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the texts' words, whether each begins a sentence, and each text's number of words."""
    one = len(raws) == 1
    hashes, breaks, stops, late = [], [], [], False
    for raw in pieces(raws[0]) if one and len(raws[0]) > PIECE else [b"\n".join(raws)]:
        b = np.frombuffer(raw, np.uint8)
        starts, length, h = words_at(raw)
        new = np.zeros(len(starts) + 1, bool)
        new[np.searchsorted(starts, np.flatnonzero(b == 10))] = True
        new[0] |= late
        late = new[-1]
        hashes.append(h)
        breaks.append(new[:-1])
        stops.append(_STOPS[b[starts + length.astype(np.int64) - 1]])
    h, opens, stop = map(np.concatenate, (hashes, breaks, stops))
    opens[1:] |= stop[:-1]
    opens[:1] = True
    if one:
        return h, opens, np.array([len(h)])
    ends = np.cumsum([len(r) + 1 for r in raws])
    return h, opens, np.diff(np.searchsorted(starts, ends), prepend=0)


def text_runs(raws: list[bytes], least: int = LEAST, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the texts: index of the text, first word, number of words, hash."""
    h, opens, counts = _sentence_words(raws)
    n = len(h)
    sentence = np.cumsum(opens)
    m = n - phrase + 1
    if m > 0:
        low, which = h[:m].copy(), np.zeros(m, np.int64)
        for k in range(1, phrase):
            less = h[k : k + m] <= low
            np.copyto(low, h[k : k + m], where=less)
            which[less] = k
        whole = np.flatnonzero(sentence[:m] == sentence[phrase - 1 :])
        opens[whole + which[whole]] = True
    first = np.flatnonzero(opens)
    ends = np.cumsum(counts)
    bounds = np.append(first, n)
    text = np.searchsorted(ends, first, "right")
    # From each on; and for each text, of those that reach its end, the shortest.
    reach = first + least <= ends[text]
    a, t = first[reach], text[reach]
    b = bounds[np.searchsorted(bounds, a + least)]
    last = np.flatnonzero(np.diff(t, append=-1))
    short = last[b[last] < ends[t[last]]]
    a, b, t = np.append(a, a[short]), np.append(b, ends[t[short]]), np.append(t, t[short])
    up, down = _POWERS.to(n)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n], dtype=np.uint64)])
    key = mix64(mix64((total[b] - total[a]) * down[a]) + (b - a).astype(np.uint64))
    return t, a - (ends - counts)[t], b - a, key


def _settled(runs: np.ndarray, doc_id: np.ndarray, null: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs sorted by key and place (doc_id, tie, at; null ids first): those still open, which are the first of each key and what overlaps it, and the repeats of a first.

    Rows alike in doc_id, tie and place are one occurrence.
    """
    new = np.diff(runs["key"], prepend=runs["key"][:1] ^ np.uint64(1)) != 0
    head = np.maximum.accumulate(np.where(new, np.arange(len(runs)), 0))
    d, g = runs["doc"], runs["doc"][head]
    same = (doc_id[d] == doc_id[g]) & (null[d] == null[g]) & (tie[d] == tie[g])
    at, top = runs["at"].astype(np.int64), runs["at"][head].astype(np.int64)
    behind = at >= top + runs["many"][head]
    return np.flatnonzero(new | (same & (at > top) & ~behind)), np.flatnonzero(~same | behind)


def _in_order(runs: np.ndarray, doc_id: np.ndarray, null: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """runs by key; where a key occurs more than once, by place."""
    runs = runs[np.argsort(runs["key"], kind="stable")]
    same = runs["key"][1:] == runs["key"][:-1]
    several = np.flatnonzero(np.append(same, False) | np.append(False, same))
    part = runs[several]
    d = part["doc"]
    runs[several] = part[np.lexsort((part["at"], tie[d], doc_id[d], ~null[d], part["key"]))]
    return runs


def _block_of_text(doc_id: np.ndarray, tie: np.ndarray, blocks: int) -> np.ndarray:
    return (mix64(mix64(doc_id.view(np.uint64)) ^ tie.view(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def _texts(doc: np.ndarray, doc_id: np.ndarray, null: np.ndarray, tie: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[bytes, bytes, bytes]]:
    """doc (numbers of texts) renumbered by the texts used, and these texts' (doc_ids, nulls, ties)."""
    used = np.unique(doc)
    return np.searchsorted(used, doc), used, (doc_id[used].tobytes(), null[used].tobytes(), tie[used].tobytes())


def _joined(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_id, null and tie of the rows' texts, and how many texts stand before each row's."""
    before = np.concatenate([[0], np.cumsum([len(d) // 8 for d in pdf["doc_ids"]])])
    doc_id, tie = np.frombuffer(b"".join(pdf["doc_ids"]), "<i8"), np.frombuffer(b"".join(pdf["ties"]), "<i8")
    return doc_id, np.frombuffer(b"".join(pdf["nulls"]), bool), tie, before


_PART = "block long, doc_ids binary, nulls binary, ties binary"


def _tiles(docs: DataFrame, least: int, phrase: int, labels: list[int]) -> DataFrame:
    """Rows (block, texts, runs, spans) of some megabytes of texts.

    runs are the tile's open occurrences in the block. spans (doc, begin, end)
    are those that repeat one of these, in the block of their text.
    """
    blocks = len(labels)
    names = ["block", "doc_ids", "nulls", "ties", "runs", "spans"]

    def flush(parts, doc_id, null, tie):
        doc_id, null, tie = np.array(doc_id, np.int64), np.array(null, bool), np.array(tie, np.int64)
        runs = _in_order(np.concatenate(parts), doc_id, null, tie)
        still, others = _settled(runs, doc_id, null, tie)
        gone, runs = runs[others], runs[still]
        spans = np.stack([gone["doc"], gone["at"], gone["at"] + gone["many"]], 1).astype(np.int64)

        def dealt(rows, block, *by):
            order = np.lexsort((*by, block))
            return rows[order], np.searchsorted(block[order], np.arange(blocks + 1))

        runs, cut = dealt(runs, (runs["key"] % np.uint64(blocks)).astype(np.int64), runs["at"], runs["doc"])
        spans, edge = dealt(spans, _block_of_text(doc_id, tie, blocks)[spans[:, 0]], spans[:, 1], spans[:, 0])
        for b in range(blocks):
            part, done = runs[cut[b] : cut[b + 1]].copy(), spans[edge[b] : edge[b + 1]].copy()
            if len(part) + len(done):
                doc, _, texts = _texts(np.concatenate([part["doc"], done[:, 0]]).astype(np.int64), doc_id, null, tie)
                part["doc"], done[:, 0] = doc[: len(part)], doc[len(part) :]
                yield labels[b], *texts, part.tobytes(), done.astype("<i8").tobytes()

    @frugal
    def tiles(batches):
        parts, doc_id, null, tie, held = [], [], [], [], 0
        for pdf in batches:
            ids = pdf["doc_id"].astype("Int64")
            for first, raws in groups_of_bytes(pdf["text"]):
                t, at, many, key = text_runs(raws, least, phrase)
                if len(t):
                    made = np.empty(len(t), _RUN)
                    made["key"], made["doc"], made["at"], made["many"] = key, t + len(doc_id), at, many
                    parts.append(made)
                    held += len(made)
                own = ids.iloc[first : first + len(raws)]
                doc_id += own.fillna(0).tolist()
                null += own.isna().tolist()
                tie += pdf["tie"].iloc[first : first + len(raws)].tolist()
                if held >= _TILE_RUNS:
                    yield pd.DataFrame(flush(parts, doc_id, null, tie), columns=names)
                    parts, doc_id, null, tie, held = [], [], [], [], 0
        if parts:
            yield pd.DataFrame(flush(parts, doc_id, null, tie), columns=names)

    own = docs.select("doc_id", F.xxhash64("text").alias("tie"), text_of(docs).alias("text"))
    return own.mapInPandas(tiles, f"{_PART}, runs binary, spans binary")


def repeated(docs: DataFrame, least: int = LEAST, phrase: int = PHRASE) -> DataFrame:
    """(doc_id, tie, spans): for each document with a non-first repeated span, the words under these, each first * 2**32 + the one behind."""
    labels = even_labels(docs.sparkSession, block_count(docs))
    blocks = len(labels)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of a block's runs the repeats, in the block of their text."""
        let_go()
        doc_id, null, tie, before = _joined(pdf)
        runs = [np.frombuffer(r, _RUN).copy() for r in pdf["runs"]]
        spans = [np.frombuffer(s, "<i8").reshape(-1, 3) + [n, 0, 0] for s, n in zip(pdf["spans"], before)]
        for r, n in zip(runs, before):
            r["doc"] += np.uint32(n)
        runs = _in_order(np.concatenate(runs), doc_id, null, tie)
        gone = runs[_settled(runs, doc_id, null, tie)[1]]
        spans = np.concatenate([np.stack([gone["doc"], gone["at"], gone["at"] + gone["many"]], 1).astype(np.int64), *spans])
        to = _block_of_text(doc_id, tie, blocks)[spans[:, 0]]
        order = np.lexsort((spans[:, 1], spans[:, 0], to))
        spans, edge = spans[order], np.searchsorted(to[order], np.arange(blocks + 1))
        out = []
        for b in np.flatnonzero(np.diff(edge)):
            part = spans[edge[b] : edge[b + 1]]
            doc, _, texts = _texts(part[:, 0], doc_id, null, tie)
            out.append((labels[b], *texts, np.stack([doc, part[:, 1], part[:, 2]], 1).astype("<u4").tobytes()))
        return pd.DataFrame(out, columns=["block", "doc_ids", "nulls", "ties", "spans"])

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        """A row for each text, with overlapping spans made one."""
        let_go()
        doc_id, null, tie, before = _joined(pdf)
        spans = np.concatenate([np.frombuffer(s, "<u4").reshape(-1, 3).astype(np.int64) + [n, 0, 0] for s, n in zip(pdf["spans"], before)])
        # A text's number is that of its first mention here.
        order = np.lexsort((tie, doc_id, null))
        same = np.append(False, (doc_id[order][1:] == doc_id[order][:-1]) & (null[order][1:] == null[order][:-1]) & (tie[order][1:] == tie[order][:-1]))
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(~same) - 1
        first = order[~same]
        doc, begin, end = number[spans[:, 0]], spans[:, 1], spans[:, 2]
        order = np.lexsort((begin, doc))
        doc, begin, end = doc[order], begin[order], end[order]
        reach = np.maximum.accumulate((doc << 32) + end)
        at = np.flatnonzero(np.append(True, (doc[1:] << 32) + begin[1:] > reach[:-1]))
        doc, packed = doc[at], (begin[at] << 32) + (reach[np.append(at[1:], len(end)) - 1] & 0xFFFFFFFF)
        own, cut = np.unique(doc, return_index=True)
        ids = pd.array(doc_id[first[own]], "Int64")
        ids[null[first[own]]] = pd.NA
        return pd.DataFrame({"doc_id": ids, "tie": tie[first[own]], "spans": np.split(packed, cut[1:])})

    found = _tiles(docs, least, phrase, labels).groupBy("block").applyInPandas(meet, f"{_PART}, spans binary")
    return found.groupBy("block").applyInPandas(gather, "doc_id long, tie long, spans array<long>")


def without(text: str, spans: np.ndarray) -> tuple[str, int]:
    """The text less the words under spans, and the number of sentences that lost words."""
    words = [m.span() for m in _WORD.finditer(text)]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, spans >> 32, 1)
    np.add.at(edge, spans & 0xFFFFFFFF, -1)
    lost = np.cumsum(edge)[:-1] > 0
    turns = np.flatnonzero(np.diff(lost, prepend=False))
    out, at = [], 0
    for begin, end in zip(turns[::2], np.append(turns, len(words))[1::2]):
        out.append(text[at : words[begin][0]])
        at = words[end][0] if end < len(words) else len(text)
    opens = [True] + [text[b - 1] in ".!?" or "\n" in text[b:c] for (_, b), (c, _) in zip(words, words[1:])]
    sentence = np.cumsum(opens[: len(words)])
    return "".join(out) + text[at:], len(np.unique(sentence[lost]))


def deduplicated(docs: DataFrame, least: int = LEAST, phrase: int = PHRASE) -> DataFrame:
    """docs with text less what lies under repeated spans, and the column removed (the sentences that lost words).

    Null and empty texts stay as they are, and so do texts of fewer than `least`
    words. Rows alike in doc_id and text are one place: all of them keep or lose
    the same words. All other columns stay, but one named removed is replaced.
    """
    prepare(docs.sparkSession)
    # The spans grow with the corpus, so both sides are shuffled, whatever their size here.
    found = written(repeated(docs, least, phrase), "spans").hint("merge")
    found = found.select(F.col("doc_id").alias("__wl_d"), F.col("tie").alias("__wl_t"), F.col("spans").alias("__wl_at"))
    base = docs.withColumn("__wl_tie", F.xxhash64("text"))
    joined = base.join(found, base["doc_id"].eqNullSafe(found["__wl_d"]) & (base["__wl_tie"] == found["__wl_t"]), "left")

    @F.pandas_udf("text string, removed int")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = [(None, 0) if s is None else without(t, np.asarray(s)) for t, s in zip(texts, spans)]
        return pd.DataFrame(out, columns=["text", "removed"])

    hit = F.col("__wl_at").isNotNull()
    # Texts without a hit don't go through Python.
    done = joined.withColumn("__wl_cut", cut(F.when(hit, F.col("text")), "__wl_at"))
    done = done.withColumn("text", F.when(hit, F.col("__wl_cut.text")).otherwise(F.col("text")))
    own = columns_of(docs.drop("removed"))
    return done.select(*own, F.coalesce("__wl_cut.removed", F.lit(0)).alias("removed"))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col("removed").cast("long").alias("removed_sentences"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"), "text")

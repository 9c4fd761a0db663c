"""N-gram Jaccard join: a blocked sparse product of the document by n-gram matrix.

1. Every text becomes the set of its word shingles (64-bit hashes). Equal sets
   are one row of the matrix, known by the hash of the set.
2. Columns are dealt into blocks, as many as the entries need. A block's task
   sees all entries of its columns, drops columns held by one row alone (they
   overlap with nothing) and sends the rest back to row blocks, with each
   column's document count.
3. A row block orders each row's columns by count, rare first. Two sets of
   similarity t share one of the first n - ceil(t n) + 1 columns of either, so
   the product of these prefixes has all places where the whole product can
   reach t. They are its mask; rows whose rare columns are all their own are
   finished here.
4. The product is formed under the mask: a task multiplies a batch of row pairs
   column block by column block, adds up their overlap counts, and after each
   block drops the pairs that the columns to come can't lift to the bound that
   their sizes set.
5. The mask comes in two parts. First every row against its columns' pivots
   (two rows of each), which is linear in the prefix entries and connects
   groups of copies without forming their pairs. A column all of whose other
   rows are then in one component is finished. In what remains, rows of
   different components that pass the size and position bounds are multiplied
   too, so no link between components is lost.

A column that very many rows hold is dealt over tasks by its rows: facts about
it go along with every part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, components, documents, drop, even_labels, frugal, groups_of_bytes, let_go, mix64, prepare, shuffle_partitions, spread_join, text_of, written
from .texthash import shingle_sets

_TILE_BYTES = 12 << 20
PIVOTS = 2  # of a column
PARTS = 32  # that a column's rows are dealt into at most
BLOCK_ENTRIES = 1 << 22
PAIR_ROWS = 1024  # of a column that one task pairs with the others
ROUNDS = 4  # column blocks of a product


def set_key(s: np.ndarray) -> int:
    """A signed 64-bit key of a sorted set of hashes."""
    with np.errstate(over="ignore"):
        v = mix64(np.array([np.add.reduce(mix64(s + np.uint64(77))) ^ (np.uint64(len(s)) * np.uint64(0x9E3779B97F4A7C15))], np.uint64))
    return int(v.astype(np.int64)[0])


def members(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, tie, n_shingles, key) of every row; tie is the text's hash, key null for an empty set."""

    @frugal
    def find(batches):
        for pdf in batches:
            n, key = [], []
            for _, raws in groups_of_bytes(pdf["text"]):
                for s in shingle_sets(raws, words):
                    n.append(len(s))
                    key.append(set_key(s) if len(s) else None)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "tie": pdf["tie"], "n_shingles": n, "key": pd.array(key, "Int64")})

    rows = docs.select("doc_id", F.xxhash64(text_of(docs)).alias("tie"), text_of(docs).alias("text"))
    return rows.mapInPandas(find, "doc_id long, tie long, n_shingles long, key long")


def _column_tiles(docs: DataFrame, words: int, labels: list[int]) -> DataFrame:
    """Tiles (block, rows, entries): of a few megabytes of texts, the entries in one block of columns.

    rows holds (key, set size, entries here) of the distinct sets, entries their
    hashes; the block is the hash modulo the blocks.
    """
    blocks = len(labels)

    def flush(keys, sets):
        sizes = np.array([len(s) for s in sets])
        h, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        block = (h % np.uint64(blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        cuts = np.searchsorted(block[order], np.arange(blocks + 1))
        key = np.array(keys, "<i8")
        for b in np.flatnonzero(np.diff(cuts)):
            part = order[cuts[b] : cuts[b + 1]]
            own, n = np.unique(row[part], return_counts=True)
            yield labels[b], key[own].tobytes(), sizes[own].astype("<u4").tobytes(), n.astype("<u4").tobytes(), h[part].tobytes()

    @frugal
    def tiles(batches):
        names = ["block", "keys", "sizes", "counts", "entries"]
        keys, sets, seen, held = [], [], set(), 0
        for pdf in batches:
            for _, raws in groups_of_bytes(pdf["text"]):
                for s in shingle_sets(raws, words):
                    if len(s) and (k := set_key(s)) not in seen:
                        seen.add(k)
                        keys.append(k)
                        sets.append(s)
                        held += 8 * len(s)
                if held >= _TILE_BYTES:
                    yield pd.DataFrame(flush(keys, sets), columns=names)
                    keys, sets, seen, held = [], [], set(), 0
        if keys:
            yield pd.DataFrame(flush(keys, sets), columns=names)

    kind = "block long, keys binary, sizes binary, counts binary, entries binary"
    return docs.select(text_of(docs).alias("text")).mapInPandas(tiles, kind)


def _shared_tiles(tiles: DataFrame, labels: list[int]) -> DataFrame:
    """From column blocks, tiles of the columns that several rows hold, dealt by row block."""
    blocks, place = len(labels), {label: i for i, label in enumerate(labels)}

    def shared(pdf: pd.DataFrame) -> pd.DataFrame:
        let_go()
        counts = [np.frombuffer(c, "<u4") for c in pdf["counts"]]
        key = np.concatenate([np.repeat(np.frombuffer(k, "<i8"), c) for k, c in zip(pdf["keys"], counts)])
        size = np.concatenate([np.repeat(np.frombuffer(k, "<u4"), c) for k, c in zip(pdf["sizes"], counts)])
        h = np.concatenate([np.frombuffer(e, "<u8") for e in pdf["entries"]])
        order = np.argsort(h)
        h = h[order]
        new = np.concatenate([[True], h[1:] != h[:-1]])
        several = ~(new & np.concatenate([new[1:], [True]]))
        order, h = order[several], h[several]
        names = ["block", "keys", "sizes", "counts", "tokens", "freqs"]
        if not len(h):
            return pd.DataFrame([], columns=names)
        key, size = key[order], size[order]
        order = np.lexsort((key, h))  # copies of a set from different tiles are one row
        h, key, size = h[order], key[order], size[order]
        same = (h[1:] == h[:-1]) & (key[1:] == key[:-1])
        first = np.concatenate([[True], ~same])
        h, key, size = h[first], key[first], size[first]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        freq = np.diff(np.append(start, len(h)))
        token = np.repeat(np.arange(len(start)), freq)
        freq = np.repeat(freq, freq)
        keep = freq > 1
        key, size, token, freq = key[keep], size[keep], token[keep], freq[keep]
        target = (key.view(np.uint64) % np.uint64(blocks)).astype(np.int64)
        order = np.lexsort((key, target))
        cuts = np.searchsorted(target[order], np.arange(blocks + 1))
        out = []
        me = place[int(pdf["block"].iloc[0])]
        for b in np.flatnonzero(np.diff(cuts)):
            part = order[cuts[b] : cuts[b + 1]]
            own, at, n = np.unique(key[part], return_index=True, return_counts=True)
            # The column block's number, then the columns' numbers in it.
            numbers = np.append(me, token[part]).astype("<u4").tobytes()
            out.append((labels[b], own.tobytes(), size[part][at].astype("<u4").tobytes(), n.astype("<u4").tobytes(), numbers, np.minimum(freq[part], 65535).astype("<u2").tobytes()))
        return pd.DataFrame(out, columns=names)

    return tiles.groupBy("block").applyInPandas(shared, "block long, keys binary, sizes binary, counts binary, tokens binary, freqs binary")


def _prefixes(tiles: DataFrame, percent: int) -> DataFrame:
    """Rows that can have a partner: (key, n, first, prefix, tokens); first is the place of prefix[0] in the row's order."""

    def rows(pdf: pd.DataFrame) -> pd.DataFrame:
        let_go()
        counts = [np.frombuffer(c, "<u4") for c in pdf["counts"]]
        key = np.concatenate([np.repeat(np.frombuffer(k, "<i8"), c) for k, c in zip(pdf["keys"], counts)])
        size = np.concatenate([np.repeat(np.frombuffer(k, "<u4"), c) for k, c in zip(pdf["sizes"], counts)])
        token = np.concatenate([np.frombuffer(t, "<u4")[1:].astype(np.int64) | (int(np.frombuffer(t, "<u4", 1)[0]) << 32) for t in pdf["tokens"]])
        freq = np.concatenate([np.frombuffer(f, "<u2") for f in pdf["freqs"]])
        own, at, n = np.unique(key, return_index=True, return_counts=True)
        size = size[at].astype(np.int64)
        alone = size - n
        prefix = size - (percent * size + 99) // 100 + 1
        live = prefix > alone
        order = np.lexsort((token, freq, key))
        starts = np.cumsum(n) - n
        out = []
        for i in np.flatnonzero(live):
            part = token[order[starts[i] : starts[i] + n[i]]]
            out.append((own[i], size[i], alone[i], part[: prefix[i] - alone[i]], np.sort(part).astype("<i8").tobytes()))
        return pd.DataFrame(out, columns=["key", "n", "first", "prefix", "tokens"])

    return tiles.groupBy("block").applyInPandas(rows, "key long, n long, first long, prefix array<long>, tokens binary")


def _flat(rows, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The columns of the rows (sorted, as bytes) end to end, and the number of the row of each."""
    parts = [np.frombuffer(r, "<i8") if good else np.empty(0, np.int64) for r, good in zip(rows, alive)]
    return np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts])


def overlaps(left, right, n: np.ndarray, m: np.ndarray, percent: int, rounds: int = ROUNDS) -> np.ndarray:
    """Which pairs of rows (their shared columns, sorted, as bytes; set sizes n and m) reach the threshold.

    Columns are taken in `rounds` blocks. Counts add up from block to block, and
    a pair whose count, with all columns that are left to the shorter row, falls
    short of its bound is dropped.
    """
    need = percent * (n + m)
    alive = np.ones(len(n), bool)
    a, row_a = _flat(left, alive)
    b, row_b = _flat(right, alive)
    count = np.zeros(len(n), np.int64)
    left_a, left_b = np.bincount(row_a, minlength=len(n)), np.bincount(row_b, minlength=len(n))
    edges = np.unique((np.arange(1, rounds) * (int(a.max(initial=0) >> 32) + 1)) // rounds) << 32
    block_a, block_b = np.searchsorted(edges, a, "right"), np.searchsorted(edges, b, "right")
    for k in range(len(edges) + 1):
        alive &= (100 + percent) * (count + np.minimum(left_a, left_b)) >= need
        if not alive.any():
            break
        at_a, at_b = np.flatnonzero((block_a == k) & alive[row_a]), np.flatnonzero((block_b == k) & alive[row_b])
        # One key for (pair, column): columns are below 2**54, pairs of a batch below 2**9.
        x, y = (row_a[at_a] << 54) | a[at_a], (row_b[at_b] << 54) | b[at_b]
        if len(y):
            spot = np.minimum(np.searchsorted(y, x), len(y) - 1)
            count += np.bincount(row_a[at_a[y[spot] == x]], minlength=len(n))
        left_a -= np.bincount(row_a[at_a], minlength=len(n))
        left_b -= np.bincount(row_b[at_b], minlength=len(n))
    return alive & ((100 + percent) * count >= need)


def _linked(pairs: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), those whose overlap reaches the threshold: the product under the mask. Many pairs may have the same b."""

    @F.pandas_udf("boolean")
    def enough(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        let_go()
        out = [overlaps(x[i : i + 256], y[i : i + 256], n[i : i + 256].to_numpy(), m[i : i + 256].to_numpy(), percent) for i in range(0, len(x), 256)]
        return pd.Series(np.concatenate(out) if out else [])

    left = live.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = live.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    fit = (100 * F.least("na", "nb")) >= (percent * F.greatest("na", "nb"))
    pairs = written(pairs, "jaccard-mask")
    both = spread_join(pairs, right, "b", "a", PARTS).join(left, "a")
    return both.where(fit).where(enough("ta", "tb", "na", "nb")).select("a", "b")


def links(docs: DataFrame, percent: int = 75, words: int = 5, entries: int = 0) -> DataFrame:
    """Components of the rows' sets: (node, root) keys of sets that have a partner. entries: about how many the matrix has."""
    spark = prepare(docs.sparkSession)
    labels = even_labels(spark, max(shuffle_partitions(spark), min(entries // BLOCK_ENTRIES, 1 << 17)))
    live = written(_prefixes(_shared_tiles(_column_tiles(docs, words, labels), labels), percent), "jaccard-rows")
    rows = live.select("key", "n", "first", F.posexplode("prefix").alias("i", "token"))
    rows = rows.select("token", F.pmod(F.xxhash64("key"), F.lit(PARTS)).alias("part"), "key", "n", "first", (F.col("first") + F.col("i")).alias("at"))
    # Of each column's rows, two with the fewest columns of their own: an original stands among its copies so.
    row = F.struct("first", "key", "n")
    ends = rows.groupBy("token", "part").agg(F.min(row).alias("lo"), F.max(row).alias("hi"))
    heads = ends.groupBy("token").agg(F.collect_list("part").alias("parts"), F.array_sort(F.array_distinct(F.concat(F.collect_list("lo"), F.collect_list("hi")))).alias("heads"))
    heads = heads.where(F.size("heads") > 1).select("token", F.explode("parts").alias("part"), F.slice("heads", 1, PIVOTS).alias("pivots"))
    posting = rows.join(heads, ["token", "part"])
    stars = posting.select("key", "n", F.explode("pivots").alias("p")).where("key <> p.key")
    stars = stars.where((100 * F.least("n", "p.n")) >= (percent * F.greatest("n", "p.n")))
    edges = written(_linked(stars.select(F.col("key").alias("a"), F.col("p.key").alias("b")).distinct(), live, percent), "jaccard-stars")
    roots = components(edges, "jaccard-cc")
    # What is left: columns whose rows, the pivots aside (they met them all), lie in several components.
    rest = posting.where(~F.exists("pivots", lambda p: p["key"] == F.col("key"))).join(roots.withColumnRenamed("node", "key"), "key", "left")
    rest = written(rest.select("token", "part", "key", "n", "at", F.coalesce("root", "key").alias("root")), "jaccard-rest")
    mixed = rest.groupBy("token", "part").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("held"))
    mixed = mixed.groupBy("token").agg(F.collect_list("part").alias("parts"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("held").alias("held")).where("lo < hi")
    mixed = mixed.select("token", F.explode("parts").alias("part"), F.ceil(F.col("held") / PAIR_ROWS).alias("deals"))
    # With the columns that stand before this one in the row's order.
    before = F.slice("prefix", 1, (F.col("at") - F.col("first")).cast("int")).alias("before")
    open_ = rest.join(mixed, ["token", "part"]).join(live.select("key", "first", "prefix"), "key").select("token", "deals", "key", "n", "at", "root", before)
    # The rows of a much-held column are dealt out, and each deal meets all the others.
    x = open_.select("token", F.pmod(F.xxhash64("key"), "deals").alias("deal"), F.col("key").alias("a"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("root").alias("ra"), F.col("before").alias("ba"))
    y = open_.select("token", F.explode(F.sequence(F.lit(0).cast("long"), F.col("deals") - 1)).alias("deal"), F.col("key").alias("b"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("root").alias("rb"), F.col("before").alias("bb"))
    # A true pair passes these bounds at the first column that it shares, and is formed there alone.
    can = 1 + F.least(F.col("na") - F.col("ia") - 1, F.col("nb") - F.col("ib") - 1)
    need = percent * (F.col("na") + F.col("nb"))
    pairs = x.join(y, ["token", "deal"]).where("ra < rb").where(~F.arrays_overlap("ba", "bb")).where((100 + percent) * can >= need).where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    more = written(_linked(pairs.select("a", "b").distinct(), live, percent), "jaccard-pairs")
    drop(live, rest)
    if more.isEmpty():
        return roots
    # What is connected already is a star now.
    return components(roots.toDF("a", "b").union(more), "jaccard-cc")


def _joined(docs: DataFrame, percent: int, words: int) -> tuple[DataFrame, DataFrame]:
    """members of docs, and (key, root) of every non-empty set."""
    own = written(members(docs, words), "jaccard-members")
    entries = own.agg(F.sum("n_shingles")).first()[0] or 0
    roots = links(docs, percent, words, entries)
    sets = own.where("key is not null").select("key").distinct()
    return own, sets.join(roots.withColumnRenamed("node", "key"), "key", "left").select("key", F.coalesce("root", "key").alias("root"))


def component_ids(docs: DataFrame, percent: int = 75, words: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Null and empty texts have an empty set and stand alone (component_id is
    their own doc_id). Repeated rows and equal texts are one component. A row
    with a null doc_id takes its component's least id, null if there is none.
    """
    prepare(docs.sparkSession)
    own, roots = _joined(docs, percent, words)
    sets = own.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least")).join(roots, "key")
    least = sets.groupBy("root").agg(F.min("least").alias("component_id"))
    named = spread_join(sets.select("key", "root"), least, "root", "key", PARTS).select("key", "component_id")
    joined = spread_join(own.where("key is not null"), named, "key", "tie", PARTS, "doc_id")
    alone = own.where("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")).union(alone)


def one_of_each(docs: DataFrame, percent: int = 75, words: int = 5) -> DataFrame:
    """The documents without near duplicates: of each component one row.

    That is the row of the least doc_id (null ids last), of several rows with
    that id the one whose text has the least hash, and of rows alike in id and
    text any one. Rows with an empty set all stay.
    """
    prepare(docs.sparkSession)
    own, roots = _joined(docs, percent, words)
    d, null = F.coalesce("doc_id", F.lit(0).cast("long")), F.col("doc_id").isNull()
    first = own.where("key is not null").groupBy("key").agg(F.min(F.struct(null.alias("__wl_n"), d.alias("__wl_d"), F.col("tie").alias("__wl_t"))).alias("r"))
    keep = first.join(roots, "key").groupBy("root").agg(F.min("r").alias("r")).select("r.*")
    some = text_of(docs).rlike("[^\\x20\\x09-\\x0D]")
    marks = ["__wl_n", "__wl_d", "__wl_t"]
    rows = docs.where(some).withColumns({"__wl_n": null, "__wl_d": d, "__wl_t": F.xxhash64(text_of(docs))})
    rows = rows.join(keep, marks, "left_semi").dropDuplicates(marks).drop(*marks)
    return rows.select(*columns_of(docs)).union(docs.where(~some))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_ids(documents(spark, sf_dir))

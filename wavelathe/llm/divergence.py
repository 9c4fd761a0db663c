"""How the sources of a language differ in their words, by integer dictionaries.

1. A task counts the terms of its texts by group (language and source), with
   the number of documents that have them; Spark adds the counts up by term.
   Terms of too few documents of their language go.
2. A language's terms are dealt into chunks by hash. A chunk's task has a sorted
   array of its terms: a term's id is its place there (searchsorted), so ids
   stand in UTF-8 order. Counts by (group, id) become one dense row of the chunk
   a group (bincount).
3. The rows are set against each other and against the language's own row in
   whole numbers: partial sums of the pairs, which Spark adds up over chunks, and
   the best terms of each group, of which Spark takes the best over chunks.

A chunk has about CELLS cells, so that its terms are the fewer the more groups
its language has. Totals of groups come to a chunk along with its counts.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, frugal, let_go, prepare, small, text_of, written
from .texthash import pieces

CELLS = 1 << 16
HELD = 250_000  # counts of a task before it sends them on
ONE = 1_000_000_000
#: Letters (A-Z become a-z) and all bytes beyond ASCII stay; the others part terms.
_TERM_BYTES = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))
_COUNTS = "lang string, source string, term binary, n long, docs long"


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of parts of docs: occurrences, and documents with the term. Nulls are empty texts."""

    @frugal
    def count(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def sent():
            for (lang, source), (n, with_) in held.items():
                terms = list(n)
                for at in range(0, len(terms), 20_000):
                    part = terms[at : at + 20_000]
                    yield pd.DataFrame({"lang": lang, "source": source, "term": part, "n": [n[t] for t in part], "docs": [with_[t] for t in part]})
            held.clear()

        for pdf in batches:
            for lang, source, raw in zip(pdf["lang"], pdf["source"], pdf["text"]):
                n, with_ = held.setdefault((lang, source), (Counter(), Counter()))
                own = set()
                for piece in pieces(raw):
                    words = piece.translate(_TERM_BYTES).split()
                    n.update(words)
                    own.update(words)
                with_.update(own)
            if sum(len(n) for n, _ in held.values()) > HELD:
                yield from sent()
        yield from sent()

    rows = docs.select(_named(docs, "lang"), _named(docs, "source"), text_of(docs).cast("binary").alias("text"))
    return rows.mapInPandas(count, _COUNTS).withColumn("term", F.col("term").cast("string"))


def _named(docs: DataFrame, column: str):
    return F.coalesce(docs[column], F.lit("")).alias(column)


def shares(count: np.ndarray, total) -> np.ndarray:
    """1 + floor(10**9 (count + 2) / total), exactly, for count + 2 <= total; total is a number or an array."""
    if np.max(total, initial=0) >= 1 << 53:
        count, total = count.astype(object), np.asarray(total, object)
    rest, out = count + 2, 0
    for _ in range(3):  # long division, three digits at a time
        rest = rest * 1000
        out, rest = out * 1000 + rest // total, rest % total
    return (out + 1).astype(np.int64)


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def chunk_rows(counts: pd.DataFrame, groups: pd.DataFrame, top: int) -> pd.DataFrame:
    """Of one chunk of a language: (part, source, item, value) of pairs (item behind source) and of each group's best terms.

    counts: source, term, n; groups: source, total, of all groups of the
    language, and the language's number of terms.
    """
    names = ["lang", "part", "source", "item", "value"]
    if not len(counts):
        return pd.DataFrame([], columns=names)
    sources = np.sort(groups["source"].to_numpy(object))
    total = groups["total"].to_numpy(np.int64)[np.argsort(groups["source"].to_numpy(object), kind="stable")]
    lang, terms_all = counts["lang"].iloc[0], 2 * int(groups["terms"].iloc[0])
    terms = np.unique(counts["term"].to_numpy(object))
    ids = np.searchsorted(terms, counts["term"].to_numpy(object))
    group = np.searchsorted(sources, counts["source"].to_numpy(object))
    shape = len(sources), len(terms)
    n = np.bincount(group * shape[1] + ids, counts["n"].to_numpy(float), shape[0] * shape[1]).astype(np.int64).reshape(shape)
    p = shares(n, (total + terms_all)[:, None])
    q = shares(n.sum(0), int(total.sum()) + terms_all)
    out = []
    for g in range(shape[0]):
        if g + 1 < shape[0]:
            value = differences(p[g], p[g + 1 :]).sum(1)
            out.append(pd.DataFrame({"lang": lang, "part": "pair", "source": sources[g], "item": sources[g + 1 :], "value": value}))
        above = np.flatnonzero((n[g] > 0) & (p[g] > q))
        f = differences(p[g, above], q[above])
        best = np.lexsort((above, -f))[:top]
        if len(best):
            out.append(pd.DataFrame({"lang": lang, "part": "term", "source": sources[g], "item": terms[above[best]], "value": f[best]}))
    return pd.concat(out)[names] if out else pd.DataFrame([], columns=names)


def audit(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source of a language is from every other, and its most peculiar terms.

    docs has text, lang and source, null being ''; other columns are not read.
    Every (lang, source) that occurs is a group, also without texts. A language
    none of whose terms is in enough documents has pairs of value 0 and no term.
    A language of one source has no pair. Repeated rows count each; ties go by
    the item's UTF-8 bytes. No docs give no rows.
    """
    prepare(docs.sparkSession)
    # One exchange: all counts of a term of a language meet, and its groups with them.
    parts = term_counts(docs).repartition("lang", "term")
    sums = parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    whole = Window.partitionBy("lang", "term")
    sums = sums.select("*", F.sum("docs").over(whole).alias("held"), (F.min("source").over(whole) == F.col("source")).cast("long").alias("first"))
    kept = written(sums.where(F.col("held") >= least_docs).select("lang", "source", "term", "n", "first"), "divergence-kept")
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum("first").alias("terms"))
    there = docs.select(_named(docs, "lang"), _named(docs, "source")).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
    of_lang = Window.partitionBy("lang")
    groups = there.join(sizes, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce(F.sum("terms").over(of_lang), F.lit(0)).alias("terms"), F.count(F.lit(1)).over(of_lang).alias("groups"))
    groups = written(groups.withColumn("chunks", F.ceil(F.col("terms") * F.col("groups") / CELLS)), "divergence-groups")
    chunks = small(groups.groupBy("lang").agg(F.first("chunks").alias("chunks")))
    dealt = kept.join(chunks, "lang").select("lang", F.pmod(F.xxhash64("term"), "chunks").alias("chunk"), "source", "term", "n")
    facts = groups.where("chunks > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "source", "total", "terms")

    def compared(counts: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        let_go()
        return chunk_rows(counts, of, top)

    found = dealt.groupBy("lang", "chunk").cogroup(facts.groupBy("lang", "chunk")).applyInPandas(compared, "lang string, part string, source string, item string, value long")
    found = written(found, "divergence-found")
    sums = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    # Languages without a kept term: all their pairs are 0.
    bare = groups.where("chunks = 0").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source < item").withColumn("value", F.lit(0).cast("long"))
    pairs = sums.unionByName(bare)
    pairs = pairs.select("lang", F.inline(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))), "value").withColumn("part", F.lit("pair"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    out = pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms)
    return out.select("lang", "source", "part", "item", "value", "rank")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))

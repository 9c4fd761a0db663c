"""Secret scans over an incremental ledger of content-addressed blobs.

Every version of a text is a blob, addressed by the SHA-256 of its bytes. The
ledger holds the pairs (blob, rule version) that have been scanned, and the
findings of each. A run scans only pairs that the ledger lacks, each blob once
however many paths carry it, and joins findings back to all paths.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, documents, frugal, prepare, spread_join, text_of, written

RULES = "1"
#: The kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, so the same as runs of any length that are then dropped


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, by start and then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(s, e, KINDS[k]) for s, k, e in sorted(found)]


def spell(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def versions(docs: DataFrame) -> DataFrame:
    """(path, blob, text): a version of a text for each row; null texts are empty."""
    text = text_of(docs)
    return docs.select(F.col("doc_id").alias("path"), F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text"))


def scan(blobs: DataFrame, rules: str = RULES, mark: str = "[SECRET]") -> DataFrame:
    """Scan (blob, text): a row (blob, rules, spans, clean) for every blob that has a finding: spans in text form, and the text with mark in their place."""

    @frugal
    def run(batches):
        for pdf in batches:
            out = []
            for blob, text in zip(pdf["blob"], pdf["text"]):
                spans = find_spans(text)
                if spans:
                    spelt = spell(spans)
                    out.append((blob, rules, spelt, _replaced(text, spelt, mark)))
            yield pd.DataFrame(out, columns=["blob", "rules", "spans", "clean"])

    return blobs.mapInPandas(run, "blob binary, rules string, spans string, clean string")


def update(docs: DataFrame, ledger: DataFrame | None = None, findings: DataFrame | None = None, rules: str = RULES) -> tuple[DataFrame, DataFrame]:
    """Scan what the ledger (blob, rules) lacks: the new ledger rows and all findings (blob, rules, spans, clean) of these rules.

    The unseen blobs are found by key before any text moves: a blob's first
    text is taken where it stands, so copies are dropped before the shuffle.
    """
    prepare(docs.sparkSession)
    seen = versions(docs).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        seen = seen.join(ledger.where(F.col("rules") == rules).select("blob").distinct(), "blob", "left_anti")
    new = written(scan(seen, rules), "secret-findings")
    rows = versions(docs).select("blob").distinct().withColumn("rules", F.lit(rules))
    if ledger is not None:
        rows = rows.join(ledger, ["blob", "rules"], "left_anti")
    if findings is not None:
        new = new.union(findings.where(F.col("rules") == rules).select("blob", "rules", "spans", "clean"))
    return rows, new


def by_path(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, spans) of every row; spans empty where its blob has no finding."""
    own = versions(docs).select("path", "blob")
    return spread_join(own, findings.select("blob", "spans"), "blob", "path", how="left").select("path", F.coalesce("spans", F.lit("")).alias("spans"))


def cleaned(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """(doc_id, text): the next version of every row whose blob has a finding, its secrets replaced."""
    own = versions(docs).select("path", "blob")
    return spread_join(own, findings.select("blob", "clean"), "blob", "path").select(F.col("path").alias("doc_id"), F.col("clean").alias("text"))


def without_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of a finding replaced by mark; rows and columns stay, n_chars follows the text."""
    _, found = update(docs)
    text = text_of(docs)
    named = docs.withColumn("__wl_blob", F.unhex(F.sha2(text, 256)))
    joined = spread_join(named, found.select(F.col("blob").alias("__wl_blob"), F.col("spans").alias("__wl_spans")), "__wl_blob", "doc_id", how="left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if not s else _replaced(t, s, mark) for t, s in zip(texts, spans)], dtype=object)

    new = F.when(F.col("__wl_spans").isNull(), F.col("text")).otherwise(cut("text", "__wl_spans"))
    out = joined.withColumn("text", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__wl_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*columns_of(docs))


def _replaced(text: str, spans: str, mark: str) -> str:
    out, at = [], 0
    for x in spans.split(","):
        _, s, e = x.split(":")
        if int(s) >= at:
            out += [text[at : int(s)], mark]
        at = max(at, int(e))
    return "".join(out) + text[at:]


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions in the ledger: all documents, then those with findings again, cleaned; the second run scans unseen blobs alone.

    Beside the contract's columns: n_after, the spans of a row's last version.
    """
    docs = documents(spark, sf_dir)
    ledger, found = update(docs)
    ledger, found = written(ledger, "secret-ledger"), written(found, "secret-found")
    _, every = update(cleaned(docs, found), ledger, found)
    every = every.select("blob", "spans")
    last = F.sha2(F.coalesce("clean", F.lit("")), 256)
    after = found.select("blob", "spans", F.unhex(last).alias("next")).join(every.select(F.col("blob").alias("next"), F.col("spans").alias("after")), "next", "left")
    own = spread_join(versions(docs).select("path", "blob"), after.select("blob", "spans", "after"), "blob", "path", how="left")
    out = own.select(F.col("path").alias("doc_id"), F.coalesce("spans", F.lit("")).alias("spans"), F.coalesce("after", F.lit("")).alias("after"))
    kind = lambda k: F.size(F.regexp_extract_all("spans", F.lit(f"({k}):"), F.lit(1))).cast("long").alias(f"n_{k}")
    left = F.when(F.col("after") == "", 0).otherwise(F.size(F.split("after", ","))).cast("long")
    return out.select("doc_id", *map(kind, KINDS), F.sha2("spans", 256).alias("base_sha256"), "spans", left.alias("n_after"))

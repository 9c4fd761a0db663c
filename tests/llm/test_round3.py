"""Importance resampling, SimHash and the source audit against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavelathe.llm import divergence, importance, simhash
from wavelathe.llm.common import numbered, prepare, written
from wavelathe.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# -- 11 -------------------------------------------------------------------

FEATURE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, longest):
    w = FEATURE.findall(low(text))
    return w, [" ".join(w[i : i + k]) for i in range(len(w)) for k in range(1, longest + 1) if i + k <= len(w)]


def resampled_by_hand(docs, target, percent=10, least=20, longest=1, size=10000, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % size
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, runs(text, longest)[1]))
    for text in target:
        t.update(map(bucket, runs(text, longest)[1]))
    sa, ta = float(sum(s.values())), float(sum(t.values()))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (sa + size) / ((s[b] + 1.0) * (ta + size))))
    rows = []
    for i, text in docs:
        w, f = runs(text, longest)
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(w), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    part = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = defaultdict(list)
    for k, r in enumerate(part):
        rank[r].append(k + 1 if k < len(part) * percent // 100 else None)
    return sorted(((r[0], *r[2:], rank[r].pop(0) if rank[r] else None) for r in rows), key=repr)


def test_resampling_of_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = QUERIES["op11_importance_resampling"](spark, SF)
    assert got.columns[:5] == ["doc_id", "n_features", "weight", "score", "rank"] and all(t == "bigint" for _, t in got.dtypes)
    assert sorted(map(tuple, got.collect()), key=repr) == resampled_by_hand(docs, target)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resampling_of_odd_rows(spark, odd, odd_rows, monkeypatch, longest):
    monkeypatch.setattr(importance, "NODES", 50)
    target = ["w1 w2 w3 long first", None, ""]
    frame = spark.createDataFrame([(t, 1) for t in target], "text string, rank int")
    got = importance.resampled(odd, frame, percent=40, least_words=2, longest=longest, buckets=97)
    assert sorted(map(tuple, got.collect()), key=repr) == resampled_by_hand([r[:2] for r in odd_rows], target, 40, 2, longest, 97)


def test_resampling_of_empty_tables(spark, empty, odd):
    prepare(spark)
    assert importance.resampled(empty, empty).count() == 0
    got = importance.resampled(odd, empty, least_words=1, percent=100).collect()
    n = sum(r["rank"] is not None for r in got)
    assert len(got) == odd.count() and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, n + 1))


@settings(max_examples=60, deadline=None)
@given(words=st.lists(st.sampled_from([b"a", b"b", b"c9", "é".encode()]), max_size=30), cut=st.integers(0, 30), longest=st.integers(1, 4))
def test_trie_paths(words, cut, longest):
    trie, want = importance.Trie(longest), np.zeros(13, int)
    cut = min(cut, len(words))
    trie.add(words[:cut])
    carried = words[max(cut - longest + 1, 0) : cut]
    trie.add(carried + words[cut:], len(carried))
    for i in range(len(words)):
        for k in range(1, min(longest, len(words) - i) + 1):
            want[zlib.crc32(b" ".join(words[i : i + k])) % 13] += 1
    assert (trie.totals(13) == want).all()


def test_places_of_a_hot_row(spark):
    rows = written(prepare(spark).range(3000).select((F.col("id") % 3 * 0).alias("k"), F.lit("x").alias("t")), "test-hot")
    got = numbered(rows, [F.desc("k")], "place")
    assert sorted(r["place"] for r in got.collect()) == list(range(1, 3001))
    ranges = rows.withColumn("at", F.monotonically_increasing_id()).repartitionByRange(8, F.desc("k"), F.asc("at"))
    assert max(r["n"] for r in ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.count("k").alias("n")).collect()) < 1500


# -- 12 -------------------------------------------------------------------

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint_by_hand(text):
    w = SPACE.findall(low(text))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(items, radius):
    """items: (id, fingerprint); the least id of each row's component."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    fp = np.array([f for _, f in items], np.uint64)
    for i in range(len(items)):
        for j in np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= radius) + i + 1:
            root[find(int(j))] = find(i)
    ids = defaultdict(list)
    for i, (doc, _) in enumerate(items):
        ids[find(i)].append(doc)
    least = {r: min((d for d in v if d is not None), default=None) for r, v in ids.items()}
    return [least[find(i)] for i in range(len(items))]


def test_simhash_of_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(i, fingerprint_by_hand(t)) for i, t in docs]
    want = sorted((i, f"{f:016x}", c) for (i, f), c in zip(items, components_by_hand(items, 3)))
    assert sorted(map(tuple, QUERIES["op12_simhash_near_duplicates"](spark, SF).collect())) == want


def test_simhash_of_odd_rows(spark, odd, odd_rows, empty, monkeypatch):
    from wavelathe.llm import texthash

    items = [(r[0], fingerprint_by_hand(r[1])) for r in odd_rows]
    want = sorted(((i, f"{f:016x}", c) for (i, f), c in zip(items, components_by_hand(items, 3))), key=repr)
    assert sorted(map(tuple, simhash.component_ids(odd).collect()), key=repr) == want
    assert simhash.component_ids(empty).count() == 0
    monkeypatch.setattr(texthash, "PIECE", 40)
    for r in odd_rows:
        assert simhash.fingerprint((r[1] or "").encode()) == fingerprint_by_hand(r[1])


@pytest.mark.parametrize("radius", [0, 1, 3, 4, 7])
def test_bit_planes(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.concatenate([base, *[base ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, k, False))) for k in range(1, 10)]])
    q, f = simhash.within(fps[:100], simhash.planes_of(fps), len(fps), radius, list(range(64)))
    want = {(i, j) for i in range(100) for j in range(len(fps)) if int(fps[i] ^ fps[j]).bit_count() <= radius}
    assert set(zip(q.tolist(), f.tolist())) == want


@pytest.mark.parametrize(("number", "radius"), [(1, 3), (10**6, 3), (10**8, 3), (10**10, 3), (10**12, 3), (10**9, 1), (10**7, 6)])
def test_tables_miss_no_difference(number, radius):
    tables = [set(t) for t in simhash.tables_for(number, radius)]
    assert len({len(t) for t in tables}) == 1
    rng = np.random.default_rng(1)
    for _ in range(3000):
        flipped = rng.choice(64, radius, False).tolist()
        assert any(t.isdisjoint(flipped) for t in tables)


def test_links_of_large_blocks(spark, monkeypatch):
    """A chain of near fingerprints, a dense ball and random ones, in tiles that meet two by two."""
    prepare(spark)
    rng = np.random.default_rng(7)
    chain = [int(rng.integers(0, 1 << 62))]
    for _ in range(150):
        chain.append(chain[-1] ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    ball = [chain[0] ^ (0xFFFF << 40) ^ sum(1 << int(b) for b in rng.choice(30, 3, False)) for _ in range(300)]
    other = rng.integers(0, 1 << 63, 400, dtype=np.uint64).tolist()
    fps = sorted({*chain, *ball, *other})
    rows = [(i, int(np.uint64(f).view(np.int64))) for i, f in enumerate(fps)]
    monkeypatch.setattr(simhash, "TILE", 32)
    frame = written(spark.createDataFrame(rows, "least long, fp long"), "test-fps")
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(frame.select("fp"))).collect()}
    want = components_by_hand([(i, f) for i, f in enumerate(fps)], 3)
    groups = lambda keys: sorted(sorted(v) for v in _grouped(keys).values())
    assert groups([roots.get(s, s) for _, s in rows]) == groups(want)


def _grouped(keys):
    out = defaultdict(list)
    for i, k in enumerate(keys):
        out[k].append(i)
    return out


# -- 13 -------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def audit_by_hand(rows, least=10, top=10):
    """rows: (text, lang, source)."""
    n, held, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        w = TERM.findall(low(text))
        n[lang, source].update(w)
        held[lang].update(set(w))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in held[lang].items() if d >= least]
        total = {s: sum(n[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (n[lang, s][t] + 2) // (total[s] + 2 * len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(n[lang, s][t] for s in sources) + 2) // (sum(total.values()) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            terms = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:top]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(found)]
    return sorted(out)


def test_audit_of_whole_table(spark):
    docs = [(r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op13_source_divergence"](spark, SF).collect())) == audit_by_hand(docs)


@pytest.mark.parametrize("least", [1, 2, 10])
def test_audit_of_odd_rows(spark, odd, odd_rows, empty, monkeypatch, least):
    monkeypatch.setattr(divergence, "CELLS", 20)
    monkeypatch.setattr(divergence, "HELD", 10)
    got = divergence.audit(odd, least_docs=least, top=3)
    assert sorted(map(tuple, got.collect())) == audit_by_hand([r[1:4] for r in odd_rows], least, 3)
    assert divergence.audit(empty).count() == 0


@given(count=st.lists(st.integers(0, 10**17), min_size=1, max_size=5), more=st.integers(1, 10**6))
def test_exact_shares(count, more):
    total = sum(count) + 2 * more
    got = divergence.shares(np.array(count), total)
    assert got.tolist() == [1 + 10**9 * (c + 2) // total for c in count]


# -- Hot keys of earlier operators --------------------------------------------


def test_sample_has_one_row_an_id(spark):
    """An id that very many rows have counts once, by the text of the least hash."""
    from wavelathe.llm import quality

    prepare(spark)
    texts = {i: [f"good word{i} fine {j}" if i % 2 else f"bad junk{i} spam {j}" for j in range(20)] for i in range(6)}
    rows = [(i, t) for i, ts in texts.items() for t in ts]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = quality.training_rows(spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int"))
    one = docs.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    a, b = quality.fit(docs, labels), quality.fit(one, labels)
    assert (a[0] == b[0]).all() and a[1] == b[1]


def test_spread_join_keeps_rows_of_a_hot_key(spark):
    from wavelathe.llm.common import spread_join

    rows = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(300)] + [(None, -1)], "k long, i long")
    facts = spark.createDataFrame([(0, "zero"), (3, "three"), (999, "none")], "k long, f string")
    inner = spread_join(rows, facts, "k", "i", 8)
    left = spread_join(rows, facts, "k", "i", 8, how="left")
    assert sorted(map(tuple, inner.collect())) == sorted(map(tuple, rows.join(facts, "k").collect()))
    assert sorted(map(tuple, left.collect()), key=repr) == sorted(map(tuple, rows.join(facts, "k", "left").collect()), key=repr)


def test_secrets_in_a_text_that_most_rows_share(spark):
    from wavelathe.llm import secret_scan

    rows = [(i, "password = hunter22 here" if i % 3 else f"clean text {i}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in secret_scan.without_secrets(docs).collect()}
    assert got == {i: t.replace("password = hunter22", "[SECRET]") for i, t in rows}

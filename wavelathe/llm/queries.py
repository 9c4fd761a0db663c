"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from .divergence import op13_source_divergence
from .importance import op11_importance_resampling
from .jaccard import op3_ngram_jaccard_join
from .media import op9_media_columns
from .mixing import op6_mixing_sources
from .packing import op5_mixture_packing
from .quality import op1_quality_classifier
from .secret_scan import op4_secret_scans
from .sharding import op8_sharding
from .simhash import op12_simhash_near_duplicates
from .spans import op7_substring_dedup
from .tokenfile import op2_token_bit_packing
from .topk import op10_exact_topk


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_token_bit_packing": op2_token_bit_packing,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_secret_scans": op4_secret_scans,
    "op5_mixture_packing": op5_mixture_packing,
    "op6_mixing_sources": op6_mixing_sources,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_sharding": op8_sharding,
    "op9_media_columns": op9_media_columns,
    "op10_exact_topk": op10_exact_topk,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_simhash_near_duplicates": op12_simhash_near_duplicates,
    "op13_source_divergence": op13_source_divergence,
    "pipeline": pipeline,
}

ORACLE_SQL = {
    "op10_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, x.vec_id AS vec_id,
                   CAST(list_sum(list_transform(range(1, len(x.v) + 1), lambda i: q.v[i] * x.v[i])) AS BIGINT) AS score
            FROM v q JOIN v x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id AND len(q.v) = len(x.v)
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_importance_resampling": r"""
        WITH crc_table AS (
            SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
        ), texts AS (
            SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark
        ), words AS (
            SELECT side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
        ), counts AS (
            SELECT side, doc_id, word, count(*) AS n FROM (SELECT side, doc_id, unnest(w) AS word FROM words) GROUP BY ALL
        ), hexed AS (
            SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM counts)
        ), buckets AS (
            SELECT word, xor(4294967295, list_reduce(
                list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: CAST((strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1 AS BIGINT))),
                lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 10000 AS bucket
            FROM hexed, crc_table
        ), totals AS (
            SELECT bucket, sum(CASE WHEN side = 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN side = 1 THEN n ELSE 0 END) AS t FROM counts JOIN buckets USING (word) GROUP BY bucket
        ), sums AS (
            SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM totals
        ), gains AS (
            SELECT bucket, CAST(floor(1000 * ln((t::DOUBLE + 1) * (s_all + 10000) / ((s::DOUBLE + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM totals, sums
        ), weights AS (
            SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE) AS BIGINT) AS weight
            FROM counts JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY doc_id
        ), hashes AS (
            SELECT doc_id, substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS h FROM documents
        ), noise AS (
            SELECT doc_id, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: CAST(strpos('0123456789abcdef', h[i]) - 1 AS BIGINT))), lambda a, d: a * 16 + d) AS DOUBLE) AS h FROM hashes
        ), scores AS (
            SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score
            FROM noise LEFT JOIN weights USING (doc_id)
        ), drawn AS (
            SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scores WHERE n_features >= 20
        )
        SELECT s.doc_id, n_features, weight, score, CASE WHEN d.rank <= 10 * n // 100 THEN d.rank END AS rank FROM scores s LEFT JOIN drawn d USING (doc_id)
    """,
    "op13_source_divergence": r"""
        WITH words AS (
            SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
            FROM documents
        ), occurrences AS (
            SELECT lang, source, doc_id, unnest(w) AS term FROM words
        ), kept AS (
            SELECT lang, term FROM occurrences GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10
        ), counts AS (
            SELECT lang, source, term, count(*)::HUGEINT AS n FROM occurrences SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
        ), groups AS (
            SELECT DISTINCT lang, source FROM words
        ), sizes AS (
            SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source
        ), langs AS (
            SELECT l.lang, l.total, (SELECT count(*) FROM kept k WHERE k.lang = l.lang)::HUGEINT AS v FROM (SELECT lang, sum(total)::HUGEINT AS total FROM sizes GROUP BY lang) l
        ), p AS (
            SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (s.total + 2 * l.v) AS p
            FROM sizes s JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
        ), q AS (
            SELECT lang, term, 1 + 1000000000 * (sum(p.n)::HUGEINT + 2) // (any_value(l.total) + 2 * any_value(l.v)) AS q FROM p JOIN langs l USING (lang) GROUP BY lang, term
        ), sums AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), pairs AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
        ), terms AS (
            SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS BIGINT) AS value
            FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
        )
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
    """,
}

"""Queries and SQL of the corpus operators, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .op10_near_dedup import near_duplicates
from .op11_secrets import secrets
from .op12_merkle import verified
from .op13_whitening import whiten
from .op1_decontaminate import leaks
from .op2_topk import top_k
from .op3_bpe import encode_documents
from .op4_warc import captures
from .op5_language import language_id
from .op6_suffix_dedup import remove_repeats
from .op7_pii import pii
from .op8_toxicity import toxicity
from .op9_token_counts import token_counts


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op3_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def op4_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return captures(table(spark, sf_dir, "pages"))


def op5_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents")).drop("shares")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op7_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents"))


def op8_toxicity_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified(table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_mtree_topk": op2_mtree_topk,
    "op3_bpe_chunk_reuse": op3_bpe_chunk_reuse,
    "op4_warc_transactions": op4_warc_transactions,
    "op5_language_mixture": op5_language_mixture,
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op7_pii_bootstrap": op7_pii_bootstrap,
    "op8_toxicity_deobfuscation": op8_toxicity_deobfuscation,
    "op9_trie_token_counts": op9_trie_token_counts,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
    "op11_secret_ownership": op11_secret_ownership,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mtree_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op11_secret_ownership": r"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source, lang FROM documents),
        cuts AS (
            SELECT rid, 1 AS kind, regexp_extract_all(text, p) AS h, regexp_split_to_array(text, p) AS g
            FROM d, (SELECT '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+' AS p)
            UNION ALL SELECT rid, 2, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_split_to_array(text, 'AKIA[A-Z0-9]+') FROM d
            UNION ALL SELECT rid, 3, regexp_extract_all(text, '[0-9a-f]{24,}'), regexp_split_to_array(text, '[0-9a-f]{24,}') FROM d
            UNION ALL SELECT rid, 4, regexp_extract_all(text, '[A-Za-z0-9+/_.-]{12,}'), regexp_split_to_array(text, '[A-Za-z0-9+/_.-]{12,}') FROM d
            UNION ALL SELECT rid, 5, regexp_extract_all(text, '[A-Za-z0-9]{12,}'), regexp_split_to_array(text, '[A-Za-z0-9]{12,}') FROM d
        ), numbered AS (
            SELECT rid, kind, h, g, unnest(range(1, len(h) + 1)) AS i FROM cuts WHERE len(h) > 0
        ), hits AS (
            SELECT rid, kind, h[i] AS hit, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS start FROM numbered
        ), valued AS (
            SELECT rid, kind, start, hit, CASE WHEN kind = 1 THEN regexp_extract(hit, '^[^:=]*[:=]\x20*["'']?(.*)$', 1, 's') ELSE hit END AS value FROM hits
        ), base AS (
            SELECT rid, kind, start, start + length(hit) AS stop, trim(value, '+/_.=-') AS v FROM valued
            WHERE kind <= 3 AND length(value) >= CASE kind WHEN 1 THEN 6 WHEN 2 THEN 20 ELSE 24 END
        ), runs AS (
            SELECT DISTINCT rid, start + length(hit) - length(ltrim(hit, '+/_.=-')) AS start, trim(hit, '+/_.=-') AS v FROM hits
            WHERE kind > 3 AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]')
        ), bare AS (
            SELECT rid, 0 AS kind, start, start + length(v) AS stop, v FROM runs r
            WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = r.rid AND b.start < r.start + length(r.v) AND b.stop > r.start)
        ), live_looking AS (
            SELECT v, min(kind) AS kind FROM base
            WHERE length(v) >= 12 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(lower(v), 'example|sample|dummy|changeme|placeholder|your|xxxx')
              AND list_sum(list_transform(list_distinct(string_split(v, '')), lambda c: -(length(v) - length(replace(v, c, ''))) / CAST(length(v) AS DOUBLE) * log2((length(v) - length(replace(v, c, ''))) / CAST(length(v) AS DOUBLE)))) >= 2.5
            GROUP BY v
        ), places AS (
            SELECT p.rid, p.kind AS own, p.start, p.stop, p.v, c.kind, d.source, d.lang FROM (SELECT * FROM base UNION ALL SELECT * FROM bare) p JOIN live_looking c ON p.v = c.v JOIN d ON p.rid = d.rid
        ), verdict AS (
            SELECT v, count(DISTINCT coalesce('s' || source, '')) <= 2 AND count(DISTINCT coalesce('s' || source, '') || '/' || coalesce('l' || lang, '')) <= 4 AS live FROM places GROUP BY v
        ), judged AS (
            SELECT p.*, t.live FROM places p JOIN verdict t ON p.v = t.v
        ), spans AS (
            SELECT rid, kind, start, stop, true AS given FROM base
            UNION SELECT rid, kind, start, stop, false FROM judged WHERE own = 0 AND live
        ), named AS (
            SELECT rid, kind, start, stop, given, CASE kind WHEN 1 THEN 'assign' WHEN 2 THEN 'access' ELSE 'hex' END || ':' || start || ':' || stop AS span FROM spans
        ), by_row AS (
            SELECT rid, count(*) FILTER (given AND kind = 1) AS n_assign, count(*) FILTER (given AND kind = 2) AS n_access, count(*) FILTER (given AND kind = 3) AS n_hex,
                   coalesce(string_agg(span, ',' ORDER BY start, kind, stop) FILTER (given), '') AS base, string_agg(span, ',' ORDER BY start, kind, stop) AS spans FROM named GROUP BY rid
        ), told AS (
            SELECT rid, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM judged WHERE own > 0 GROUP BY rid
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
               coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
        FROM d LEFT JOIN by_row USING (rid) LEFT JOIN told USING (rid)
    """,
    "op12_merkle_manifest": """
        WITH RECURSIVE bits AS (
            SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)
        ), d AS (
            SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]))) AS crc,
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small FROM documents, bits
        ), parts AS (
            SELECT doc_id, source, crc, small, text, list_aggregate(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)], lambda x: coalesce(strlen(x) || ':' || x, '-')), 'string_agg', '') AS head FROM d
        ), leaves AS (
            SELECT doc_id, coalesce('s' || source, '') AS key, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   CASE WHEN crc % 5 = 0 THEN sha256(head || coalesce(strlen(small) || ':' || small, '-')) END AS forged,
                   row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank, count(*) OVER (PARTITION BY source) AS total FROM parts
        ), nodes AS (
            SELECT 0 AS lvl, key, rank AS idx, total AS n, leaf AS digest FROM leaves
            UNION ALL
            SELECT lvl + 1, key, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY lvl, key, n, idx // 16
        ), subroots AS (
            SELECT key, lvl AS height, digest AS subroot, row_number() OVER (ORDER BY key) - 1 AS place, count(*) OVER () AS total FROM nodes WHERE n = 1
        ), roots AS (
            SELECT 0 AS lvl, place AS idx, total AS n, subroot AS digest FROM subroots
            UNION ALL
            SELECT lvl + 1, idx // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY idx)) FROM roots WHERE n > 1 GROUP BY lvl, n, idx // 16
        ), both_tries AS (
            SELECT 0 AS stage, key, lvl, idx, n, digest FROM nodes UNION ALL SELECT 1, '', lvl, idx, n, digest FROM roots
        ), steps AS (
            SELECT stage, key, lvl, idx,
                   coalesce(string_agg(digest, '') OVER (PARTITION BY stage, key, lvl, idx // 16 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                   coalesce(string_agg(digest, '') OVER (PARTITION BY stage, key, lvl, idx // 16 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
            FROM both_tries WHERE n > 1
        ), ways AS (
            SELECT l.doc_id, l.leaf, l.forged, s.subroot, list(t.before || '|' || t.after ORDER BY t.stage, t.lvl) FILTER (t.stage IS NOT NULL) AS way
            FROM leaves l JOIN subroots s USING (key)
            LEFT JOIN steps t ON (t.stage = 0 AND t.key = l.key AND t.idx = l.rank // CAST(power(16, t.lvl) AS BIGINT)) OR (t.stage = 1 AND t.idx = s.place // CAST(power(16, t.lvl) AS BIGINT))
            GROUP BY ALL
        ), folded AS (
            SELECT doc_id, leaf, subroot, (SELECT digest FROM roots WHERE n = 1) AS root, sha256(coalesce(replace(array_to_string(way, ''), '|', ''), '')) AS proof_sha256,
                   list_reduce(list_prepend(coalesce(forged, leaf), coalesce(way, [])), lambda acc, x: sha256(split_part(x, '|', 1) || acc || split_part(x, '|', 2))) AS folded_root FROM ways
        )
        SELECT *, folded_root = root AS verified FROM folded
    """,
}

"""Queries of the numbered operators over the given tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm import bpe, decontaminate, htmltext, langid, merkle, pii, quality, repeats, sharding, simhash, topk, toxicity, vectorcodes
from harborline.llm.common import id_fold, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_fold("doc_id", 3) == 1
    model = langid.train(docs, ~held_out)
    found = langid.predict(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.span_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_fold("doc_id", 4) == 2
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    found = toxicity.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_fold("doc_id", 3) == 1
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held_out)
    found = quality.score(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.document_shards(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"))


def op10_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_texts(table(spark, sf_dir, "pages"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.vector_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_language_id": op1_language_id,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_exact_topk": op4_exact_topk,
    "op5_simhash": op5_simhash,
    "op6_quality": op6_quality,
    "op7_hilbert_sharding": op7_hilbert_sharding,
    "op8_bpe": op8_bpe,
    "op9_decontaminate": op9_decontaminate,
    "op10_suffix_repeats": op10_suffix_repeats,
    "op11_html_text": op11_html_text,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_vector_codes": op13_vector_codes,
}

ORACLE: dict[str, str] = {
    "op4_exact_topk": """
        WITH usable AS (
            SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, s.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(s.v AS DOUBLE[])) AS BIGINT) AS score
            FROM usable q JOIN usable s ON q.vec_id <> s.vec_id AND len(q.v) = len(s.v)
            WHERE q.vec_id % 20 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op12_merkle_manifest": """
        WITH RECURSIVE marked AS (
            SELECT *, xor(list_reduce(
                list_prepend(CAST(4294967295 AS UBIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
                lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST([1, 2, 3, 4, 5, 6, 7, 8] AS UBIGINT[])),
                    lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END)
            ), CAST(4294967295 AS UBIGINT)) % 5 = 0 AS hit FROM documents
        ), fields AS (
            SELECT doc_id, source, text, coalesce(hit, false) AS hit,
                CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
                || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
                || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
                || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head
            FROM marked
        ), leaves AS (
            SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
                sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || CASE WHEN hit
                    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END END) AS altered
            FROM fields
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS m
            FROM leaves
        ), up AS (
            SELECT source, 0 AS lvl, pos, leaf AS d, m FROM placed
            UNION ALL
            SELECT source, lvl + 1, pos // 16, sha256(string_agg(d, '' ORDER BY pos)), (m + 15) // 16
            FROM up WHERE m > 1 GROUP BY source, lvl, pos // 16, m
        ), tops AS (
            SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS m FROM up WHERE m = 1
        ), over_up AS (
            SELECT 0 AS lvl, pos, subroot AS d, m FROM tops
            UNION ALL
            SELECT lvl + 1, pos // 16, sha256(string_agg(d, '' ORDER BY pos)), (m + 15) // 16 FROM over_up WHERE m > 1 GROUP BY lvl, pos // 16, m
        ), runs AS (
            SELECT source, lvl, pos, string_agg(d, '') OVER (PARTITION BY source, lvl, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS whole FROM up WHERE m > 1
        ), over_runs AS (
            SELECT lvl, pos, string_agg(d, '') OVER (PARTITION BY lvl, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS whole FROM over_up WHERE m > 1
        ), steps AS (
            SELECT p.source, p.pos AS leaf_pos, 0 AS phase, r.lvl, substr(whole, 1, 64 * (r.pos % 16)) || '|' || substr(whole, 64 * (r.pos % 16) + 65) AS step
            FROM placed p JOIN runs r ON p.source IS NOT DISTINCT FROM r.source AND r.pos = p.pos // CAST(16 ** r.lvl AS BIGINT)
            UNION ALL
            SELECT p.source, p.pos, 1, r.lvl, substr(whole, 1, 64 * (r.pos % 16)) || '|' || substr(whole, 64 * (r.pos % 16) + 65)
            FROM placed p JOIN tops t ON p.source IS NOT DISTINCT FROM t.source JOIN over_runs r ON r.pos = t.pos // CAST(16 ** r.lvl AS BIGINT)
        ), paths AS (
            SELECT source, leaf_pos, list(step ORDER BY phase, lvl) AS path FROM steps GROUP BY source, leaf_pos
        ), folded AS (
            SELECT p.doc_id, p.leaf, t.subroot, (SELECT d FROM over_up WHERE m = 1) AS root,
                sha256(replace(array_to_string(coalesce(path, []), ''), '|', '')) AS proof_sha256,
                list_reduce(list_prepend(p.altered, coalesce(path, [])), lambda acc, s: sha256(replace(s, '|', acc))) AS folded_root
            FROM placed p JOIN tops t ON p.source IS NOT DISTINCT FROM t.source
            LEFT JOIN paths q ON p.source IS NOT DISTINCT FROM q.source AND p.pos = q.leaf_pos
        )
        SELECT *, folded_root = root AS verified FROM folded""",
    "op13_vector_codes": """
        WITH kept AS (
            SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
                list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS (
            SELECT r, p, v[len(v) // 16 * p + 1 : len(v) // 16 * (p + 1)] AS x FROM kept, range(16) AS t(p)
        ), book0 AS (
            SELECT p, r - 1 AS e, x AS c FROM parts WHERE r <= 64
        ), near0 AS (
            SELECT r, p, x, arg_min(e, d * 64 + e) AS e FROM (
                SELECT r, a.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts a JOIN book0 b ON a.p = b.p
            ) GROUP BY r, p, x
        ), mean0 AS (
            SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (
                SELECT p, e, i, CAST(sum(x[i]) AS DOUBLE) AS s, count(*) AS n FROM near0, range(1, 1 + (SELECT len(any_value(c)) FROM book0)) AS t(i) GROUP BY p, e, i
            ) GROUP BY p, e
        ), book1 AS (
            SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book0 b LEFT JOIN mean0 m ON b.p = m.p AND b.e = m.e
        ), near1 AS (
            SELECT r, p, x, arg_min(e, d * 64 + e) AS e FROM (
                SELECT r, a.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM parts a JOIN book1 b ON a.p = b.p
            ) GROUP BY r, p, x
        ), mean1 AS (
            SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (
                SELECT p, e, i, CAST(sum(x[i]) AS DOUBLE) AS s, count(*) AS n FROM near1, range(1, 1 + (SELECT len(any_value(c)) FROM book0)) AS t(i) GROUP BY p, e, i
            ) GROUP BY p, e
        ), book2 AS (
            SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book1 b LEFT JOIN mean1 m ON b.p = m.p AND b.e = m.e
        ), last AS (
            SELECT r, p, min(d * 64 + e) % 64 AS e, min(d) AS d FROM (
                SELECT r, a.p, e, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM parts a JOIN book2 b ON a.p = b.p
            ) GROUP BY r, p
        ), coded AS (
            SELECT vec_id, label, string_agg(lower(printf('%02x', CAST(e AS INTEGER))), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
            FROM last JOIN kept USING (r) GROUP BY r, vec_id, label
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
        FROM coded""",
}

"""One query for each operator, over its whole table and with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootweave.llm import bpe_replay, exact_dedup, packing, quality_mil, secret_scan, simhash, suffix_bpr, token_count, topk, wavelet
from rootweave.llm.common import table


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_replay.encode_documents(table(spark, sf_dir, "documents"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_bpr.spans(table(spark, sf_dir, "documents"))


def op7_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.shards(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100).withColumn("score", F.round("score", 6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_secret_scan,
        op3_exact_dedup,
        op4_quality_classifier,
        op5_byte_level_bpe,
        op6_repeated_passages,
        op7_wavelet_shards,
        op8_token_counts,
        op9_best_fit_packing,
        op10_exact_top_k,
    )
}

ORACLE: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id, group_id, n = 1 AS is_kept
        FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS group_id, count(*) OVER (PARTITION BY text) AS copies,
                     row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST) AS n
              FROM documents WHERE text IS NOT NULL)
        WHERE copies > 1""",
    "op6_repeated_passages": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
             g AS (SELECT doc_id, t.i - 1 AS b, md5(array_to_string(w[t.i:t.i + 49], ' ')) AS k FROM d, LATERAL (SELECT unnest(range(1, len(w) - 48)) AS i) t WHERE len(w) >= 50),
             f AS (SELECT doc_id, b, min(doc_id) OVER (PARTITION BY k) AS lo, max(doc_id) OVER (PARTITION BY k) AS hi FROM g),
             s AS (SELECT DISTINCT doc_id, b, doc_id = lo AS is_first FROM f WHERE lo <> hi),
             o AS (SELECT *, CASE WHEN b <= lag(b) OVER (PARTITION BY doc_id, is_first ORDER BY b) + 50 THEN 0 ELSE 1 END AS new FROM s),
             i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, is_first ORDER BY b) AS island FROM o)
        SELECT doc_id, min(b) AS word_begin, max(b) + 50 AS word_end, is_first FROM i GROUP BY doc_id, is_first, island""",
    "op10_exact_top_k": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS e FROM embeddings),
             p AS (SELECT a.r, a.vec_id, b.vec_id AS neighbor_id, b.r AS s, list_inner_product(a.e, b.e) AS score FROM v a JOIN v b ON a.r <> b.r AND a.vec_id % 100 = 0),
             n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, neighbor_id, s) AS rank FROM p)
        SELECT vec_id, rank, neighbor_id, round(score, 6) AS score FROM n WHERE rank <= 10""",
}

"""Queries of the operators in this subpackage, each over its whole table, and the SQL that checks those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bloomlm, bpe_trie, cdc, langid, packing, probminhash, rans, topk, urlfilter, webp
from .common import table


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(table(spark, sf_dir, "documents"))

def op3_columnar_branch_and_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0).drop("query_key")

def op6_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_trie.encode_documents(table(spark, sf_dir, "documents"))

#: Verdict, host and path of each rule of operator 8's query.
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def op8_hash_prefix_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)

def op5_gear_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of each document that are repeated in the corpus; documents without any have no row."""
    return cdc.repeated_passages(table(spark, sf_dir, "documents"))

def op7_probminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.classes(table(spark, sf_dir, "documents"))

def op4_string_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))

def op10_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.round_trip(table(spark, sf_dir, "documents"))

def op9_bloom_filter_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bloomlm.score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)


QUERIES = {f.__name__: f for f in (op1_hierarchical_packing, op2_rans_token_files, op3_columnar_branch_and_bound, op6_trie_bpe, op8_hash_prefix_url_filter, op5_gear_chunk_dedup, op7_probminhash_classes, op4_string_kernel_langid, op10_lossless_webp, op9_bloom_filter_lm)}

_RULES = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in URL_RULES)

ORACLES: dict[str, str] = {
    "op3_columnar_branch_and_bound": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_hash_prefix_url_filter": f"""
        WITH p AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), q AS (
            SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
        ), r(verdict, rule_host, rule_path) AS (VALUES {_RULES}
        ), m AS (
            SELECT page_id, rule_host || rule_path AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, verdict DESC) AS k
            FROM q JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        )
        SELECT q.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM q LEFT JOIN m ON q.page_id = m.page_id AND k = 1""",
}

"""One query for each operator of this subpackage, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiver.llm import (
    byte_bpe,
    line_dedup,
    near_dup,
    packing,
    preferences,
    quality_fm,
    quality_rules,
    token_counts,
    topk,
    warc,
)
from quiver.llm.common import on_all_cores, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_fm.score_documents(on_all_cores(documents), quality_fm.fit_quality(documents, labels))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_rules.quality_rules(on_all_cores(documents), quality_rules.fit_line_labels(documents, labels))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(on_all_cores(table(spark, sf_dir, "documents")), tokenizer_path("word_bpe_49k.json"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed and the text that is left."""
    return line_dedup.dedup_lines(on_all_cores(table(spark, sf_dir, "documents"))).select("doc_id", "n_lines", "n_removed", "text")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return warc.round_trip(on_all_cores(table(spark, sf_dir, "pages"))).select(*columns)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(on_all_cores(table(spark, sf_dir, "documents")), near_dup.ForestParams(words=2))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(on_all_cores(table(spark, sf_dir, "documents")), tokenizer_path("byte_bpe_50k.json"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(on_all_cores(table(spark, sf_dir, "documents")), tokenizer_path("byte_bpe_50k.json"))


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.preference_segments(preferences.adjacent_pairs(table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_quality_classifier,
            op2_exact_top_k,
            op3_quality_rules,
            op4_token_counts,
            op5_line_dedup,
            op6_warc,
            op7_near_duplicates,
            op8_bpe_round_trip,
            op9_best_fit_packing,
            op10_preference_format,
        )
    }


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

# base32 of a digest: every 5 hexadecimal digits are 4 letters
WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS hex FROM p),
n AS (
  SELECT page_id, payload_bytes, hex, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS top,
         list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(1 + 5 * i AS INTEGER), 5) AS BIGINT)) AS fives
  FROM d),
b AS (
  SELECT *, array_to_string(list_transform(fives, lambda x:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (x // 32768) AS INTEGER), 1)
      || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (x // 1024) % 32 AS INTEGER), 1)
      || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + (x // 32) % 32 AS INTEGER), 1)
      || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + x % 32 AS INTEGER), 1)), '') AS digest
  FROM n)
SELECT page_id, payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM b
"""


def oracle_sql() -> dict[str, str]:
    """The queries that SQL can express over whole tables."""
    return {"op2_exact_top_k": TOP_K_SQL, "op6_warc": WARC_SQL, "op10_preference_format": preferences.SQL}

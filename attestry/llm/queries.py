"""Queries over whole tables for the operators of this subpackage, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestry.llm import components, history, packing, pieces, pii, tokens, truncation
from attestry.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(table(spark, sf_dir, "facts")).select("fact_id")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.report(table(spark, sf_dir, "facts"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.repeats(table(spark, sf_dir, "jobs").select("id", "created_at", "sha256"), table(spark, sf_dir, "qr_hits"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components.job_groups(table(spark, sf_dir, "pairs"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = pii.review_and_code_texts(table(spark, sf_dir, "reviews"), table(spark, sf_dir, "qr_hits"))
    return pii.located(texts, table(spark, sf_dir, "name_parts")).select("origin", "record_id", "kind", "start_pos")


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = pii.review_and_code_texts(table(spark, sf_dir, "reviews"), table(spark, sf_dir, "qr_hits"))
    return pii.located(texts, table(spark, sf_dir, "name_parts"), redacted=True)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(table(spark, sf_dir, "documents"), ["doc_id"])


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill(p8_packed(spark, sf_dir))


def p9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split(table(spark, sf_dir, "documents"), ["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_report, p2_found, p3_found, p4_found, p4_redacted, p7_ids, p8_packed, p8_report, p9_pieces)}


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """
            WITH RECURSIVE ends AS (
              SELECT nullif(regexp_replace(lower(job_id), '[\\s{}-]+', '', 'g'), '') AS a, nullif(regexp_replace(lower(other_id), '[\\s{}-]+', '', 'g'), '') AS b
              FROM pairs WHERE lower(trim(coalesce(pair_type, ''))) <> 'face near miss'
            ), edges AS (
              SELECT a, b FROM ends WHERE a <> b UNION SELECT b, a FROM ends WHERE a <> b
            ), reach(n, m) AS (
              SELECT a, a FROM edges UNION SELECT r.n, e.b FROM reach r JOIN edges e ON e.a = r.m
            )
            SELECT n AS job_id, min(m) AS group_id FROM reach GROUP BY n
        """,
    }

"""Queries for drifting schemas and nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestry.operators import drift, nested
from attestry.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.drift(table(spark, sf_dir, "export_records"))


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.unified(table(spark, sf_dir, "export_records"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.children(table(spark, sf_dir, "jobs"))


QUERIES = {f.__name__: f for f in (p5_found, p5_unified, p6_found)}

def _opened(x: str) -> str:
    """A JSON value, or what a string holds that is JSON text."""
    return f"CASE WHEN json_type({x}) = 'VARCHAR' AND json_valid(json_extract_string({x}, '$')) THEN CAST(json_extract_string({x}, '$') AS JSON) ELSE {x} END"


_ENTRIES = "CASE json_type(x) WHEN 'ARRAY' THEN json_extract(x, '$[*]') WHEN 'OBJECT' THEN [x] ELSE [] END"

SQL: dict[str, str] = {
    "p6_found": f"""
        WITH p AS (SELECT DISTINCT id, CAST(payload_json AS JSON) AS doc FROM jobs WHERE json_valid(payload_json)),
        d AS (SELECT id, {_opened('doc')} AS doc FROM p), s AS (SELECT id, {_opened("json_extract(doc, '$.results')")} AS results FROM d),
        r AS (
          SELECT id, key AS analyzer_id, json_extract(results, '$."' || key || '"') AS e FROM (SELECT id, results, unnest(json_keys(results)) AS key FROM s WHERE json_type(results) = 'OBJECT')
          UNION ALL SELECT id, json_extract_string(e, '$.analyzer_id'), e FROM (SELECT id, unnest(json_extract(results, '$[*]')) AS e FROM s WHERE json_type(results) = 'ARRAY')
        ),
        q AS (SELECT id, analyzer_id, coalesce(json_extract(e, '$.result'), e) AS e FROM r),
        c AS (SELECT id, analyzer_id, json_extract(e, '$.regions') AS regions, {_opened("json_extract(e, '$.check')")} AS chk, {_opened("json_extract(e, '$.raw')")} AS raw FROM q),
        l AS (
          SELECT id, analyzer_id, 'region' AS child, {_opened('regions')} AS x FROM c
          UNION ALL SELECT id, analyzer_id, 'fact', {_opened("json_extract(chk, '$.facts')")} FROM c
        ),
        a AS (SELECT id, analyzer_id, child, {_ENTRIES} AS es FROM l),
        m AS (SELECT id, analyzer_id, {_opened("json_extract(raw, '$.pages')")} AS x FROM c),
        pg AS (SELECT id, analyzer_id, {_ENTRIES} AS es FROM m),
        pi AS (SELECT id, analyzer_id, i - 1 AS ord, es[i] AS pgx FROM (SELECT *, unnest(range(1, len(es) + 1)) AS i FROM pg)),
        pr AS (SELECT id, analyzer_id, ord, {_opened("json_extract(pgx, '$.regions')")} AS x FROM pi),
        pe AS (SELECT id, analyzer_id, ord, {_ENTRIES} AS es FROM pr)
        SELECT id AS job_id, analyzer_id, child, i - 1 AS ord, CAST(-1 AS BIGINT) AS sub_ord FROM (SELECT *, unnest(range(1, len(es) + 1)) AS i FROM a) WHERE json_type(es[i]) <> 'NULL'
        UNION ALL SELECT id, analyzer_id, 'page_region', ord, i - 1 FROM (SELECT *, unnest(range(1, len(es) + 1)) AS i FROM pe) WHERE json_type(es[i]) <> 'NULL'""",
}

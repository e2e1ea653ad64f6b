"""Queries: reporting over jobs, reviews, facts and events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import grading, ordered, reports, store
from attestry.session import table

NOW = datetime(2026, 7, 1)
_JOBS = "SELECT DISTINCT id, batch_id, batch_position, filename, sha256, status, created_at, started_at, completed_at, owner_user_id, flagged, check_contract_version FROM jobs"


def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.kpis(store.jobs(spark, sf_dir))


def type_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_type(store.jobs(spark, sf_dir))


def volume_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.volume(store.jobs(spark, sf_dir), "created_at", NOW, 30, 10)


def turnaround(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over batches of their jobs' mean seconds."""
    j = store.jobs(spark, sf_dir).where("batch_id is not null").withColumn("s", reports.seconds("started_at", "completed_at"))
    return reports.turnaround(j, "batch_id", "s")


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.outcomes(reports.results_of(table(spark, sf_dir, "jobs").select("id", "payload_json")))


def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, verdict, authenticity, failed, ran) of every job."""
    j = store.jobs(spark, sf_dir).select("id", "status")
    marked = reports.cases(table(spark, sf_dir, "jobs").select("id", "payload_json")).select("id", "unanalyzable")
    return reports.verdicts(j.join(marked, "id"), outcomes(spark, sf_dir))


def flag_reasons_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five analyzers with most results to review."""
    n = outcomes(spark, sf_dir).where("outcome = 'review'").groupBy("analyzer_id").agg(F.count("*").alias("flags"))
    return n.orderBy(F.desc("flags"), "analyzer_id").limit(5)


def machine_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdict_rows(spark, sf_dir).select("job_id", "verdict", "authenticity")


def verdict_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machine_verdicts(spark, sf_dir).groupBy("verdict").agg(F.count("*").alias("jobs"), F.round(F.avg("authenticity"), 4).alias("authenticity"))


def flag_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored flags against the latest decisions: a job that needs investigation or is escalated is a true case."""
    r = store.latest(table(spark, sf_dir, "reviews").where("job_id is not null"), "job_id", "reviewed_at", "review_id").select("job_id", "decision")
    j = store.jobs(spark, sf_dir).select("id", "flagged").join(r, F.col("id") == F.col("job_id"))
    return reports.confusion(j, F.coalesce(F.col("flagged") == 1, F.lit(False)), F.coalesce(F.col("decision").isin("needs_investigation", "escalated"), F.lit(False)))


def decisions_by_reviewer(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["verified", "needs_investigation", "escalated", "inconclusive"]
    return table(spark, sf_dir, "reviews").groupBy("reviewer").agg(*(F.count_if(F.col("decision") == k).alias(k) for k in kinds), F.max("reviewed_at").alias("last_reviewed_at"))


def flagged_three_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches by three readings of flagged: a result to review or failed, whatever the job's state; the document's verdict; the status of its checks. Documents marked unanalyzable are none."""
    marked = reports.cases(table(spark, sf_dir, "jobs").select("id", "payload_json")).select("id", "unanalyzable")
    checked = F.coalesce("checked", F.create_map(*(F.lit(x) for x in ("review", "fail", "error", "error", "clear", "pass")))[F.col("outcome")])
    n = outcomes(spark, sf_dir).groupBy(F.col("job_id").alias("id")).agg(F.bool_or(F.col("outcome").isin("review", "error")).alias("outcomes"), F.bool_or(checked.isin("fail", "error")).alias("checks"))
    shown = verdict_rows(spark, sf_dir).select(F.col("job_id").alias("id"), F.col("verdict").isin("review", "error").alias("shown"))
    j = store.jobs(spark, sf_dir).where("batch_id is not null").select("id", "batch_id").join(marked, "id").join(n, "id", "left").join(shown, "id")
    able = ~F.col("unanalyzable")
    return j.groupBy("batch_id").agg(F.count_if(able & F.col("outcomes")).alias("by_outcome"), F.count_if("shown").alias("by_verdict"), F.count_if(able & F.col("checks")).alias("by_check"))


def facts_by_source_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "facts")
    blank = F.coalesce(F.trim("value") == "", F.lit(True))
    return f.groupBy("source", "label").agg(F.count("*").alias("facts"), F.count_if(blank).alias("blank"), F.count_distinct("job_id").alias("jobs"), F.max(F.char_length("value")).alias("longest"))


def unknown_analyzers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyzers that facts name and the service's catalogue lacks."""
    return table(spark, sf_dir, "facts").select("analyzer_id").distinct().where(~F.col("analyzer_id").isin(grading.ANALYZERS))


def numeric_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display values as numbers: 37% as 0.37, 87/100 as 87, plain numbers as they are; the rest stays text."""
    v = F.trim("value")
    percent = F.regexp_extract(v, r"^(-?\d+(?:\.\d+)?)\s*%$", 1)
    score = F.regexp_extract(v, r"^(-?\d+(?:\.\d+)?)\s*/\s*100$", 1)
    number = F.when(percent != "", percent.try_cast("double") / 100).when(score != "", score.try_cast("double")).when(F.rlike(v, F.lit(r"^-?\d+(\.\d+)?$")), v.try_cast("double"))
    return table(spark, sf_dir, "facts").where("value is not null").groupBy("label").agg(F.count(number).alias("numbers"), F.round(F.sum(number), 3).alias("total"), F.count_if(number.isNull()).alias("texts"))


def late_completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that completed more than a week after they came in, with the running number of such jobs of their batch."""
    late = store.jobs(spark, sf_dir).where((reports.seconds("created_at", "completed_at") > 7 * 86400) & F.col("batch_id").isNotNull())
    return ordered.numbered(late.select("batch_id", "id", "completed_at"), "batch_id", ["completed_at", "id"]).select("batch_id", "id", "n")


def stale_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stale(store.jobs(spark, sf_dir), 3).groupBy("check_contract_version", "status").agg(F.count("*").alias("jobs"))


QUERIES = {f.__name__: f for f in (kpis, type_breakdown, volume_buckets, turnaround, flag_reasons_top5, machine_verdicts, verdict_histogram, flag_agreement, decisions_by_reviewer, flagged_three_ways, facts_by_source_label, unknown_analyzers, numeric_facts, late_completions, stale_contracts)}

LATEST = "SELECT * FROM reviews WHERE job_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY reviewed_at DESC, review_id DESC) = 1"
RESULTS = """
    WITH p AS (SELECT DISTINCT id, status, payload_json FROM jobs),
    v AS (SELECT id, status, CASE WHEN json_valid(payload_json) THEN CASE WHEN json_type(payload_json) = 'VARCHAR' THEN json_extract_string(payload_json, '$') ELSE payload_json END END AS doc FROM p),
    w AS (SELECT id, status, CASE WHEN json_valid(doc) THEN doc END AS doc FROM v),
    m AS (SELECT id, unnest(json_keys(doc, '$.results')) AS key, doc FROM w WHERE json_type(doc, '$.results') = 'OBJECT'),
    r AS (
      SELECT id, key AS analyzer_id, json_extract(doc, '$.results."' || key || '"') AS result FROM m
      UNION ALL
      SELECT id, json_extract_string(e, '$.analyzer_id') AS analyzer_id, coalesce(json_extract(e, '$.result'), e) AS result
      FROM (SELECT id, unnest(json_extract(doc, '$.results[*]')) AS e FROM w WHERE json_type(doc, '$.results') = 'ARRAY')
    )
"""
#: Results with their outcome and the status of their check, JSON text or not.
OUTCOMES = RESULTS + """,
    o AS (SELECT id, analyzer_id, json_extract_string(result, '$.outcome') AS outcome, coalesce(json_extract_string(result, '$.check.status'), CASE WHEN json_valid(json_extract_string(result, '$.check')) THEN json_extract_string(json_extract_string(result, '$.check'), '$.status') END) AS checked FROM r),
    c AS (SELECT id, status, doc, coalesce(json_extract_string(doc, '$.unanalyzable') = 'true', false) AS unanalyzable FROM w)
"""
VERDICTS = OUTCOMES + """,
    g AS (SELECT id, count_if(outcome <> 'info') AS graded, count_if(outcome = 'review') AS review, count_if(outcome = 'error') AS error, count_if(outcome = 'clear') AS clear, count(*) AS ran FROM o GROUP BY 1),
    verdicts AS (SELECT c.id AS job_id, CASE WHEN c.unanalyzable THEN 'unanalyzable' WHEN c.status <> 'completed' THEN 'pending' WHEN coalesce(g.graded, 0) = 0 THEN 'inconclusive' WHEN g.review > 0 THEN 'review' WHEN g.error > 0 THEN 'error' WHEN g.clear = g.graded THEN 'clear' ELSE 'inconclusive' END AS verdict,
      CAST(round_even(100.0 * g.clear / nullif(g.graded, 0), 0) AS INTEGER) AS authenticity, coalesce(g.review + g.error, 0) AS failed, coalesce(g.ran, 0) AS ran FROM c LEFT JOIN g USING (id))
"""
_S = "(epoch_us(completed_at) - epoch_us({}_at)) / 1e6"

SQL = {
    "kpis": f"WITH j AS ({_JOBS}) SELECT count_if(status = 'completed') AS screened, count_if(status = 'completed' AND flagged = 1) AS flagged, count_if(status = 'completed') - count_if(status = 'completed' AND flagged = 1) AS clean, count_if(status <> 'completed') AS processing, CAST(round_even(100.0 * count_if(status = 'completed' AND flagged = 1) / count_if(status = 'completed'), 0) AS INTEGER) AS flag_rate FROM j",
    "type_breakdown": f"""
        WITH j AS ({_JOBS}), t AS (SELECT *, lower(regexp_extract(filename, '\\.([^.\\s]+)\\s*$', 1)) AS ext FROM j WHERE status = 'completed'),
        n AS (SELECT CASE WHEN ext = 'pdf' THEN 'PDF' WHEN ext IN ('jpg', 'jpeg') THEN 'JPEG' WHEN ext = 'png' THEN 'PNG' WHEN ext = '' THEN 'Other' ELSE upper(ext) END AS file_type, count(*) AS screened, count_if(flagged = 1) AS flagged, avg({_S.format('started')}) AS s FROM t GROUP BY 1)
        SELECT file_type, screened, CAST(round_even(100.0 * (screened - flagged) / screened, 0) AS INTEGER) AS clean_percent, flagged, round(s, 3) AS average_seconds, round(screened / sum(screened) OVER (), 6) AS share FROM n""",
    "volume_buckets": f"WITH j AS ({_JOBS}) SELECT CAST(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(created_at)) / 2592000000000) AS INTEGER) AS bucket, count(*) AS n FROM j WHERE created_at <= TIMESTAMP '{NOW}' GROUP BY 1 HAVING bucket BETWEEN 0 AND 9",
    "turnaround": f"WITH j AS ({_JOBS}), m AS (SELECT batch_id, coalesce(avg({_S.format('started')}), 0) AS mean FROM j WHERE batch_id IS NOT NULL GROUP BY 1) SELECT count(*) AS jobs, round(avg(mean), 4) AS average FROM m",
    "flag_reasons_top5": RESULTS + "SELECT analyzer_id, count(*) AS flags FROM r WHERE json_extract_string(result, '$.outcome') = 'review' GROUP BY 1 ORDER BY flags DESC, analyzer_id LIMIT 5",
    "machine_verdicts": VERDICTS + "SELECT job_id, verdict, authenticity FROM verdicts",
    "verdict_histogram": VERDICTS + "SELECT verdict, count(*) AS jobs, round(avg(authenticity), 4) AS authenticity FROM verdicts GROUP BY 1",
    "flag_agreement": f"""
        WITH j AS ({_JOBS}), r AS ({LATEST}), b AS (SELECT coalesce(j.flagged = 1, false) AS p, coalesce(r.decision IN ('needs_investigation', 'escalated'), false) AS a FROM j JOIN r ON r.job_id = j.id),
        c AS (SELECT count_if(p AND a) AS tp, count_if(p AND NOT a) AS fp, count_if(NOT p AND a) AS fn, count_if(NOT p AND NOT a) AS tn FROM b)
        SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c""",
    "decisions_by_reviewer": "SELECT reviewer, count_if(decision = 'verified') AS verified, count_if(decision = 'needs_investigation') AS needs_investigation, count_if(decision = 'escalated') AS escalated, count_if(decision = 'inconclusive') AS inconclusive, max(reviewed_at) AS last_reviewed_at FROM reviews GROUP BY 1",
    "flagged_three_ways": VERDICTS
    + """, n AS (SELECT id, bool_or(outcome IN ('review', 'error')) AS outcomes, bool_or(coalesce(checked, CASE outcome WHEN 'review' THEN 'fail' WHEN 'error' THEN 'error' WHEN 'clear' THEN 'pass' END) IN ('fail', 'error')) AS checks FROM o GROUP BY 1), j AS (SELECT DISTINCT id, batch_id FROM jobs WHERE batch_id IS NOT NULL)
        SELECT j.batch_id, count_if(NOT c.unanalyzable AND n.outcomes) AS by_outcome, count_if(v.verdict IN ('review', 'error')) AS by_verdict, count_if(NOT c.unanalyzable AND n.checks) AS by_check FROM j JOIN c USING (id) LEFT JOIN n USING (id) JOIN verdicts v ON v.job_id = j.id GROUP BY 1""",
    "facts_by_source_label": "SELECT source, label, count(*) AS facts, count_if(coalesce(trim(value, ' ') = '', true)) AS blank, count(DISTINCT job_id) AS jobs, CAST(max(length(value)) AS INTEGER) AS longest FROM facts GROUP BY 1, 2",
    "unknown_analyzers": "SELECT DISTINCT analyzer_id FROM facts WHERE analyzer_id NOT IN ('metadata', 'font_analysis', 'signature', 'photo_detection', 'qr_presence', 'tamper_scan', 'moire', 'same_phone', 'readability')",
    "numeric_facts": """
        WITH n AS (SELECT label, CASE WHEN regexp_matches(trim(value, ' '), '^-?\\d+(\\.\\d+)?\\s*%$') THEN CAST(regexp_extract(value, '-?\\d+(\\.\\d+)?') AS DOUBLE) / 100
          WHEN regexp_matches(trim(value, ' '), '^-?\\d+(\\.\\d+)?\\s*/\\s*100$') THEN CAST(regexp_extract(value, '-?\\d+(\\.\\d+)?') AS DOUBLE)
          WHEN regexp_matches(trim(value, ' '), '^-?\\d+(\\.\\d+)?$') THEN CAST(trim(value, ' ') AS DOUBLE) END AS x FROM facts WHERE value IS NOT NULL)
        SELECT label, count(x) AS numbers, round(sum(x), 3) AS total, count_if(x IS NULL) AS texts FROM n GROUP BY 1""",
    "late_completions": f"WITH j AS ({_JOBS}) SELECT batch_id, id, row_number() OVER (PARTITION BY batch_id ORDER BY completed_at, id) AS n FROM j WHERE {_S.format('created')} > 604800 AND batch_id IS NOT NULL",
    "stale_contracts": f"WITH j AS ({_JOBS}) SELECT check_contract_version, status, count(*) AS jobs FROM j WHERE check_contract_version < 3 GROUP BY 1, 2",
}

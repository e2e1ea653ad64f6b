"""Queries: detector payloads graded by rule, manifests, clusters of near boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import grading, linkage, reports, store
from attestry.plans import reporting
from attestry.plans.listings import _KEY, _REACH
from attestry.plans.reporting import LATEST, RESULTS, VERDICTS
from attestry.session import table
from attestry.sources import sinks


def raws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, pos, analyzer_id, raw): stored payloads; those of jobs delivered twice come twice, for reports.once after the projection."""
    held = reports.results_of(table(spark, sf_dir, "jobs").select("id", "payload_json"))
    raw = F.try_variant_get("result", "$.raw", "variant")
    return held.select("job_id", "pos", "analyzer_id", raw.alias("raw")).where("raw is not null and not is_variant_null(raw)")


def graded_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every raw payload of every job under its analyzer's rule."""
    graded = reports.once(grading.normalized(raws(spark, sf_dir)).select("job_id", "pos", "analyzer_id", "status", "outcome", "risk", "findings_count"))
    return graded.groupBy("analyzer_id", "status", "outcome", "risk").agg(F.count("*").alias("results"), F.sum("findings_count").alias("findings"))


def check_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The criterion, reason, facts and summary of every raw payload's check, each as often as it occurs."""
    graded = grading.normalized(raws(spark, sf_dir)).select("job_id", "pos", "analyzer_id", "summary", "check.criterion", "check.reason", F.array_join(F.transform("check.facts", lambda f: F.concat_ws("=", f["label"], f["value"])), "; ").alias("facts"))
    return reports.once(graded).groupBy("analyzer_id", "criterion", "reason", "facts", "summary").agg(F.count("*").alias("results"))


def regraded_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of jobs under an older contract graded anew from their stored payloads: the status that was stored, and the one now."""
    held = reports.results_of(table(spark, sf_dir, "jobs").where("check_contract_version < 3").select("id", "payload_json"))
    raw = F.try_variant_get("result", "$.raw", "variant")
    rows = held.select("job_id", "pos", "analyzer_id", F.try_variant_get("result", "$.check.status", "string").alias("was"), raw.alias("raw")).where("raw is not null and not is_variant_null(raw)")
    now = reports.once(grading.normalized(rows).select("job_id", "pos", "analyzer_id", "was", "status"))
    return now.groupBy("analyzer_id", "was", F.col("status").alias("now")).agg(F.count("*").alias("results"))


def payload_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What else raw payloads state, by analyzer, key and value."""
    rows = grading.evidence(raws(spark, sf_dir)).select("job_id", "analyzer_id", "key", "value").distinct()
    return rows.groupBy("analyzer_id", "key", "value").agg(F.count("*").alias("jobs"))


def regraded_tamper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page probabilities of scans combined to the document's, against the threshold stored with them."""
    scans = raws(spark, sf_dir).select("job_id", "pos", "analyzer_id", F.coalesce(grading.get(F.col("raw"), "$.review_threshold", "double"), F.lit(0.35)).alias("threshold"), F.posexplode(F.try_variant_get("raw", "$.pages", "array<variant>")).alias("page_pos", "p"))
    each = scans.select("job_id", "pos", "analyzer_id", "threshold", "page_pos", F.try_variant_get("p", "$.probability", "double").alias("probability")).where("probability is not null").dropDuplicates(["job_id", "pos", "page_pos"])
    whole = each.groupBy("job_id", "analyzer_id", "threshold").agg(F.round(F.least(1 - F.product(1 - F.col("probability")), F.lit(0.98)), 6).alias("probability"), F.count("*").alias("pages"))
    return whole.select("job_id", "analyzer_id", "pages", "probability", (F.col("probability") >= F.col("threshold")).alias("review"))


def batch_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of every batch's CSV."""
    j = store.jobs(spark, sf_dir).where("batch_id is not null")
    cases = reports.cases(table(spark, sf_dir, "jobs").select("id", "payload_json"))
    r = store.latest(table(spark, sf_dir, "reviews").where("job_id is not null"), "job_id", "reviewed_at", "review_id").select("job_id", "decision", "reviewer", "assigned_to", "reviewed_at", "notes")
    rows = sinks.batch_rows(j, cases, reporting.verdict_rows(spark, sf_dir), reporting.outcomes(spark, sf_dir), r)
    return rows.drop("batch_position", "reviewed_at")


def manifest_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of jobs against what their payloads say."""
    said = table(spark, sf_dir, "jobs").select("id", F.try_variant_get(F.try_parse_json("payload_json"), "$.filename", "string").alias("filename")).where("filename is not null").dropDuplicates(["id"])
    return sinks.manifest_difference(store.jobs(spark, sf_dir).select("id", "filename"), said)


def storage_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.jobs(spark, sf_dir).groupBy(F.substring(sinks.shard(F.col("id")), 1, 2).alias("place")).agg(F.count("*").alias("jobs"))


def face_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of jobs that matching faces connect."""
    p = linkage.confirmed(table(spark, sf_dir, "pairs").where((F.col("pair_type") == "Same face") & (F.col("score") >= linkage.FACE_MATCH)))
    c = linkage.clusters(p, "job_id", "other_id")
    return c.groupBy("label").agg(F.count("*").alias("jobs"))


QUERIES = {f.__name__: f for f in (graded_results, check_bodies, regraded_checks, payload_evidence, regraded_tamper, batch_report_rows, manifest_difference, storage_places, face_groups)}

#: The rules over what stored payloads hold: a status, the effort of the search, pages, a threshold.
_GRADED = RESULTS + """,
    x AS (SELECT id, analyzer_id, json_extract(result, '$.raw') AS raw FROM r WHERE json_type(result, '$.raw') = 'OBJECT'),
    y AS (SELECT *, lower(trim(coalesce(json_extract_string(raw, '$.status'), ''))) = 'error' AS broken, lower(trim(coalesce(json_extract_string(raw, '$.search_effort'), ''))) AS effort, CAST(round_even(100 * coalesce(CAST(json_extract_string(raw, '$.review_threshold') AS DOUBLE), 0.35), 0) AS BIGINT) || '%' AS lim FROM x),
    graded AS (SELECT *, CASE WHEN broken THEN 'error' WHEN analyzer_id = 'metadata' THEN 'info' WHEN analyzer_id IN ('font_analysis', 'signature', 'qr_presence') THEN 'fail' ELSE 'inconclusive' END AS status FROM y)
"""

SQL = {
    "graded_results": _GRADED + "SELECT analyzer_id, status, CASE status WHEN 'fail' THEN 'review' ELSE status END AS outcome, 'unknown' AS risk, count(*) AS results, CAST(0 AS BIGINT) AS findings FROM graded GROUP BY 1, 2",
    "check_bodies": _GRADED
    + """SELECT analyzer_id,
        CASE analyzer_id WHEN 'metadata' THEN 'States how the file was made; neither passes nor fails.' WHEN 'font_analysis' THEN 'Passes with at least one embedded font; references to fonts do not count.' WHEN 'signature' THEN 'Passes with 1 or more signatures.' WHEN 'photo_detection' THEN 'Passes with a photo of a person.'
          WHEN 'qr_presence' THEN 'Passes with 1 or more decoded codes.' WHEN 'tamper_scan' THEN 'Passes with a probability of correction fluid below ' || lim || '.' WHEN 'moire' THEN 'Passes without a screen or reprint pattern.' WHEN 'same_phone' THEN 'Passes if all pages fit one capture device; needs two pages.' ELSE 'Passes if the document can be read by machine.' END AS criterion,
        CASE WHEN broken THEN 'The check could not run: the detector stopped with an error.' WHEN analyzer_id = 'metadata' THEN 'No metadata was recorded in this run.' WHEN analyzer_id = 'font_analysis' THEN 'No font is embedded.' WHEN analyzer_id = 'signature' THEN 'No signature was found.' WHEN analyzer_id = 'photo_detection' THEN 'The detector did not say whether there is a photo.'
          WHEN analyzer_id = 'qr_presence' THEN 'No code was decoded; searched: ' || CASE effort WHEN 'low' THEN 'one resolution' WHEN 'medium' THEN 'a ladder of resolutions, four rotations' WHEN 'high' THEN 'a wide ladder of resolutions, four rotations' ELSE 'the configured resolution and rotations' END || '.'
          WHEN analyzer_id = 'tamper_scan' THEN 'The detector gave no probability.' WHEN analyzer_id = 'moire' THEN 'There was no raster image to analyse.' WHEN analyzer_id = 'same_phone' THEN 'The comparison gave no verdict.' ELSE 'The checker gave no verdict.' END AS reason,
        CASE WHEN broken OR analyzer_id IN ('metadata', 'photo_detection', 'tamper_scan', 'same_phone') THEN '' WHEN analyzer_id = 'font_analysis' THEN 'Embedded fonts=0; Embedded font objects=0' WHEN analyzer_id = 'signature' THEN 'Signatures found=0; Required=1'
          WHEN analyzer_id = 'qr_presence' THEN 'QR codes found=0; Required=1' || CASE WHEN effort = '' THEN '' ELSE '; Search effort=' || upper(left(effort, 1)) || substr(effort, 2) END WHEN analyzer_id = 'moire' THEN 'Images analysed=0' ELSE 'Failed sub-tests=None' END AS facts,
        CASE WHEN broken THEN 'Analyzer failed' WHEN analyzer_id = 'font_analysis' THEN 'No embedded fonts' WHEN analyzer_id = 'photo_detection' THEN 'No document photo detected' WHEN status = 'inconclusive' THEN 'Analysis inconclusive' ELSE 'Analysis completed' END AS summary, count(*) AS results FROM graded GROUP BY ALL""",
    "regraded_checks": _GRADED.replace("SELECT id, analyzer_id, json_extract(result, '$.raw') AS raw FROM r", "SELECT id, analyzer_id, result, json_extract(result, '$.raw') AS raw FROM r").replace("WITH p AS (SELECT DISTINCT id, status, payload_json FROM jobs)", "WITH p AS (SELECT DISTINCT id, status, payload_json FROM jobs WHERE check_contract_version < 3)")
    + "SELECT analyzer_id, json_extract_string(result, '$.check.status') AS was, status AS now, count(*) AS results FROM graded GROUP BY 1, 2, 3",
    "payload_evidence": RESULTS
    + """, x AS (SELECT DISTINCT id, analyzer_id, json_extract(result, '$.raw') AS raw FROM r WHERE json_type(result, '$.raw') = 'OBJECT'), k AS (SELECT id, analyzer_id, raw, unnest(json_keys(raw)) AS key FROM x),
        e AS (SELECT DISTINCT id, analyzer_id, key, json_extract_string(raw, '$.' || key) AS value FROM k WHERE key NOT IN ('status', 'pages') AND json_type(raw, '$.' || key) IN ('VARCHAR', 'DOUBLE', 'BIGINT', 'UBIGINT', 'BOOLEAN'))
        SELECT analyzer_id, key, value, count(*) AS jobs FROM e WHERE trim(value) <> '' GROUP BY ALL""",
    "regraded_tamper": RESULTS + """,
        raws AS (SELECT id, analyzer_id, json_extract(result, '$.raw') AS raw FROM r),
        e AS (SELECT id, analyzer_id, coalesce(CAST(json_extract_string(raw, '$.review_threshold') AS DOUBLE), 0.35) AS threshold, unnest(json_extract(raw, '$.pages[*]')) AS p FROM raws WHERE json_type(raw, '$.pages') = 'ARRAY'),
        d AS (SELECT id, analyzer_id, threshold, round(least(1 - product(1 - x), 0.98), 6) AS probability, count(*) AS pages FROM (SELECT *, CAST(json_extract_string(p, '$.probability') AS DOUBLE) AS x FROM e) WHERE x IS NOT NULL GROUP BY 1, 2, 3)
        SELECT id AS job_id, analyzer_id, pages, probability, probability >= threshold AS review FROM d""",
    "batch_report_rows": VERDICTS
    + f""", l AS ({LATEST}), j AS (SELECT DISTINCT id, batch_id, filename, sha256 FROM jobs WHERE batch_id IS NOT NULL), fl AS (SELECT id, string_agg(analyzer_id, '; ' ORDER BY analyzer_id) AS flagged FROM o WHERE outcome IN ('review', 'error') GROUP BY 1)
        SELECT j.batch_id, j.filename AS document, j.id AS case_id, coalesce(j.sha256, '') AS sha256, coalesce(left(trim(json_extract_string(c.doc, '$.profile.name')), 80), '') AS screening_test,
          CASE v.verdict WHEN 'review' THEN 'Needs review' WHEN 'error' THEN 'Check errors' WHEN 'clear' THEN 'Clear' WHEN 'pending' THEN 'Screening incomplete' WHEN 'unanalyzable' THEN 'Marked unanalyzable' ELSE 'Inconclusive' END AS machine_verdict,
          CASE coalesce(l.decision, '') WHEN '' THEN 'Not yet recorded' WHEN 'verified' THEN 'Verified' WHEN 'needs_investigation' THEN 'Needs investigation' WHEN 'inconclusive' THEN 'Inconclusive' WHEN 'escalated' THEN 'Escalated to a second reviewer' ELSE upper(left(replace(l.decision, '_', ' '), 1)) || lower(substr(replace(l.decision, '_', ' '), 2)) END AS reviewer_decision,
          coalesce(l.reviewer, '') AS reviewer, coalesce(l.assigned_to, '') AS assigned_to, coalesce(fl.flagged, '') AS flagged_checks, v.ran AS checks_run, regexp_replace(coalesce(l.notes, ''), '\\r\\n|\\n', ' ', 'g') AS notes, '0.2' AS app_version, '0.2' AS detectors_version
        FROM j JOIN c USING (id) LEFT JOIN verdicts v ON v.job_id = j.id LEFT JOIN l ON l.job_id = j.id LEFT JOIN fl ON fl.id = j.id""",
    "manifest_difference": """
        WITH j AS (SELECT DISTINCT id, filename, payload_json FROM jobs), d AS (SELECT id, CASE WHEN json_valid(payload_json) THEN json_extract_string(payload_json, '$.filename') END AS filename FROM j), s AS (SELECT * FROM d WHERE filename IS NOT NULL)
        SELECT id, filename, 'missing' AS side FROM (SELECT id, filename FROM j EXCEPT ALL SELECT id, filename FROM s) UNION ALL SELECT id, filename, 'unexpected' FROM (SELECT id, filename FROM s EXCEPT ALL SELECT id, filename FROM j)""",
    "storage_places": "SELECT left(sha256(id), 2) AS place, count(*) AS jobs FROM (SELECT DISTINCT id FROM jobs) GROUP BY 1",
    "face_groups": f"""
        WITH RECURSIVE e AS (SELECT {_KEY.format('job_id')} AS a, {_KEY.format('other_id')} AS b FROM pairs WHERE pair_type = 'Same face' AND score >= 0.35), g AS (SELECT a, b FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b), {_REACH}
        SELECT label, count(*) AS jobs FROM (SELECT n, min(m) AS label FROM reach GROUP BY n) GROUP BY 1""",
}

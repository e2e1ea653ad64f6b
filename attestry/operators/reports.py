"""Operational reporting: totals, reasons, types, periods, turnaround, agreement."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """A whole percentage, halves to even; null of nothing."""
    return F.bround(F.try_divide(100.0 * part, whole), 0).cast("int")


def kpis(jobs: DataFrame) -> DataFrame:
    """One row: screened, flagged, clean, processing, flag_rate."""
    done = F.count_if(F.col("status") == "completed")
    flagged = F.count_if((F.col("status") == "completed") & (F.col("flagged") == 1))
    return jobs.agg(done.alias("screened"), flagged.alias("flagged"), F.greatest(F.lit(0), done - flagged).alias("clean"), F.count_if(F.col("status") != "completed").alias("processing"), percent(flagged, done).alias("flag_rate"))


def file_type(filename: Column) -> Column:
    ext = F.lower(F.regexp_extract(filename, r"\.([^.\s]+)\s*$", 1))
    return F.when(ext == "pdf", "PDF").when(ext.isin("jpg", "jpeg"), "JPEG").when(ext == "png", "PNG").when(ext == "", "Other").otherwise(F.upper(ext))


def seconds(a: str, b: str) -> Column:
    """Seconds from ``a`` to ``b``, with fractions."""
    return (F.unix_micros(F.col(b).cast("timestamp")) - F.unix_micros(F.col(a).cast("timestamp"))) / 1e6


def by_type(jobs: DataFrame) -> DataFrame:
    """(file_type, screened, clean_percent, flagged, average_seconds, share) of completed jobs."""
    done = jobs.where("status = 'completed'").withColumn("file_type", file_type(F.col("filename")))
    own = done.groupBy("file_type").agg(
        F.count("*").alias("screened"), F.count_if(F.col("flagged") == 1).alias("flagged"), F.avg(seconds("started_at", "completed_at")).alias("average_seconds")
    )
    share = F.col("screened") / F.sum("screened").over(Window.partitionBy(F.lit(1)))  # a row a file type
    return own.select("file_type", "screened", percent(F.col("screened") - F.col("flagged"), F.col("screened")).alias("clean_percent"), "flagged", F.round("average_seconds", 3).alias("average_seconds"), F.round(share, 6).alias("share"))


def volume(rows: DataFrame, at: str, now: datetime, days: int, buckets: int) -> DataFrame:
    """(bucket, n): buckets of ``days`` back from ``now``, bucket 0 the latest, each open at its start and closed at its end."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    bucket = F.floor(age / F.lit(days * 86_400_000_000)).cast("int")
    return rows.where(age >= 0).groupBy(bucket.alias("bucket")).count().withColumnRenamed("count", "n").where((F.col("bucket") >= 0) & (F.col("bucket") < buckets))


def turnaround(runs: DataFrame, job: str, value: str) -> DataFrame:
    """One row: the mean over jobs of each job's mean; jobs without a value count as 0."""
    own = runs.groupBy(job).agg(F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"))
    return own.agg(F.count("*").alias("jobs"), F.round(F.avg("mean"), 4).alias("average"))


def confusion(rows: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row: tp, fp, fn, tn, precision, recall."""
    c = {"tp": predicted & actual, "fp": predicted & ~actual, "fn": ~predicted & actual, "tn": ~predicted & ~actual}
    counted = rows.agg(*(F.count_if(v).alias(k) for k, v in c.items()))
    return counted.select("*", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"))


def verdict(unanalyzable: Column, status: Column, review: Column, error: Column, clear: Column, graded: Column) -> Column:
    """A document's verdict from the counts of its results by outcome (those that are only informative left out)."""
    return (
        F.when(unanalyzable, "unanalyzable")
        .when(status != "completed", "pending")
        .when(graded == 0, "inconclusive")
        .when(review > 0, "review")
        .when(error > 0, "error")
        .when(clear == graded, "clear")
        .otherwise("inconclusive")
    )


def root(payload: str = "payload_json") -> Column:
    """A payload as a VARIANT, JSON text in a string as what it holds; null where it is unreadable."""
    once = F.try_parse_json(payload)
    return F.when(F.schema_of_variant(once) == "STRING", F.try_parse_json(F.try_variant_get(once, "$", "string"))).otherwise(once)


def results_of(jobs: DataFrame) -> DataFrame:
    """``(job_id, pos, analyzer_id, result)``: the results in payload_json, a VARIANT each, whatever the payload's shape.

    Results may be a map by analyzer or a list, wrapped or not, and the
    payload itself a string of JSON; unreadable payloads give no rows. Rows of
    a job delivered twice come twice: :func:`once` after the projection, which
    is small, is cheaper than before it.
    """
    held = jobs.select(F.col("id").alias("job_id"), F.try_variant_get(root(), "$.results", "variant").alias("results"))
    each = held.lateralJoin(held.sparkSession.tvf.variant_explode(F.col("results").outer())).where("value is not null and schema_of_variant(value) like 'OBJECT%'")
    inner = F.coalesce(F.try_variant_get("value", "$.result", "variant"), F.col("value"))
    own = F.coalesce(F.col("key"), F.try_variant_get("value", "$.analyzer_id", "string"), F.try_variant_get(inner, "$.analyzer_id", "string"))
    return each.select("job_id", "pos", own.alias("analyzer_id"), inner.alias("result"))


def once(results: DataFrame) -> DataFrame:
    """Rows of results, already cut to small columns, without those of jobs delivered twice."""
    return results.dropDuplicates(["job_id", "pos"])


def cases(jobs: DataFrame) -> DataFrame:
    """What payload_json says of a job itself: (id, analyzers, unanalyzable, profile, goal, guidance, threshold, runs), one row a job.

    runs maps analyzers to the status of their run.
    """
    r = jobs.select("id", root().alias("r"))
    text = lambda path: F.try_variant_get("r", path, "string")
    runs = F.transform_values(F.coalesce(F.try_variant_get("r", "$.analyzer_runs", "map<string,variant>"), F.create_map().cast("map<string,variant>")), lambda _, v: F.try_variant_get(v, "$.status", "string"))
    cut = r.select(
        "id", F.coalesce(F.try_variant_get("r", "$.analyzers", "array<string>"), F.array().cast("array<string>")).alias("analyzers"), F.coalesce(F.try_variant_get("r", "$.unanalyzable", "boolean"), F.lit(False)).alias("unanalyzable"),
        F.nullif(F.left(F.trim(text("$.profile.name")), F.lit(80)), F.lit("")).alias("profile"), F.left(F.trim(F.coalesce(text("$.profile.goal"), F.lit(""))), F.lit(400)).alias("goal"), F.left(F.trim(F.coalesce(text("$.profile.guidance"), F.lit(""))), F.lit(2000)).alias("guidance"),
        text("$.settings.tamper_scan.review_threshold").alias("threshold"), F.to_json(runs).alias("runs"),
    )
    return cut.dropDuplicates(["id"]).withColumn("runs", F.from_json("runs", "map<string,string>"))


def outcomes(results: DataFrame) -> DataFrame:
    """``(job_id, pos, analyzer_id, outcome, checked)`` of results: the outcome, and the status of its check."""
    check = F.coalesce(F.try_variant_get("result", "$.check.status", "string"), F.try_variant_get(F.try_parse_json(F.try_variant_get("result", "$.check", "string")), "$.status", "string"))
    return once(results.select("job_id", "pos", "analyzer_id", F.try_variant_get("result", "$.outcome", "string").alias("outcome"), check.alias("checked")))


def verdicts(jobs: DataFrame, found: DataFrame) -> DataFrame:
    """``(job_id, verdict, authenticity, failed, ran)`` from jobs (id, status, unanalyzable) and :func:`outcomes`.

    The verdict, the percentage of graded results that are clear, how many
    results need review or failed, and how many there are.
    """
    is_ = lambda o: F.count_if(F.col("outcome") == o)
    n = found.groupBy("job_id").agg(F.count_if(F.col("outcome") != "info").alias("graded"), *(is_(o).alias(o) for o in ("review", "error", "clear")), F.count("*").alias("ran"))
    joined = jobs.join(n, jobs["id"] == n["job_id"], "left").na.fill(0, ["graded", "review", "error", "clear", "ran"])
    kept = verdict(F.col("unanalyzable"), F.col("status"), F.col("review"), F.col("error"), F.col("clear"), F.col("graded"))
    return joined.select(F.col("id").alias("job_id"), kept.alias("verdict"), percent(F.col("clear"), F.nullif(F.col("graded"), F.lit(0))).alias("authenticity"), (F.col("review") + F.col("error")).alias("failed"), "ran")


#: What verdicts and decisions are called, and in what order verdicts are listed.
VERDICT_LABELS = {"review": "Needs review", "error": "Check errors", "clear": "Clear", "inconclusive": "Inconclusive", "pending": "Screening incomplete", "unanalyzable": "Marked unanalyzable"}
DECISION_LABELS = {"verified": "Verified", "needs_investigation": "Needs investigation", "inconclusive": "Inconclusive", "escalated": "Escalated to a second reviewer"}
ANALYZER_LABELS = {"tamper_scan": "Whitener Detection", "photo_detection": "Document Photo", "qr_presence": "QR Presence"}
VERDICT_RANK = {"error": 0, "review": 1, "unanalyzable": 2, "inconclusive": 2, "pending": 3, "clear": 4}


def named(key: Column, names: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[key]


def verdict_label(v: Column) -> Column:
    return F.coalesce(named(v, VERDICT_LABELS), F.lit("Inconclusive"))


def decision_label(d: Column) -> Column:
    words = F.translate(d, "_", " ")
    other = F.concat(F.upper(F.left(words, F.lit(1))), F.lower(F.substring(words, 2, 999)))
    return F.when(F.coalesce(d, F.lit("")) == "", "Not yet recorded").otherwise(F.coalesce(named(d, DECISION_LABELS), other))


def analyzer_label(a: Column) -> Column:
    return F.coalesce(named(a, ANALYZER_LABELS), F.initcap(F.translate(a, "_", " ")))

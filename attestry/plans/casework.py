"""Queries: documents, batches and pages as a reviewer sees them: sheets, matrices, progress, histories, states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.operators import features, grading, ordered, pages, reports, signals, store, windows
from attestry.plans import evidence, grades, listings, reporting
from attestry.plans.listings import _SIGNALS
from attestry.plans.reporting import LATEST, OUTCOMES, RESULTS, VERDICTS
from attestry.session import table

#: Labels whose facts are numbers, by analyzer and kind.
NUMERIC = {
    "metadata": {"Pages": "int", "Pages with a text layer": "int", "Embedded images": "int", "Annotations": "int"}, "font_analysis": {"Embedded fonts": "int", "Embedded font objects": "int"},
    "photo_detection": {"Photos found": "int", "Page": "int", "Face confidence": "percent", "Blur score": "number", "Brightness": "number"}, "same_phone": {"Pages analysed": "int", "Same-phone score": "score", "Lowest pair score": "number"},
    "moire": {"Images analysed": "int"}, "qr_presence": {"QR codes found": "int"}, "signature": {"Signatures found": "int", "Highest confidence": "percent"},
}
#: Facts whose count says whether something is present, by analyzer.
PRESENCE = {"photo_detection": "Photos found", "qr_presence": "QR codes found", "signature": "Signatures found"}


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.cases(table(spark, sf_dir, "jobs").select("id", "payload_json"))


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(job_id, pos, analyzer_id, label, value): the facts of results' checks that are labelled objects."""
    held = reports.results_of(table(spark, sf_dir, "jobs").select("id", "payload_json"))
    rows = held.select("job_id", "pos", "analyzer_id", F.posexplode(F.try_variant_get("result", "$.check.facts", "array<variant>")).alias("n", "f"))
    cut = rows.select("job_id", "pos", "analyzer_id", "n", F.try_variant_get("f", "$.label", "string").alias("label"), F.try_variant_get("f", "$.value", "string").alias("value"))
    return cut.where("label is not null and value is not null").dropDuplicates(["job_id", "pos", "n"])


def job_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each analyzer that a job asked for, in order, with the status of its run and the outcome and status of its result, if there is one."""
    c = _cases(spark, sf_dir)
    asked = c.select(F.col("id").alias("job_id"), "runs", F.posexplode("analyzers").alias("position", "analyzer_id"))
    found = reporting.outcomes(spark, sf_dir).select("job_id", "analyzer_id", "outcome", F.col("checked").alias("result"))
    run = F.coalesce(F.col("runs")[F.col("analyzer_id")], F.lit("queued"))
    return asked.select("job_id", "position", "analyzer_id", run.alias("run")).join(found, ["job_id", "analyzer_id"], "left")


def typed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of checks as numbers where their label is one of numbers and they can be read so, else as text; by label how many and what they add up to."""
    f = _facts(spark, sf_dir).withColumn("value", F.trim("value"))
    kinds = F.create_map(*(F.lit(x) for a, labels in NUMERIC.items() for label, kind in labels.items() for x in (f"{a}|{label}", kind)))
    kind = kinds[F.concat_ws("|", "analyzer_id", "label")]
    plain = F.col("value").try_cast("double")
    percent = F.when(F.endswith("value", F.lit("%")), F.regexp_replace("value", "%$", "").try_cast("double") / 100).otherwise(plain)
    number = F.when(kind == "percent", percent).when(kind == "score", F.substring_index("value", "/", 1).try_cast("double")).when(kind.isNotNull(), plain)
    n = f.select("analyzer_id", "label", number.alias("number"), F.when(number.isNull(), F.col("value")).alias("text"))
    return n.groupBy("analyzer_id", "label").agg(F.count("number").alias("numbers"), F.round(F.sum("number"), 4).alias("total"), F.count("text").alias("texts"))


def derived_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Y or N where a check's facts say whether something is there, was edited or recaptured; blank where they do not."""
    held = _facts(spark, sf_dir).where(F.col("label").isin(*PRESENCE.values(), "Re-saved after creation", "Created", "Modified", "File verdict"))
    names = {"photos": "Photos found", "codes": "QR codes found", "signatures": "Signatures found", "saved": "Re-saved after creation", "created": "Created", "modified": "Modified", "verdict": "File verdict"}
    m = held.groupBy("job_id", "pos", "analyzer_id").agg(*(F.max(F.when(F.col("label") == label, F.trim("value"))).alias(name) for name, label in names.items()))
    count = F.coalesce(*(F.when(F.col("analyzer_id") == a, F.col(c)) for a, c in (("photo_detection", "photos"), ("qr_presence", "codes"), ("signature", "signatures"))))
    n = F.substring_index(count, " ", 1).try_cast("int")
    edited = F.when(F.lower("saved") == "yes", "Y").when((F.col("created") != "") & (F.col("modified") != "") & (F.col("created") != F.col("modified")), "Y").when((F.lower("saved") == "no") | (F.col("created") != "") | (F.col("modified") != ""), "N")
    flag = F.when(F.col("analyzer_id").isin(*PRESENCE), F.when(n > 0, "Y").when(n.isNotNull(), "N")).when(F.col("analyzer_id") == "metadata", edited).when(F.col("analyzer_id") == "moire", F.when(F.col("verdict") == "Recapture", "Y").when(F.col("verdict") == "Clean", "N"))
    return m.groupBy("analyzer_id", F.coalesce(flag, F.lit("")).alias("flag")).agg(F.count("*").alias("results"))


def page_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each page of each document: what each check found on it; null where the check was not run."""
    return pages.sheet(reports.once(pages.page_values(grades.raws(spark, sf_dir)))).drop("font_names")


def summary_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document: its profile, verdict, share of clear checks, failed checks and the signals that link it to others."""
    linked = listings._signals(spark, sf_dir).where("pair_type <> 'Face near miss'")
    name = F.create_map(*(F.lit(x) for x in ("Identical file", "hash", "Same QR payload", "QR", "Same face", "face")))[F.col("pair_type")]
    own = linked.select(F.explode(F.array("job_id", "other_id")).alias("id"), name.alias("signal")).distinct().groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("signal")), ", ").alias("signals"))
    v = reporting.verdict_rows(spark, sf_dir).withColumnRenamed("job_id", "id")
    c = _cases(spark, sf_dir).select("id", F.coalesce("profile", F.lit("")).alias("profile"))
    return v.join(c, "id").join(own, "id", "left").select("id", "profile", reports.verdict_label(F.col("verdict")).alias("verdict"), "authenticity", F.coalesce("signals", F.lit("")).alias("signals"), "failed")


def duplicate_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the code and the photo sheet say of a document's likeness to others: a name, or why there is none."""
    j = store.jobs(spark, sf_dir).select("id", "filename")
    held = listings.payload_first_holder(spark, sf_dir).select(F.col("job_id").alias("id"), "status", F.col("first_id").alias("of"))
    names = j.select(F.col("id").alias("of"), F.col("filename").alias("of_name"))
    faces = listings._signals(spark, sf_dir).where("score is not null").groupBy(F.col("job_id").alias("id")).agg(F.max("score").alias("similarity"))
    joined = j.join(held, "id", "left").join(names, "of", "left").join(faces, "id", "left")
    code = F.when(F.col("status").isNull(), "No QR code to compare").when(F.col("status") == "new", "Unique in this batch").otherwise(F.coalesce("of_name", F.lit("")))
    photo = F.when(F.col("similarity").isNull(), "Not compared").when(F.col("similarity") >= 0.35, "Match").otherwise("No match")
    return joined.select("id", code.alias("code"), photo.alias("photo"), "similarity")


def case_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each batch whose name or id holds 'a', the worst verdicts first, then by position: place and page of twenty."""
    v = reporting.verdict_rows(spark, sf_dir).select(F.col("job_id").alias("id"), "verdict")
    j = store.jobs(spark, sf_dir).where("batch_id is not null").where(F.contains(F.lower("filename"), F.lit("a")) | F.contains(F.lower("id"), F.lit("a"))).select("id", "batch_id", "batch_position")
    ranked = j.join(v, "id").withColumn("rank", reports.named(F.col("verdict"), reports.VERDICT_RANK))
    n = ordered.numbered(ranked, "batch_id", ["rank", "batch_position", "id"], "place")
    return n.select("batch_id", "id", "verdict", "place", F.floor((F.col("place") - 1) / 20).alias("page"))


def batch_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each batch: runs asked for and done, documents completed, clear, to review, failed, and with a failed check."""
    j = store.jobs(spark, sf_dir).where("batch_id is not null").select("id", "batch_id", "status")
    c = _cases(spark, sf_dir).select("id", F.size("analyzers").alias("asked"))
    n = reporting.outcomes(spark, sf_dir).groupBy(F.col("job_id").alias("id")).agg(F.count_if(F.col("outcome") == "error").alias("errors"))
    v = reporting.verdict_rows(spark, sf_dir).select(F.col("job_id").alias("id"), "verdict", "ran")
    g = j.join(c, "id").join(v, "id").join(n, "id", "left").groupBy("batch_id").agg(
        F.sum("asked").alias("asked"), F.sum("ran").alias("done"), F.count_if(F.col("status") == "completed").alias("completed"), *(F.count_if(F.col("verdict") == x).alias(x) for x in ("clear", "review", "error")), F.count_if(F.col("errors") > 0).alias("with_errors")
    )
    return g.withColumn("percent", F.coalesce(F.floor(F.try_divide(100 * F.col("done"), F.col("asked")) + 0.5), F.lit(0)).cast("int"))


def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document: results by the status of their check, how many grade it, and when it was last analysed."""
    o = reporting.outcomes(spark, sf_dir)
    status = F.coalesce("checked", F.create_map(*(F.lit(x) for x in ("review", "fail", "error", "error", "clear", "pass", "info", "info", "inconclusive", "inconclusive")))[F.col("outcome")])
    n = o.withColumn("s", status).groupBy("job_id").agg(F.count("*").alias("results"), *(F.count_if(F.col("s") == k).alias(k) for k in ("pass", "fail", "error", "inconclusive")), F.count_if(~F.col("s").eqNullSafe("info")).alias("graded"))
    last = store.jobs(spark, sf_dir).select(F.col("id").alias("job_id"), F.col("completed_at").alias("last_analysed_at"))
    return n.join(last, "job_id")


def first_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each batch and analyzer the status of the first document's check, by position."""
    j = store.jobs(spark, sf_dir).where("batch_id is not null").select(F.col("id").alias("job_id"), "batch_id", "batch_position")
    o = reporting.outcomes(spark, sf_dir).where("checked is not null")
    return o.join(j, "job_id").groupBy("batch_id", "analyzer_id").agg(F.min_by("checked", F.struct("batch_position", "pos")).alias("first_status"))


def batch_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each batch the profile it ran under, Mixed for several, and its analyzers in the order in which its documents name them."""
    j = store.jobs(spark, sf_dir).where("batch_id is not null").select("id", "batch_id", "batch_position")
    c = _cases(spark, sf_dir).select("id", "analyzers", "profile")
    both = j.join(c, "id")
    named = both.groupBy("batch_id").agg(F.count_distinct("profile").alias("n"), F.min("profile").alias("one"))
    first = both.select("batch_id", "batch_position", F.posexplode("analyzers").alias("n", "analyzer")).groupBy("batch_id", "analyzer").agg(F.min(F.struct("batch_position", "n")).alias("at"))
    columns = first.groupBy("batch_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "analyzer"))), lambda x: x["analyzer"]), ",").alias("analyzers"))
    return named.join(columns, "batch_id", "left").select("batch_id", F.when(F.col("n") == 1, F.col("one")).when(F.col("n") > 1, "Mixed").alias("profile"), F.coalesce("analyzers", F.lit("")).alias("analyzers"))


def history_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches with what their case says, decided documents and decisions, most flagged first, then newest."""
    v = reporting.verdict_rows(spark, sf_dir).select(F.col("job_id").alias("id"), F.col("verdict").isin("review", "error").alias("bad"), (F.col("verdict") == "error").alias("failed"))
    r = store.latest(table(spark, sf_dir, "reviews").where("job_id is not null"), "job_id", "reviewed_at", "review_id").select(F.col("job_id").alias("id"), "decision")
    j = store.jobs(spark, sf_dir).where("batch_id is not null").join(v, "id").join(r, "id", "left")
    n = j.groupBy("batch_id").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("flagged") == 1).alias("flagged"), F.bool_or("failed").alias("errors"), F.count("decision").alias("decided"), F.array_join(F.array_sort(F.collect_set("decision")), ",").alias("decisions"))
    b = table(spark, sf_dir, "batches").select(F.col("id").alias("batch_id"), "created_at").join(n, "batch_id")
    said = F.when(F.col("completed") < F.col("documents"), "In progress").when(F.col("flagged") > 0, F.format_string("%d flagged", "flagged")).when(F.col("errors"), "Check errors").otherwise("All clear")
    placed = ordered.numbered(b.withColumn("one", F.lit(1)).withColumn("low", -F.col("flagged")).withColumn("age", -F.unix_micros(F.col("created_at").cast("timestamp"))), "one", ["low", "age", "batch_id"], "place")
    return placed.select("batch_id", said.alias("case_verdict"), "documents", "decided", "decisions", "place")


def recent_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight documents of the eight newest batches, in the order of the batches, and which of them head the queue of those to review, four at most."""
    newest = table(spark, sf_dir, "batches").orderBy(F.desc("created_at"), F.desc("id")).limit(8).select(F.col("id").alias("batch_id"), "created_at")
    v = reporting.verdict_rows(spark, sf_dir).select(F.col("job_id").alias("id"), "verdict")
    rows = store.jobs(spark, sf_dir).select("id", "batch_id", "batch_position").join(newest, "batch_id")
    eight = rows.orderBy(F.desc("created_at"), F.desc("batch_id"), "batch_position", "id").limit(8).join(v, "id")
    bad = F.col("verdict").isin("review", "error")
    w = Window.orderBy(F.desc("created_at"), F.desc("batch_id"), "batch_position", "id").rowsBetween(Window.unboundedPreceding, 0)  # eight rows
    return eight.withColumn("queue", F.when(bad & (F.count_if(bad).over(w) <= 4), F.count_if(bad).over(w))).select("id", "batch_id", "verdict", "queue")


def requested_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by how many of the analyzers they ask for the service has (all of its own if none), and whether they drifted from their batch's first document."""
    known = F.array(*(F.lit(a) for a in grading.ANALYZERS))
    j = store.jobs(spark, sf_dir).where("batch_id is not null").select("id", "batch_id", "batch_position")
    both = j.join(_cases(spark, sf_dir).select("id", "analyzers"), "id")
    first = both.groupBy("batch_id").agg(F.min_by("analyzers", F.struct("batch_position", "id")).alias("first"))
    used = F.size(F.array_intersect("analyzers", known))
    return both.join(first, "batch_id").select(F.when(used > 0, used).otherwise(F.size(known)).alias("used"), (F.array_sort("analyzers") != F.array_sort("first")).alias("drifted")).groupBy("used", "drifted").agg(F.count("*").alias("jobs"))


def degraded_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each batch the checks that some document asked for and has no result of, sorted, and in how many documents."""
    c = job_checks(spark, sf_dir).where("outcome is null").select("job_id", "analyzer_id")
    j = store.jobs(spark, sf_dir).where("batch_id is not null").select(F.col("id").alias("job_id"), "batch_id")
    return c.join(j, "job_id").groupBy("batch_id").agg(F.array_join(F.array_sort(F.collect_set("analyzer_id")), ",").alias("checks"), F.count_distinct("job_id").alias("documents"))


def whitener_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each tamper scan: analysed, with evidence, indeterminate, regions; and the verdict by the job's threshold."""
    held = grades.raws(spark, sf_dir).where("analyzer_id = 'tamper_scan'").select("job_id", "pos", grading.number(F.col("raw"), "$.review_threshold").alias("at"), grading.objects(F.col("raw"), "$.pages").alias("p"))
    n = held.where("size(p) > 0").select(
        "job_id", "pos", "at", F.size("p").alias("analysed"), F.size(F.filter("p", lambda x: F.size(grading.items(x, "$.regions")) > 0)).alias("with_evidence"), F.size(F.filter("p", lambda x: grading.truthy(x, "$.indeterminate"))).alias("indeterminate"),
        F.aggregate("p", F.lit(0), lambda s, x: s + F.size(grading.items(x, "$.regions"))).alias("regions"), F.array_max(F.transform("p", lambda x: grading.get(x, "$.probability", "double"))).alias("highest"),
    )
    return reports.once(n).select("job_id", "pos", "analysed", "with_evidence", "indeterminate", "regions", signals.whitener_review(F.col("highest"), F.coalesce("at", F.lit(0.35)), F.col("analysed"), F.col("indeterminate")).alias("verdict")).drop("pos")


def model_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a job's first two pages as a model's findings, high from 400 dots per inch, medium from 300: what the review of these pages says."""
    h = evidence._hits(spark, sf_dir).where("page is not null and dpi is not null")
    severity = F.when(F.col("dpi") >= 400, "high").when(F.col("dpi") >= 300, "medium").otherwise("low")
    n = h.groupBy("job_id").agg(F.collect_set(F.when(F.col("page") <= 2, severity)).alias("s"), F.max("page").alias("total"))
    r = signals.model_review(F.lit("low"), F.col("s"), F.least("total", F.lit(2)), F.col("total"))
    return n.select(r.alias("r")).groupBy("r.status", "r.risk", "r.verdict").agg(F.count("*").alias("jobs"))


def illegal_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose times do not fit their status or their order, by what is wrong with them."""
    j = store.jobs(spark, sf_dir)
    return j.groupBy(store.illegal_state(F.col("status"), F.col("created_at"), F.col("started_at"), F.col("completed_at")).alias("fault"), "status").agg(F.count("*").alias("jobs")).where("fault is not null")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as workers that claim one of 100 queued jobs: each job's only winner is the first."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 100).alias("job"), "user_id", "ts", "event_id")
    return store.claimed(e, "job", "user_id", ["ts", "event_id"])


def stalled_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose clients gave up: four errors one after the other."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", (F.col("event_type") == "error").alias("bad"))
    return windows.runs(e, "user_id", ["ts", "event_id"], "bad", 4)


def same_phone_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, lines as pages: how far all pairs of pages fit one device."""
    p = features.pair_scores(features.page_sides(_page_features(spark, sf_dir), "l_orderkey", "page"))
    n = p.groupBy("l_orderkey").agg(F.median("score").alias("mid"), F.min("score").alias("least"), F.max(100 - F.col("condition_score")).alias("variation"))
    return n.select("l_orderkey", F.round("mid", 3).alias("median_score"), F.round("least", 3).alias("least_score"), F.round("variation", 3).alias("variation"), features.document_verdict(F.round("mid", 9), F.round("least", 9)).alias("verdict"))


def scanner_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages compared as scans: the highest mismatch of a document's pairs, and the risk that follows."""
    p = features.mismatches(features.page_sides(_page_features(spark, sf_dir), "l_orderkey", "page"), ["noise", "light", "sharpness", "blocks"])
    n = p.groupBy("l_orderkey").agg(F.max("mismatch").alias("most"), F.count("*").alias("pairs"), F.max("b_page").alias("pages"))
    return n.select("l_orderkey", F.round("most", 3).alias("mismatch"), features.overall_risk(F.lit(None).cast("double"), F.lit(None).cast("double"), F.round("most", 9), F.col("pages"), F.col("pairs")).alias("risk"))


def _page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    page = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    v = lambda *c: F.array(*(x.cast("double") for x in c))
    q, d, t = F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100
    return li.select(
        "l_orderkey", page.alias("page"), F.col("l_returnflag").alias("filter"), F.col("l_linestatus").alias("color"), F.lit(1).alias("images"), F.lit(100).alias("width"), (q / 10).alias("aspect"), (F.col("l_extendedprice") / 10000).alias("megapixels"), v(q, d, t).alias("spectrum"),
        (t / 100 + 1).alias("noise"), (d / 100 + 1).alias("blocks"), (q / 50 + 1).alias("light"), (F.col("l_extendedprice") / 100000 + 1).alias("sharpness"), v(q, d * 2, t, F.lit(1)).alias("rows"), v(d, q, t * 3, F.lit(2)).alias("columns"), (t / 10).alias("row_bands"), (d / 20).alias("column_bands"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        job_checks, typed_facts, derived_flags, page_sheet, summary_sheet, duplicate_cells, case_matrix, batch_progress, document_counts, first_outcomes, batch_profiles, history_cases, recent_documents, requested_checks, degraded_checks, whitener_pages, model_reviews,
        illegal_states, claims, stalled_clients, same_phone_scores, scanner_mismatches,
    )
}

_ASKED = """, k AS (SELECT id, doc, coalesce(list_transform(json_extract(doc, '$.analyzers[*]'), lambda x: json_extract_string(x, '$')), []) AS analyzers FROM w), asked AS (SELECT id, doc, unnest(range(0, len(analyzers))) AS position, unnest(analyzers) AS analyzer_id FROM k)"""
_FACTS = RESULTS + """, f AS (SELECT id, analyzer_id, result, unnest(json_extract(result, '$.check.facts[*]')) AS f FROM r WHERE json_type(result, '$.check.facts') = 'ARRAY'), facts_ AS (SELECT id, analyzer_id, json_extract_string(f, '$.label') AS label, trim(json_extract_string(f, '$.value'), ' ') AS value FROM f WHERE json_type(f) = 'OBJECT' AND json_extract_string(f, '$.label') IS NOT NULL AND json_extract_string(f, '$.value') IS NOT NULL)"""
_KIND = "CASE " + " ".join(f"WHEN analyzer_id = '{a}' AND label = '{label}' THEN '{kind}'" for a, labels in NUMERIC.items() for label, kind in labels.items()) + " END"
_J = "j AS (SELECT DISTINCT id, batch_id, batch_position, filename, status, flagged, created_at, started_at, completed_at FROM jobs)"
_PAGES = """
    WITH p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS page, CAST(l_quantity AS DOUBLE) AS q, l_discount * 100 AS d, l_tax * 100 AS t FROM lineitem),
    v AS (SELECT l_orderkey, page, l_returnflag AS filter, l_linestatus AS color, q / 10 AS aspect, l_extendedprice / 10000 AS mp, q, d, t, t / 100 + 1 AS noise, d / 100 + 1 AS blocks, q / 50 + 1 AS light, l_extendedprice / 100000 + 1 AS sharp, [q, d * 2, t, 1.0::DOUBLE] AS rows_, [d, q, t * 3, 2.0::DOUBLE] AS cols_, t / 10 AS rb, d / 20 AS cb FROM p),
    s AS (SELECT a.l_orderkey, a, b FROM v a JOIN v b ON a.l_orderkey = b.l_orderkey AND a.page < b.page)"""


def _near(name: str, scale: float) -> str:
    return f"least(greatest(1 - abs(a.{name} - b.{name}) / (abs(a.{name}) + abs(b.{name}) + 1e-6::DOUBLE) * 2 * {scale}::DOUBLE, 0.0), 1.0)"


_COS = "CASE WHEN sqrt(a.q * a.q + a.d * a.d + a.t * a.t) * sqrt(b.q * b.q + b.d * b.d + b.t * b.t) > 1e-6 THEN least(greatest((a.q * b.q + a.d * b.d + a.t * b.t) / (sqrt(a.q * a.q + a.d * a.d + a.t * a.t) * sqrt(b.q * b.q + b.d * b.d + b.t * b.t)), -1.0), 1.0) END"


def _r(name: str) -> str:
    mean = lambda s: f"(list_sum({s}.{name}) / 4)"
    dot = lambda x, y: "(" + " + ".join(f"({x}.{name}[{i}] - {mean(x)}) * ({y}.{name}[{i}] - {mean(y)})" for i in range(1, 5)) + ")"
    return f"CASE WHEN sqrt({dot('a', 'a')}) * sqrt({dot('b', 'b')}) > 1e-6 THEN least(greatest({dot('a', 'b')} / (sqrt({dot('a', 'a')}) * sqrt({dot('b', 'b')})), -1.0), 1.0) END"


def _apart(name: str) -> str:
    return f"abs(a.{name} - b.{name}) / (abs(a.{name}) + abs(b.{name}) + 1e-6::DOUBLE)"


SQL = {
    "job_checks": OUTCOMES + _ASKED + " SELECT a.id AS job_id, CAST(a.position AS INTEGER) AS position, a.analyzer_id, coalesce(json_extract_string(a.doc, '$.analyzer_runs.' || a.analyzer_id || '.status'), 'queued') AS run, o.outcome, o.checked AS result FROM asked a LEFT JOIN o ON o.id = a.id AND o.analyzer_id = a.analyzer_id",
    "typed_facts": _FACTS
    + f""", n AS (SELECT analyzer_id, label, value, {_KIND} AS kind FROM facts_), num AS (SELECT analyzer_id, label, CASE WHEN kind = 'percent' THEN CASE WHEN value LIKE '%\\%' ESCAPE '\\' THEN try_cast(left(value, -1) AS DOUBLE) / 100 ELSE try_cast(value AS DOUBLE) END WHEN kind = 'score' THEN try_cast(split_part(value, '/', 1) AS DOUBLE) WHEN kind IS NOT NULL THEN try_cast(value AS DOUBLE) END AS number FROM n)
        SELECT analyzer_id, label, count(number) AS numbers, round(sum(number), 4) AS total, count_if(number IS NULL) AS texts FROM num GROUP BY 1, 2""",
    "derived_flags": _FACTS
    + """, fl AS (SELECT id, analyzer_id, result, max(value) FILTER (label = CASE analyzer_id WHEN 'photo_detection' THEN 'Photos found' WHEN 'qr_presence' THEN 'QR codes found' WHEN 'signature' THEN 'Signatures found' END) AS n, lower(max(value) FILTER (label = 'Re-saved after creation')) AS saved, max(value) FILTER (label = 'Created') AS created, max(value) FILTER (label = 'Modified') AS modified, max(value) FILTER (label = 'File verdict') AS verdict
          FROM (SELECT f.id, f.analyzer_id, f.result, json_extract_string(f.f, '$.label') AS label, trim(json_extract_string(f.f, '$.value'), ' ') AS value FROM f WHERE json_type(f.f) = 'OBJECT') WHERE value IS NOT NULL AND label IN ('Photos found', 'QR codes found', 'Signatures found', 'Re-saved after creation', 'Created', 'Modified', 'File verdict') GROUP BY 1, 2, 3),
        x AS (SELECT analyzer_id, CASE WHEN analyzer_id IN ('photo_detection', 'qr_presence', 'signature') THEN CASE WHEN try_cast(split_part(n, ' ', 1) AS INTEGER) > 0 THEN 'Y' WHEN try_cast(split_part(n, ' ', 1) AS INTEGER) IS NOT NULL THEN 'N' END
          WHEN analyzer_id = 'metadata' THEN CASE WHEN saved = 'yes' THEN 'Y' WHEN created <> '' AND modified <> '' AND created <> modified THEN 'Y' WHEN saved = 'no' OR created <> '' OR modified <> '' THEN 'N' END WHEN analyzer_id = 'moire' THEN CASE verdict WHEN 'Recapture' THEN 'Y' WHEN 'Clean' THEN 'N' END END AS flag FROM fl)
        SELECT analyzer_id, coalesce(flag, '') AS flag, count(*) AS results FROM x GROUP BY 1, 2""",
    "page_sheet": RESULTS
    + """, x AS (SELECT id, analyzer_id, json_extract(result, '$.raw') AS raw FROM r WHERE json_type(result, '$.raw') = 'OBJECT'), ran AS (SELECT id, bool_or(analyzer_id = 'font_analysis') AS f, bool_or(analyzer_id = 'photo_detection') AS p, bool_or(analyzer_id = 'signature') AS s, bool_or(analyzer_id = 'qr_presence') AS q, bool_or(analyzer_id = 'tamper_scan') AS t FROM x GROUP BY 1),
        e AS (SELECT id, json_array_length(raw, '$.pages') AS n, unnest(json_extract(raw, '$.pages[*]')) AS p FROM x WHERE analyzer_id = 'tamper_scan' AND json_type(raw, '$.pages') = 'ARRAY'),
        vals AS (SELECT id, n, CAST(json_extract_string(p, '$.page') AS BIGINT) AS page, CAST(json_extract_string(p, '$.probability') AS DOUBLE) AS probability, CASE WHEN json_type(p, '$.regions') = 'ARRAY' THEN json_array_length(p, '$.regions') ELSE 0 END AS regions FROM e),
        c AS (SELECT id, greatest(max(n), max(page)) AS n FROM vals GROUP BY 1), g AS (SELECT id, unnest(range(1, CAST(n AS BIGINT) + 1)) AS page FROM c)
        SELECT g.id AS job_id, g.page, CASE WHEN ran.f THEN 0 END AS fonts, CASE WHEN ran.p THEN 0 END AS photos, CASE WHEN ran.s THEN 0 END AS signatures, CASE WHEN ran.q THEN 0 END AS codes, max(v.probability) AS probability, CAST(coalesce(max(v.regions), 0) AS BIGINT) AS regions, CAST(NULL AS DOUBLE) AS lowest_pair, CAST(NULL AS VARCHAR) AS moire FROM g JOIN ran USING (id) LEFT JOIN vals v ON v.id = g.id AND v.page = g.page GROUP BY ALL""",
    "case_matrix": VERDICTS
    + f""", {_J}, n AS (SELECT j.batch_id, j.id, v.verdict, row_number() OVER (PARTITION BY batch_id ORDER BY CASE v.verdict WHEN 'error' THEN 0 WHEN 'review' THEN 1 WHEN 'pending' THEN 3 WHEN 'clear' THEN 4 ELSE 2 END, batch_position, id) AS place FROM j JOIN verdicts v ON v.job_id = j.id WHERE batch_id IS NOT NULL AND (contains(lower(filename), 'a') OR contains(lower(id), 'a'))) SELECT *, (place - 1) // 20 AS page FROM n""",
    "batch_progress": VERDICTS
    + f""", {_J}, a AS (SELECT id, CASE WHEN json_type(doc, '$.analyzers') = 'ARRAY' THEN json_array_length(doc, '$.analyzers') ELSE 0 END AS asked FROM w), e AS (SELECT id, count_if(outcome = 'error') AS errors FROM o GROUP BY 1),
        n AS (SELECT batch_id, CAST(sum(asked) AS BIGINT) AS asked, CAST(sum(ran) AS BIGINT) AS done, count_if(status = 'completed') AS completed, count_if(verdict = 'clear') AS clear, count_if(verdict = 'review') AS review, count_if(verdict = 'error') AS error, count_if(errors > 0) AS with_errors FROM j JOIN a USING (id) JOIN verdicts v ON v.job_id = j.id LEFT JOIN e ON e.id = j.id WHERE batch_id IS NOT NULL GROUP BY 1)
        SELECT *, CAST(coalesce(floor(100 * done / nullif(asked, 0) + 0.5), 0) AS INTEGER) AS percent FROM n""",
    "document_counts": OUTCOMES
    + f""", {_J}, s AS (SELECT id, coalesce(checked, CASE outcome WHEN 'review' THEN 'fail' WHEN 'error' THEN 'error' WHEN 'clear' THEN 'pass' WHEN 'info' THEN 'info' WHEN 'inconclusive' THEN 'inconclusive' END) AS s FROM o)
        SELECT s.id AS job_id, count(*) AS results, count_if(s = 'pass') AS pass, count_if(s = 'fail') AS fail, count_if(s = 'error') AS error, count_if(s = 'inconclusive') AS inconclusive, count_if(s IS DISTINCT FROM 'info') AS graded, any_value(j.completed_at) AS last_analysed_at FROM s JOIN j USING (id) GROUP BY 1""",
    "first_outcomes": OUTCOMES + f", {_J} SELECT batch_id, analyzer_id, arg_min(checked, batch_position) AS first_status FROM o JOIN j USING (id) WHERE checked IS NOT NULL AND batch_id IS NOT NULL GROUP BY 1, 2",
    "batch_profiles": RESULTS + _ASKED
    + f""", {_J}, n AS (SELECT batch_id, count(DISTINCT nullif(left(trim(json_extract_string(doc, '$.profile.name')), 80), '')) AS n, min(nullif(left(trim(json_extract_string(doc, '$.profile.name')), 80), '')) AS one FROM j JOIN w USING (id) WHERE batch_id IS NOT NULL GROUP BY 1),
        f AS (SELECT batch_id, analyzer_id, min((batch_position, position)) AS pl FROM asked JOIN j USING (id) WHERE batch_id IS NOT NULL GROUP BY 1, 2), c AS (SELECT batch_id, string_agg(analyzer_id, ',' ORDER BY pl) AS analyzers FROM f GROUP BY 1)
        SELECT n.batch_id, CASE WHEN n = 1 THEN one WHEN n > 1 THEN 'Mixed' END AS profile, coalesce(analyzers, '') AS analyzers FROM n LEFT JOIN c USING (batch_id)""",
    "history_cases": VERDICTS
    + f""", {_J}, l AS ({LATEST}), n AS (SELECT j.batch_id, count(*) AS documents, count_if(j.status = 'completed') AS completed, count_if(j.flagged = 1) AS flagged, bool_or(v.verdict = 'error') AS errors, count(l.decision) AS decided, array_to_string(list_sort(list_distinct(list(l.decision) FILTER (l.decision IS NOT NULL))), ',') AS decisions FROM j JOIN verdicts v ON v.job_id = j.id LEFT JOIN l ON l.job_id = j.id WHERE batch_id IS NOT NULL GROUP BY 1)
        SELECT n.batch_id, CASE WHEN completed < documents THEN 'In progress' WHEN flagged > 0 THEN flagged || ' flagged' WHEN errors THEN 'Check errors' ELSE 'All clear' END AS case_verdict, documents, decided, coalesce(decisions, '') AS decisions, row_number() OVER (ORDER BY flagged DESC, b.created_at DESC, n.batch_id) AS place FROM n JOIN batches b ON b.id = n.batch_id""",
    "recent_documents": VERDICTS
    + f""", {_J}, b AS (SELECT id AS batch_id, created_at AS made FROM batches ORDER BY created_at DESC, id DESC LIMIT 8), e AS (SELECT j.id, batch_id, made, batch_position FROM j JOIN b USING (batch_id) ORDER BY made DESC, batch_id DESC, batch_position, j.id LIMIT 8), x AS (SELECT e.*, v.verdict, v.verdict IN ('review', 'error') AS bad FROM e JOIN verdicts v ON v.job_id = e.id),
        q AS (SELECT *, count_if(bad) OVER (ORDER BY made DESC, batch_id DESC, batch_position, id ROWS UNBOUNDED PRECEDING) AS n FROM x) SELECT id, batch_id, verdict, CASE WHEN bad AND n <= 4 THEN n END AS queue FROM q""",
    "requested_checks": RESULTS + _ASKED
    + f""", {_J}, a AS (SELECT j.batch_id, j.batch_position, k.id, list_sort(k.analyzers) AS l, len(list_filter(list_distinct(k.analyzers), lambda x: x IN ({', '.join(repr(a) for a in grading.ANALYZERS)}))) AS n FROM k JOIN j USING (id) WHERE batch_id IS NOT NULL), f AS (SELECT batch_id, arg_min(l, batch_position) AS first FROM a GROUP BY 1)
        SELECT CAST(CASE WHEN n > 0 THEN n ELSE 9 END AS INTEGER) AS used, l <> first AS drifted, count(*) AS jobs FROM a JOIN f USING (batch_id) GROUP BY 1, 2""",
    "degraded_checks": OUTCOMES + _ASKED + f", {_J}, miss AS (SELECT a.id, a.analyzer_id FROM asked a LEFT JOIN o ON o.id = a.id AND o.analyzer_id = a.analyzer_id WHERE o.outcome IS NULL) SELECT batch_id, array_to_string(list_sort(list_distinct(list(analyzer_id))), ',') AS checks, count(DISTINCT id) AS documents FROM miss JOIN j USING (id) WHERE batch_id IS NOT NULL GROUP BY 1",
    "whitener_pages": RESULTS
    + """, x AS (SELECT id, json_extract(result, '$.raw') AS raw FROM r WHERE analyzer_id = 'tamper_scan' AND json_type(result, '$.raw.pages') = 'ARRAY' AND json_array_length(result, '$.raw.pages') > 0), e AS (SELECT id, raw, unnest(json_extract(raw, '$.pages[*]')) AS p FROM x),
        n AS (SELECT id, coalesce(CAST(json_extract_string(raw, '$.review_threshold') AS DOUBLE), 0.35) AS lim, count(*) AS analysed, count_if(coalesce(json_array_length(p, '$.regions'), 0) > 0) AS with_evidence, CAST(sum(coalesce(json_array_length(p, '$.regions'), 0)) AS INTEGER) AS regions, max(CAST(json_extract_string(p, '$.probability') AS DOUBLE)) AS highest FROM e GROUP BY id, raw)
        SELECT id AS job_id, CAST(analysed AS INTEGER) AS analysed, CAST(with_evidence AS INTEGER) AS with_evidence, CAST(0 AS INTEGER) AS indeterminate, regions, CASE WHEN highest >= lim THEN 'likely_whitener' ELSE 'no_whitener_evidence' END AS verdict FROM n""",
    "model_reviews": """
        WITH h AS (SELECT DISTINCT ON (hit_id) * FROM qr_hits WHERE page IS NOT NULL AND dpi IS NOT NULL), n AS (SELECT job_id, max(CASE WHEN page <= 2 THEN CASE WHEN dpi >= 400 THEN 3 WHEN dpi >= 300 THEN 2 ELSE 1 END END) AS worst, max(page) AS total FROM h GROUP BY 1),
        r AS (SELECT worst >= 2 AS acts, total > 2 AS part, ['low', 'medium', 'high'][greatest(worst, 1)] AS worst FROM (SELECT coalesce(worst, 0) AS worst, total FROM n))
        SELECT CASE WHEN part AND NOT acts THEN 'inconclusive' ELSE 'completed' END AS status, CASE WHEN acts THEN worst WHEN part THEN 'unknown' ELSE 'low' END AS risk, CASE WHEN acts THEN 'visual_review_signals' WHEN part THEN 'partial_review' ELSE 'clear' END AS verdict, count(*) AS jobs FROM r GROUP BY 1, 2, 3""",
    "illegal_states": f"""WITH {_J}, f AS (SELECT status, CASE WHEN status = 'queued' AND (started_at IS NOT NULL OR completed_at IS NOT NULL) THEN 'queued job has been run' WHEN status = 'running' AND (started_at IS NULL OR completed_at IS NOT NULL) THEN 'running job needs its start only' WHEN status IN ('completed', 'failed') AND (started_at IS NULL OR completed_at IS NULL) THEN 'finished job lacks a time'
        WHEN started_at < created_at THEN 'started before it was queued' WHEN completed_at < started_at THEN 'completed before it was started' END AS fault FROM j) SELECT fault, status, count(*) AS jobs FROM f WHERE fault IS NOT NULL GROUP BY 1, 2""",
    "claims": "SELECT event_id % 100 AS job, arg_min(user_id, (ts, event_id)) AS user_id FROM events GROUP BY 1",
    "stalled_clients": """WITH n AS (SELECT user_id, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS g FROM events)
        SELECT user_id, count(*) AS runs, max(n) AS longest FROM (SELECT user_id, count(*) AS n FROM n WHERE bad GROUP BY user_id, g HAVING count(*) >= 4) GROUP BY 1""",
    "same_phone_scores": f"""{_PAGES}, m AS (SELECT l_orderkey, least(CASE WHEN a.filter = b.filter THEN 45 ELSE 0 END + CASE WHEN a.color = b.color THEN 25 ELSE 0 END + 30, 100)::DOUBLE AS meta, 100 * (0.55::DOUBLE * {_near('aspect', 0.8)} + 0.45::DOUBLE * {_near('mp', 0.5)}) AS geo,
          100 * (0.65::DOUBLE * coalesce(({_COS} + 1) / 2, 0.5) + 0.25::DOUBLE * {_near('noise', 0.6)} + 0.10::DOUBLE * {_near('blocks', 0.5)}) AS tex, 100 * (0.55::DOUBLE * {_near('light', 0.45)} + 0.45::DOUBLE * {_near('sharp', 0.25)}) AS con FROM s),
        n AS (SELECT l_orderkey, median(x) AS mid, min(x) AS least_, max(100 - con) AS variation FROM (SELECT *, meta * 0.30::DOUBLE + geo * 0.25::DOUBLE + tex * 0.35::DOUBLE + con * 0.10::DOUBLE AS x FROM m) GROUP BY 1)
        SELECT l_orderkey, round(mid, 3) AS median_score, round(least_, 3) AS least_score, round(variation, 3) AS variation, CASE WHEN round(mid, 9) >= 78 AND round(least_, 9) >= 60 THEN 'likely_same_phone_or_workflow' WHEN round(mid, 9) >= 62 AND round(least_, 9) >= 48 THEN 'compatible_with_same_phone' WHEN round(mid, 9) >= 48 THEN 'uncertain_same_phone' ELSE 'possibly_different_phone_or_workflow' END AS verdict FROM n""",
    "scanner_mismatches": f"""{_PAGES}, m AS (SELECT l_orderkey, b.page AS page, coalesce((1 - {_COS}) / 2, 0.0) AS sp, least(({_apart('noise')} + {_apart('light')} + {_apart('sharp')} + {_apart('blocks')}) / 4 * 2, 1.0) AS st, coalesce((1 - {_r('rows_')}) / 2, 0.0) AS ra, coalesce((1 - {_r('cols_')}) / 2, 0.0) AS ca, least(0.12::DOUBLE, (a.rb + b.rb) * 0.04::DOUBLE) AS rw, least(0.12::DOUBLE, (a.cb + b.cb) * 0.04::DOUBLE) AS cw FROM s),
        x AS (SELECT l_orderkey, page, least(greatest(100 * (1 - exp(-8.0::DOUBLE * (sp * 0.46::DOUBLE + st * 0.38::DOUBLE + ra * rw + ca * cw) / (0.46::DOUBLE + 0.38::DOUBLE + rw + cw))), 0.0), 100.0) AS score FROM m), n AS (SELECT l_orderkey, max(score) AS most, count(*) AS pairs FROM x GROUP BY 1)
        SELECT l_orderkey, round(most, 3) AS mismatch, CASE WHEN round(most, 9) >= 76 AND pairs = 1 THEN 'high' WHEN round(most, 9) >= 45 THEN 'medium' ELSE 'low' END AS risk FROM n""",
}
_SIG = _SIGNALS.replace("), p AS (", "), p_ AS (").replace("p AS (SELECT j.batch_id", "p_ AS (SELECT j.batch_id").replace("FROM p GROUP", "FROM p_ GROUP").replace("FROM p JOIN", "FROM p_ p JOIN").replace("f AS (SELECT batch_id", "f_ AS (SELECT batch_id").replace("JOIN f USING", "JOIN f_ f USING")
SQL["summary_sheet"] = VERDICTS + f""", {_SIG}, e AS (SELECT DISTINCT unnest([job_id, other_id]) AS id, CASE pair_type WHEN 'Identical file' THEN 'hash' WHEN 'Same QR payload' THEN 'QR' ELSE 'face' END AS signal FROM signals WHERE pair_type <> 'Face near miss'), s AS (SELECT id, string_agg(signal, ', ' ORDER BY signal) AS signals FROM e GROUP BY 1)
    SELECT v.job_id AS id, coalesce(left(trim(json_extract_string(c.doc, '$.profile.name')), 80), '') AS profile, CASE v.verdict WHEN 'review' THEN 'Needs review' WHEN 'error' THEN 'Check errors' WHEN 'clear' THEN 'Clear' WHEN 'pending' THEN 'Screening incomplete' WHEN 'unanalyzable' THEN 'Marked unanalyzable' ELSE 'Inconclusive' END AS verdict, v.authenticity, coalesce(s.signals, '') AS signals, v.failed
    FROM verdicts v JOIN c ON c.id = v.job_id LEFT JOIN s ON s.id = v.job_id"""
SQL["duplicate_cells"] = f"""WITH {_SIGNALS}, fc AS (SELECT job_id AS id, max(score) AS similarity FROM signals WHERE score IS NOT NULL GROUP BY 1)
    SELECT j.id, CASE WHEN c.job_id IS NULL THEN 'No QR code to compare' WHEN c.first_id IS NULL THEN 'Unique in this batch' ELSE coalesce(o.filename, '') END AS code, CASE WHEN similarity IS NULL THEN 'Not compared' WHEN similarity >= 0.35 THEN 'Match' ELSE 'No match' END AS photo, similarity
    FROM j LEFT JOIN codes c ON c.job_id = j.id LEFT JOIN j o ON o.id = c.first_id LEFT JOIN fc ON fc.id = j.id"""

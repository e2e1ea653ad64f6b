"""Queries: templates, baselines, retrieval, fonts, producers, settings and payload fields."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.functions import fields
from attestry.functions import text as T
from attestry.operators import features, ordered, reports, signals, templates
from attestry.plans import evidence
from attestry.plans.evidence import _BOXES
from attestry.plans.reporting import RESULTS
from attestry.session import table
from attestry.sources import files


def template_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that recur in several sources, or at places in the text that differ."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "kind", "text")
    rows = templates.lines(d, "doc_id", "text").join(d.select("doc_id", "source"), "doc_id")
    return templates.consistency(rows, "line", "source", "line_no")


def template_baseline_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of marksheets against those of certificates; a missing line that not all of them have is a weak sign."""
    rows = templates.lines(table(spark, sf_dir, "documents").where("kind in ('marksheet', 'certificate')"), "doc_id", "text")
    kinds = table(spark, sf_dir, "documents").select("doc_id", "kind")
    named = rows.join(kinds, "doc_id")
    base = templates.baseline(named.where("kind = 'certificate'"), "line", "doc_id")
    return templates.drift(named.where("kind = 'marksheet'"), base, "line")


def nearest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each hit with the earlier hit of its job and page that lies nearest, by the greatest distance of their edges in shares of the page."""
    h = evidence.hit_boxes(spark, sf_dir)
    edges = {"x0": F.col("x"), "y0": F.col("y"), "x1": F.col("x") + F.col("width"), "y1": F.col("y") + F.col("height")}
    side = lambda p: h.select("job_id", "page", F.col("hit_id").alias(f"{p}_hit_id"), *(c.alias(f"{p}_{n}") for n, c in edges.items()))
    found = templates.nearest(side("a"), side("b"), ["job_id", "page"], F.when(F.col("a_hit_id") > F.col("b_hit_id"), F.round(templates.span_distance("a", "b"), 6)), "hit_id")
    return found.select("a_hit_id", "b_hit_id", "distance")


def page_text_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each kind whose text layer serves, and those too short, which need recognition."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("kind").agg(F.count("*").alias("pages"), F.count_if(files.needs_ocr(F.col("text"))).alias("to_recognise"))


def rank_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best documents of each source for a question, sources as documents and texts as pages."""
    terms = [r[0] for r in spark.range(1).select(F.explode(T.terms(F.lit("Where was the registrar line and the seal on the page?")))).collect()]  # a question's words
    return templates.rank_pages(table(spark, sf_dir, "documents"), "source", "doc_id", "text", terms, [3, 5], 7, 3)


def cited_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each job's pages with hits, in the order of the first of each, those among the pages chosen for a review: page and rank."""
    h = table(spark, sf_dir, "qr_hits").dropDuplicates(["hit_id"]).where("page is not null")
    first = h.groupBy("job_id", "page").agg(F.min("hit_id").alias("first"))
    chosen = h.groupBy("job_id").agg(F.explode(signals.chosen_pages(F.max("page"), 2, F.array(F.lit(2)))).alias("page"))
    kept = first.join(chosen, ["job_id", "page"], "left_semi")
    return ordered.numbered(kept, "job_id", ["first"], "rank").select("job_id", "page", "rank")


def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = T.word_quality(F.col("text"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", *(c.alias(n) for n, c in q.items()))


def font_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts that facts name, by what groups their spellings: a name (one with a blank before others), the class, how often, in which of the analyzers' sources."""
    f = table(spark, sf_dir, "facts").where("label = 'Font names' and value is not null")
    each = f.select("source", F.explode(F.split("value", ", ")).alias("font")).where("font <> ''")
    name = F.min_by("font", F.struct(~F.contains("font", F.lit(" ")), "font"))
    return each.groupBy(T.font_key(F.col("font")).alias("font_key")).agg(name.alias("font"), T.font_class(name).alias("font_class"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def fonts_outside_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fonts that only one source names: the store holds those of two or more."""
    f = table(spark, sf_dir, "facts").where("label = 'Font names' and value is not null")
    each = f.select("source", F.explode(F.split("value", ", ")).alias("font")).select("source", T.font_key(F.col("font")).alias("font_key")).distinct()
    known = each.groupBy("font_key").agg(F.count("*").alias("n")).where("n >= 2")
    return each.join(known, "font_key", "left_anti")


def producers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "facts").where("label = 'Producer'")
    return f.groupBy(T.producer_kind(F.col("value")).alias("kind")).agg(F.count("*").alias("n"), F.count_distinct("value").alias("spellings"))


def fact_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = T.fact_text(F.col("value"))
    return table(spark, sf_dir, "facts").select("fact_id", v.alias("text"), F.size(F.split(v, ", ")).alias("items")).where("text is not null")


def clamped_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event's k as a setting from 5 to 60, 30 where it is none."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").groupBy(T.clamp_int(k, 5, 60, 30).alias("setting")).agg(F.count("*").alias("n"))


def job_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The settings jobs ran under: what they say over the defaults, within bounds."""
    c = reports.cases(table(spark, sf_dir, "jobs").select("id", "payload_json"))
    at = T.clamp_float(F.col("threshold"), 0.1, 0.9, 0.35)
    return c.groupBy(at.alias("review_threshold"), T.allowed(F.lit(None).cast("string"), ["low", "medium", "high"], "medium").alias("effort")).agg(F.count("*").alias("jobs"))


def link_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that hold a link, by scheme and host in small letters; blanks and byte order marks around it do not count."""
    bare = F.regexp_replace("payload", r"^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")
    part = lambda pattern: F.nullif(F.regexp_extract(bare, pattern, 1), F.lit(""))
    h = table(spark, sf_dir, "qr_hits").dropDuplicates(["hit_id"]).select(F.lower(part(r"^([Hh][Tt][Tt][Pp][Ss]?)://")).alias("scheme"), F.lower(part(r"^[A-Za-z]+://([^/?#:\s]+)")).alias("host"), part(r"\?([^#]+)").alias("query"))
    return h.where("scheme is not null and host is not null").groupBy("scheme", "host").agg(F.count("*").alias("n"), F.count("query").alias("with_query"))


def payload_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of a job's codes, each once whatever its escapes, the first spelling of it."""
    link = F.regexp_replace("payload", r"^\s+|\s+$", "")
    h = table(spark, sf_dir, "qr_hits").select("hit_id", "job_id", link.alias("link")).where("link rlike '^https?://[^/?#]'")
    # A plus stands for itself outside forms.
    return h.groupBy("job_id", F.try_url_decode(F.replace("link", F.lit("+"), F.lit("%2B"))).alias("bare")).agg(F.min_by("link", "hit_id").alias("link")).where("bare is not null").select("job_id", "link")


def first_and_last_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled lines of codes: the first value of each label of a job, and the last."""
    h = table(spark, sf_dir, "qr_hits").dropDuplicates(["hit_id"]).where("payload is not null")
    rows = h.select("job_id", "hit_id", F.posexplode(F.split("payload", r"\r\n|\r|\n")).alias("line_no", "line"))
    pair = rows.select("job_id", "hit_id", "line_no", F.regexp_extract("line", r"^([A-Za-z ]+): *(.*)$", 1).alias("label"), F.regexp_extract("line", r"^([A-Za-z ]+): *(.*)$", 2).alias("value")).where("label <> '' and value <> ''")
    at = F.struct("hit_id", "line_no")
    return pair.groupBy("job_id", T.key_of(F.col("label")).alias("field")).agg(F.min_by("value", at).alias("first_value"), F.max_by("value", at).alias("last_value"))


def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of certificates that name a number, with the first date on them or within the next eight lines."""
    rows = templates.lines(table(spark, sf_dir, "documents").where("kind = 'certificate'"), "doc_id", "text")
    date = F.nullif(F.regexp_extract("line", r"(\d{2}\.\d{2}\.\d{4}|\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    ahead = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(0, 8)
    return rows.withColumn("date", F.first(date, ignorenulls=True).over(ahead)).where(F.contains("line", F.lit("Certificate No"))).select("doc_id", "line_no", "date")


def date_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "batches").select(F.date_format("created_at", "yyyy-MM-dd").alias("day")).distinct()
    return d.select("day", F.array_join(F.array_sort(T.date_forms(F.col("day"))), " ").alias("forms"), T.extract_date(F.concat(F.lit("on "), F.col("day"))).alias("plain"))


def provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each kind by what their text holds as a file's bytes would: pages with text, markers of ends and of earlier tables, distinct texts."""
    d = table(spark, sf_dir, "documents")
    n = lambda pattern: F.sum(F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)))
    return d.groupBy("kind").agg(F.count_if(F.length(F.trim("text")) > 0).alias("text_pages"), n("%%EOF").alias("ends"), n(r"/Prev\b").alias("earlier"), n("page").alias("pages"), F.count_distinct("text").alias("texts"))


def metadata_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by the risk of their editing signals: those that facts list, and what their producer's name says."""
    f = table(spark, sf_dir, "facts").where("label in ('Editing signals found', 'Producer') and value is not null")
    kind = T.producer_kind(F.col("value"))
    own = F.when(F.col("label") == "Producer", F.when(kind == "image_editor", F.array(F.lit("editor_producer"))).when(kind == "browser_or_converter", F.array(F.lit("renderer_producer")))).otherwise(F.split("value", ", "))
    held = f.select("job_id", F.explode(own).alias("signal")).where("signal <> 'None' and signal <> ''").groupBy("job_id").agg(F.array_sort(F.collect_set("signal")).alias("signals"))
    return held.groupBy(features.document_risk(F.col("signals")).alias("risk")).agg(F.count("*").alias("jobs"), F.max(F.size("signals")).alias("most"))


def font_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs by where their fonts, their producer and the size of their text say they come from; findings by image stand for image area."""
    f = table(spark, sf_dir, "facts").where("value is not null")
    font, producer = F.when(F.col("label") == "Font names", F.col("value")), F.when(F.col("label") == "Producer", F.col("value"))
    n = f.groupBy("job_id").agg(
        F.coalesce(F.bool_or(F.rlike(F.lower(producer), F.lit(features.WEB_PRODUCERS))), F.lit(False)).alias("web_producer"), F.coalesce(F.bool_or(F.rlike(F.lower(font), F.lit(T.WEB_FONTS))), F.lit(False)).alias("web"),
        F.coalesce(F.bool_or(F.rlike(F.lower(font), F.lit(T.SYSTEM_FONTS))), F.lit(False)).alias("system"), F.sum(F.char_length("value")).alias("characters"), (100.0 * F.count_if(F.col("label") == "Per-image findings") / F.count("*")).alias("coverage"),
    )
    return n.groupBy(features.font_origin(*(F.col(c) for c in ("web_producer", "web", "system", "characters", "coverage"))).alias("origin")).agg(F.count("*").alias("jobs"), F.sum("characters").alias("characters"))


def anchor_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places for signatures that lines of documents name."""
    rows = templates.lines(table(spark, sf_dir, "documents"), "doc_id", "text").where(F.rlike("line", F.lit("(?i)sign|issuing")))
    words = F.filter(F.split("line", r"\s+"), lambda w: w != "")
    return rows.select("doc_id", F.explode(features.anchor_words(words)).alias("phrase")).groupBy("phrase").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


def payload_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields that codes' payloads hold, by key: how often, and how many say nothing about a document."""
    h = table(spark, sf_dir, "qr_hits").dropDuplicates(["hit_id"]).where("payload is not null").select("hit_id", fields.payload_map(F.col("payload")).alias("m"))
    each = h.select("hit_id", F.explode("m").alias("key", "value"))
    return each.groupBy("key").agg(F.count("*").alias("n"), F.count_if(signals.is_noise(F.col("key"), F.col("value"))).alias("noise"))


def payload_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of each code against the texts of its job: how many match, and what that says."""
    h = table(spark, sf_dir, "qr_hits").dropDuplicates(["hit_id"]).where("payload is not null").select("hit_id", "job_id", fields.payload_map(F.col("payload")).alias("m"))
    d = table(spark, sf_dir, "documents").where("job_id is not null and text is not null").select("job_id", "doc_id", "text")
    noise = lambda k, v: k in signals.NOISE_KEYS or v.lower().startswith(("http://", "https://")) or not 3 <= len(v) <= 180 or fields.is_token(v)
    each = h.join(d, "job_id").select("hit_id", "doc_id", fields.matched_lines(F.col("m"), F.col("text"), noise).alias("rows"))
    n = each.select("hit_id", "doc_id", F.size("rows").alias("total"), F.size(F.filter("rows", lambda r: r["matched"])).alias("matched"))
    rate = F.round(F.try_divide(100.0 * F.col("matched"), F.col("total")), 1)
    return n.select("hit_id", "doc_id", "total", "matched", rate.alias("match_rate"), signals.code_verdict(F.lit(True), F.col("matched"), F.col("total")).alias("verdict"))


def document_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled fields of documents' lines beside those of the same text read as a page, by field and how they compare."""
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", fields.document_map(F.col("text")).alias("a"), fields.page_map(F.col("text")).alias("b"))
    each = d.select("doc_id", "a", "b", F.explode(F.array(*(F.lit(f) for f in fields.FIELDS))).alias("field")).select("doc_id", "field", F.col("a")[F.col("field")].alias("x"), F.col("b")[F.col("field")].alias("y")).where("x is not null or y is not null")
    return each.withColumn("c", fields.compared(F.col("field"), F.col("x"), F.col("y"))).groupBy("field", "c.method", "c.matched").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (template_consistency, template_baseline_drift, nearest_spans, page_text_sources, rank_pages, cited_pages, text_quality, font_groups, fonts_outside_store, producers, fact_texts, clamped_settings, job_settings, link_parts, payload_links, first_and_last_fields, look_ahead, date_spellings, provenance_counts, metadata_risks, font_origins, anchor_phrases, payload_details, payload_matches, document_fields)}

_LINES = "l AS (SELECT doc_id, source, kind, CAST(i - 1 AS INTEGER) AS line_no, trim(a[i], ' ') AS line FROM (SELECT doc_id, source, kind, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, source, kind, regexp_split_to_array(text, '\\r\\n|\\r|\\n') AS a FROM documents WHERE text IS NOT NULL)) WHERE trim(a[i], ' ') <> '')"
_FONTS = "e AS (SELECT job_id, source, unnest(string_split(value, ', ')) AS font FROM facts WHERE label = 'Font names' AND value IS NOT NULL)"
_KEY = "lower(regexp_replace(regexp_replace(font, '^[A-Z]{6}\\+', ''), '[\\s\\-_]+', '', 'g'))"


#: Markers of producers, in the order in which they are tried.
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower({{0}}), '{'|'.join(map(re.escape, markers))}') THEN '{kind}'" for kind, markers in T.PRODUCERS.items()) + " ELSE 'unknown' END"


def _count(term: str) -> str:
    return f"(length(low) - length(replace(low, '{term}', ''))) // {len(term)}"


SQL = {
    "template_consistency": f"WITH {_LINES} SELECT line, count(*) AS n, count(DISTINCT source) AS styles, max(line_no) - min(line_no) AS size_spread FROM l GROUP BY 1 HAVING count(*) >= 2 AND (count(DISTINCT source) > 1 OR max(line_no) - min(line_no) > 0.3)",
    "template_baseline_drift": f"""
        WITH {_LINES}, m AS (SELECT DISTINCT line FROM l WHERE kind = 'marksheet'), c AS (SELECT line, count(DISTINCT doc_id) AS n FROM l WHERE kind = 'certificate' GROUP BY 1), t AS (SELECT max(n) AS most FROM c)
        SELECT m.line, 'new' AS state, 'medium' AS severity FROM m LEFT JOIN c USING (line) WHERE c.line IS NULL UNION ALL SELECT c.line, 'missing', CASE WHEN c.n < t.most THEN 'low' ELSE 'medium' END FROM c CROSS JOIN t LEFT JOIN m USING (line) WHERE m.line IS NULL""",
    "nearest_spans": f"""
        WITH {_BOXES}, p AS (SELECT a.hit_id AS a_hit_id, b.hit_id AS b_hit_id, round(greatest(abs(a.x - b.x), abs(a.y - b.y), abs(a.x + a.width - (b.x + b.width)), abs(a.y + a.height - (b.y + b.height))), 6) AS distance FROM boxes a JOIN boxes b ON a.job_id = b.job_id AND a.page = b.page AND b.hit_id < a.hit_id)
        SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY a_hit_id ORDER BY distance, b_hit_id) = 1""",
    "page_text_sources": "SELECT kind, count(*) AS pages, count_if(coalesce(length(trim(text, ' ')) < 12, true)) AS to_recognise FROM documents GROUP BY 1",
    "cited_pages": """
        WITH h AS (SELECT DISTINCT ON (hit_id) * FROM qr_hits WHERE page IS NOT NULL), f AS (SELECT job_id, page, min(hit_id) AS first FROM h GROUP BY 1, 2), t AS (SELECT job_id, max(page) AS n FROM h GROUP BY 1)
        SELECT job_id, page, row_number() OVER (PARTITION BY job_id ORDER BY first) AS rank FROM f JOIN t USING (job_id) WHERE page <= 2""",
    "rank_pages": f"""
        WITH d AS (SELECT source, doc_id, lower(coalesce(text, '')) AS low FROM documents),
        s AS (SELECT source, doc_id, CAST({' + '.join(_count(t) for t in ('was', 'registrar', 'line', 'and', 'seal'))} + CASE WHEN doc_id = 7 THEN 5 ELSE 0 END + CASE WHEN doc_id IN (3, 5) THEN 3 ELSE 0 END AS INTEGER) AS score FROM d)
        SELECT source, doc_id, score, rank, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS position FROM (SELECT source, doc_id, score, CAST(row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 3)""",
    "text_quality": """
        WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
        c AS (SELECT doc_id, CAST(len(w) AS INTEGER) AS words, CAST(len(list_filter(w, lambda x: regexp_matches(x, '^[A-Za-z]{2,}[.,;:!?]?$'))) AS INTEGER) AS clean FROM w)
        SELECT doc_id, words, clean, round(coalesce((words - clean) / nullif(words, 0), 0.0), 6) AS garbled FROM c""",
    "font_groups": f"WITH {_FONTS}, k AS (SELECT {_KEY} AS font_key, source, font FROM e WHERE font <> ''), g AS (SELECT font_key, arg_min(font, (NOT contains(font, ' '), font)) AS font, count(*) AS n, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources FROM k GROUP BY 1) SELECT *, CASE WHEN regexp_matches(lower(font), '{T.WEB_FONTS}') THEN 'web' WHEN regexp_matches(lower(font), '{T.SYSTEM_FONTS}') THEN 'system' ELSE 'unknown' END AS font_class FROM g",
    "fonts_outside_store": f"WITH {_FONTS}, k AS (SELECT DISTINCT source, {_KEY} AS font_key FROM e) SELECT source, font_key FROM k WHERE font_key NOT IN (SELECT font_key FROM k GROUP BY 1 HAVING count(*) >= 2)",
    "producers": f"SELECT coalesce({_KIND.format('value')}, 'unknown') AS kind, count(*) AS n, count(DISTINCT value) AS spellings FROM facts WHERE label = 'Producer' GROUP BY 1",
    "fact_texts": "WITH t AS (SELECT fact_id, left(nullif(trim(value, ' '), ''), 400) AS text FROM facts) SELECT fact_id, text, CAST(len(string_split(text, ', ')) AS INTEGER) AS items FROM t WHERE text IS NOT NULL",
    "clamped_settings": "SELECT least(greatest(coalesce(try_cast(json_extract_string(props, '$.k') AS INTEGER), 30), 5), 60) AS setting, count(*) AS n FROM events GROUP BY 1",
    "link_parts": "WITH h AS (SELECT DISTINCT ON (hit_id) hit_id, regexp_replace(payload, '^[\\s\uFEFF]+|[\\s\uFEFF]+$', '', 'g') AS p FROM qr_hits), s AS (SELECT lower(regexp_extract(p, '^([Hh][Tt][Tt][Pp][Ss]?)://', 1)) AS scheme, lower(regexp_extract(p, '^[A-Za-z]+://([^/?#:\\s]+)', 1)) AS host, regexp_extract(p, '\\?([^#]+)', 1) AS query FROM h) SELECT scheme, host, count(*) AS n, count_if(query <> '') AS with_query FROM s WHERE scheme <> '' AND host <> '' GROUP BY 1, 2",
    "payload_links": "WITH h AS (SELECT hit_id, job_id, regexp_replace(payload, '^\\s+|\\s+$', '', 'g') AS link FROM qr_hits), b AS (SELECT *, url_decode(link) AS bare FROM h WHERE regexp_matches(link, '^https?://[^/?#]')) SELECT job_id, arg_min(link, hit_id) AS link FROM b GROUP BY job_id, bare",
    "job_settings": RESULTS + ", t AS (SELECT least(greatest(coalesce(try_cast(json_extract_string(doc, '$.settings.tamper_scan.review_threshold') AS DOUBLE), 0.35), 0.1), 0.9) AS review_threshold FROM w) SELECT review_threshold, 'medium' AS effort, count(*) AS jobs FROM t GROUP BY 1",
    "first_and_last_fields": """
        WITH h AS (SELECT DISTINCT ON (hit_id) * FROM qr_hits WHERE payload IS NOT NULL), a AS (SELECT job_id, hit_id, regexp_split_to_array(payload, '\\r\\n|\\r|\\n') AS a FROM h),
        r AS (SELECT job_id, hit_id, i, a[i] AS line FROM (SELECT *, unnest(range(1, len(a) + 1)) AS i FROM a)),
        p AS (SELECT job_id, hit_id, i, regexp_extract(line, '^([A-Za-z ]+): *(.*)$', 1) AS label, regexp_extract(line, '^([A-Za-z ]+): *(.*)$', 2) AS value FROM r)
        SELECT job_id, trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_') AS field, arg_min(value, (hit_id, i)) AS first_value, arg_max(value, (hit_id, i)) AS last_value FROM p WHERE label <> '' AND value <> '' GROUP BY 1, 2""",
    "look_ahead": f"WITH {_LINES}, f AS (SELECT doc_id, line_no, line, nullif(regexp_extract(line, '(\\d{{2}}\\.\\d{{2}}\\.\\d{{4}}|\\d{{4}}-\\d{{2}}-\\d{{2}})', 1), '') AS d FROM l WHERE kind = 'certificate'), w AS (SELECT *, first_value(d IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS date FROM f) SELECT doc_id, line_no, date FROM w WHERE contains(line, 'Certificate No')",
    "date_spellings": """
        WITH d AS (SELECT DISTINCT strftime(created_at, '%Y-%m-%d') AS day FROM batches), p AS (SELECT day, left(day, 4) AS y, substr(day, 6, 2) AS m, right(day, 2) AS d FROM d),
        f AS (SELECT day, unnest([day, d || '/' || m || '/' || y, d || '-' || m || '-' || y, CAST(d AS INTEGER) || '/' || CAST(m AS INTEGER) || '/' || y, CAST(d AS INTEGER) || '-' || CAST(m AS INTEGER) || '-' || y]) AS form, d || '-' || m || '-' || y AS plain FROM p)
        SELECT day, string_agg(form, ' ' ORDER BY form) AS forms, plain FROM (SELECT DISTINCT * FROM f) GROUP BY day, plain""",
    "provenance_counts": "SELECT kind, count_if(length(trim(text, ' ')) > 0) AS text_pages, CAST(sum(coalesce(len(regexp_extract_all(text, '%%EOF')), 0)) AS BIGINT) AS ends, CAST(sum(coalesce(len(regexp_extract_all(text, '/Prev\\b')), 0)) AS BIGINT) AS earlier, CAST(sum(coalesce(len(regexp_extract_all(text, 'page')), 0)) AS BIGINT) AS pages, count(DISTINCT text) AS texts FROM documents GROUP BY 1",
    "metadata_risks": f"""
        WITH f AS (SELECT job_id, label, value, {_KIND.format('value')} AS kind FROM facts WHERE label IN ('Editing signals found', 'Producer') AND value IS NOT NULL),
        s AS (SELECT job_id, unnest(CASE WHEN label <> 'Producer' THEN string_split(value, ', ') WHEN kind = 'image_editor' THEN ['editor_producer'] WHEN kind = 'browser_or_converter' THEN ['renderer_producer'] END) AS signal FROM f),
        g AS (SELECT job_id, count(DISTINCT signal) AS n, bool_or(signal = 'incremental_update') AS again, bool_or(signal IN ('editor_producer', 'editor_image_metadata')) AS editor FROM s WHERE signal <> 'None' AND signal <> '' GROUP BY 1)
        SELECT CASE WHEN n >= 3 OR (editor AND again) THEN 'high' WHEN n >= 2 OR editor OR again THEN 'medium' ELSE 'low' END AS risk, count(*) AS jobs, CAST(max(n) AS INTEGER) AS most FROM g GROUP BY 1""",
    "font_origins": f"""
        WITH n AS (SELECT job_id, coalesce(bool_or(label = 'Producer' AND regexp_matches(lower(value), '{features.WEB_PRODUCERS}')), false) AS p, coalesce(bool_or(label = 'Font names' AND regexp_matches(lower(value), '{T.WEB_FONTS}')), false) AS w,
          coalesce(bool_or(label = 'Font names' AND regexp_matches(lower(value), '{T.SYSTEM_FONTS}')), false) AS s, sum(length(value)) AS c, 100.0 * count_if(label = 'Per-image findings') / count(*) AS i FROM facts WHERE value IS NOT NULL GROUP BY 1)
        SELECT CASE WHEN c < 100 AND i > 60 THEN 'scanned' WHEN c > 100 AND i > 60 THEN 'scanned with text layer' WHEN p AND s AND NOT w THEN 'browser, official' WHEN p AND w AND NOT s THEN 'browser, recreated' WHEN p AND w THEN 'browser, mixed' WHEN p THEN 'browser, unclear'
          WHEN w AND NOT s THEN 'web generator' WHEN s AND NOT w THEN 'desktop application' WHEN s THEN 'mixed' ELSE 'unknown' END AS origin, count(*) AS jobs, CAST(sum(c) AS BIGINT) AS characters FROM n GROUP BY 1""",
}

"""Sinks: tables, CSV, JSON and HTML reports, manifests, sharded places."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.operators import ordered, reports

#: Fixed value: the columns of a batch's CSV.
BATCH_COLUMNS = ["document", "case_id", "sha256", "screening_test", "machine_verdict", "reviewer_decision", "reviewer", "assigned_to", "flagged_checks", "checks_run", "reviewed_at", "notes", "app_version", "detectors_version"]
APP_VERSION = DETECTORS_VERSION = "0.2"


def batch_rows(jobs: DataFrame, cases: DataFrame, verdicts: DataFrame, outcomes: DataFrame, reviews: DataFrame) -> DataFrame:
    """A row for each document: the columns of the CSV, and batch_id and batch_position before them."""
    flagged = outcomes.where("outcome in ('review', 'error')").groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_list("analyzer_id")), "; ").alias("flagged_checks"))
    by_job = lambda df: df.withColumnRenamed("job_id", "id")
    joined = jobs.join(cases.select("id", "profile"), "id", "left").join(by_job(verdicts), "id", "left").join(by_job(flagged), "id", "left").join(by_job(reviews), "id", "left")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return joined.select(
        "batch_id", "batch_position", F.col("filename").alias("document"), F.col("id").alias("case_id"), blank("sha256").alias("sha256"), blank("profile").alias("screening_test"), reports.verdict_label(F.col("verdict")).alias("machine_verdict"),
        reports.decision_label(F.col("decision")).alias("reviewer_decision"), blank("reviewer").alias("reviewer"), blank("assigned_to").alias("assigned_to"), blank("flagged_checks").alias("flagged_checks"), F.col("ran").alias("checks_run"),
        blank("reviewed_at").alias("reviewed_at"), F.regexp_replace(blank("notes"), r"\r\n|\n", " ").alias("notes"), F.lit(APP_VERSION).alias("app_version"), F.lit(DETECTORS_VERSION).alias("detectors_version"),
    )


def batch_csv(rows: DataFrame, path: str) -> None:
    """One CSV with a header; ``rows`` are of one batch, so one task writes them in order."""
    guarded = [F.when(F.rlike(F.col(c), F.lit(r"^[=+\-@\t]")), F.concat(F.lit("'"), F.col(c))).otherwise(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
    rows.select(*guarded).coalesce(1).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def case_json(rows: DataFrame) -> DataFrame:
    """(id, report): each row as one JSON text, nulls kept."""
    return rows.select("id", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("report"))


def batch_html(rows: DataFrame, title: str, order: list[str]) -> DataFrame:
    """``(position, html)``: a table of all rows as HTML, everything escaped, a line a row."""
    def cell(c):
        text = F.coalesce(c.cast("string"), F.lit("—"))
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
            text = F.replace(text, F.lit(sign), F.lit(name))
        return F.concat(F.lit("<td>"), text, F.lit("</td>"))

    body = ordered.numbered(rows.withColumn("_one", F.lit(1)), "_one", order, "position").select("position", F.concat(F.lit("<tr>"), *(cell(F.col(c)) for c in rows.columns), F.lit("</tr>")).alias("html"))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows.columns)
    ends = rows.sparkSession.createDataFrame([(0, f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><table><tr>{head}</tr>"), (1 << 62, "</table>")], "position long, html string")
    return body.unionByName(ends)


def write_html(lines: DataFrame, path: str) -> None:
    """The lines of :func:`batch_html` as text files that follow each other by name."""
    lines.repartitionByRange("position").sortWithinPartitions("position").select("html").write.mode("overwrite").text(path)


def write_manifest(rows: DataFrame, columns: list[str], path: str) -> None:
    """A stable projection of results, to be compared with :func:`manifest_difference` later."""
    rows.select(*columns).write.mode("overwrite").json(path)


def write_tables(tables: dict[str, DataFrame], path: str, formats: tuple[str, ...] = ("csv", "json")) -> None:
    """Each table under its name, as CSV with a header and as JSON lines."""
    for name, df in tables.items():
        for kind in formats:
            df.write.mode("overwrite").options(header="true").format(kind).save(f"{path}/{name}.{kind}")


def shard(key: Column) -> Column:
    """The two-level place of a key: the first digits of its hash."""
    h = F.sha2(key.cast("string"), 256)
    return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 2))


def manifest_difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(side, columns...): rows that only one of two manifests has, counted as often as they differ."""
    columns = expected.columns
    both = expected.withColumn("_n", F.lit(1)).unionByName(actual.withColumn("_n", F.lit(-1)))
    n = both.groupBy(*columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    side = F.when(F.col("_n") > 0, "missing").otherwise("unexpected")
    return n.select(*columns, side.alias("side"), F.explode(F.array_repeat(F.lit(0), F.abs("_n").cast("int")))).drop("col")


def workbook(rows: DataFrame, pairs: DataFrame, pages: DataFrame, checks: DataFrame, analyzers: list[str]) -> dict[str, DataFrame]:
    """The sheets of a batch's workbook as tables: summary, duplicates, pages and one for each check."""
    return {"Summary": rows, "Duplicates": pairs, "Per Page": pages, **{a: checks.where(F.col("analyzer_id") == a) for a in analyzers}}

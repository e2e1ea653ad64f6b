"""The store's tables as DataFrames: clean reads, visibility, listings, paging and mutations as appended versions."""

from __future__ import annotations

import base64
import json
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestry.session import table

#: The columns of jobs without the payload, so that listings never read it.
JOB_COLUMNS = ["id", "batch_id", "batch_position", "filename", "sha256", "status", "created_at", "started_at", "completed_at", "document_relpath", "owner_user_id", "flagged", "check_contract_version"]


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs without payloads; rows delivered twice fold by their key, of which copies agree in every column."""
    return table(spark, sf_dir, "jobs").select(*JOB_COLUMNS).dropDuplicates(["id"])


def visible(owner: str, mode: str = "development") -> Column:
    """Rows of ``owner``; rows without one are seen in development only."""
    return (F.col("owner_user_id") == owner) | (F.col("owner_user_id").isNull() & F.lit(mode == "development"))


def after_cursor(created_at: datetime | str, id_: str) -> Column:
    """Rows behind a cursor in the order newest first, ids descending."""
    at = F.lit(created_at).cast("timestamp_ntz")
    return (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < id_))


def encode_cursor(created_at: str, id_: str) -> str:
    return base64.urlsafe_b64encode(json.dumps([created_at, id_]).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> tuple[str, str]:
    """The inverse of :func:`encode_cursor`; ValueError for anything else."""
    try:
        at, id_ = json.loads(base64.urlsafe_b64decode(cursor + "=" * (-len(cursor) % 4)))
        datetime.fromisoformat(at)
        if not isinstance(id_, str):
            raise ValueError
    except Exception as e:
        raise ValueError("no cursor") from e
    return at, id_


def page(rows: DataFrame, limit: int, cursor: str | None = None, offset: int = 0) -> DataFrame:
    """One page, newest first; a cursor and an offset exclude each other. Ask for one row more to learn of a next page."""
    if cursor and offset:
        raise ValueError("a cursor and an offset exclude each other")
    if cursor:
        rows = rows.where(after_cursor(*decode_cursor(cursor)))
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset(offset).limit(limit)


def batch_status(queued_or_running: Column, total: Column) -> Column:
    """queued, running or completed from the counts of a batch's jobs."""
    return F.when(queued_or_running == 0, "completed").when(queued_or_running == total, "queued").otherwise("running")


def batch_summaries(batches: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row a batch that has jobs: counts by state and flag. Limit ``batches`` before, as a page does."""
    counts = jobs.groupBy("batch_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status").isin("queued", "running")).alias("active"),
        F.count_if(F.col("flagged") == 1).alias("flagged"),
    )
    return batches.join(counts, batches["id"] == counts["batch_id"]).select(
        "id", "name", "created_at", "project_id", "total", "completed", "active", "flagged", batch_status(F.col("active"), F.col("total")).alias("status")
    )


def latest(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The latest row of each key of an append-only table (an update is an append)."""
    order = Window.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    return events.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def append_missing(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``store`` and the rows of ``new`` whose key it lacks; of repeated new keys one stays."""
    return store.unionByName(new.dropDuplicates([key]).join(store.select(key), key, "left_anti").select(*store.columns))


def unfiled(batches: DataFrame, deleted: DataFrame) -> DataFrame:
    """Batches after projects ``deleted`` (id) are gone: theirs are in no project."""
    gone = deleted.select(F.col("id").alias("project_id"), F.lit(True).alias("_gone")).distinct()
    return batches.join(gone, "project_id", "left").select(*(F.when(F.col("_gone"), None).otherwise(F.col(c)).alias(c) if c == "project_id" else F.col(c) for c in batches.columns))


def recovered(runs: DataFrame) -> DataFrame:
    """Runs after a crash: finished ones stay, the others are queued anew and their job's counter rises."""
    lost = F.col("status").isin("queued", "running")
    return runs.withColumn("attempt", F.col("attempt") + F.when(F.col("status") == "running", 1).otherwise(0)).withColumn("status", F.when(lost, "queued").otherwise(F.col("status")))


def stale(jobs: DataFrame, version: int) -> DataFrame:
    """Jobs graded under an older contract, to be graded anew from their raw payloads."""
    return jobs.where(F.col("check_contract_version") < version)


def illegal_state(status: Column, created: Column, started: Column, completed: Column) -> Column:
    """What is wrong with a run's times for its status, or with their order; null if nothing is."""
    return (
        F.when((status == "queued") & (started.isNotNull() | completed.isNotNull()), "queued job has been run")
        .when((status == "running") & (started.isNull() | completed.isNotNull()), "running job needs its start only")
        .when(status.isin("completed", "failed") & (started.isNull() | completed.isNull()), "finished job lacks a time")
        .when(started < created, "started before it was queued")
        .when(completed < started, "completed before it was started")
    )


def claimed(claims: DataFrame, key: str, worker: str, order: list[str]) -> DataFrame:
    """(key, worker): the one worker whose claim of a queued job came first."""
    return claims.groupBy(key).agg(F.min_by(worker, F.struct(*order)).alias(worker))

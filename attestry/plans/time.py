"""Queries over time: failure windows, clocks, tumbling and session windows, streams run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.operators import windows
from attestry.session import table
from attestry.streaming import intake


def login_sliding_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return windows.failures_in_window(e, "user_id", "ts", "event_type = 'error'", minutes=24 * 60, most=3).select("event_id", "user_id", "failures", "locked")


def clock_rollbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of a source whose time of receipt lies more than five minutes behind an earlier fact's, by fact_id."""
    f = table(spark, sf_dir, "facts").select("fact_id", "source", "received_at")
    return windows.clock_check(f, "source", "received_at", "fact_id").groupBy("source").agg(F.count("*").alias("facts"), F.count_if("rollback").alias("rollbacks"))


def events_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.tumbling(table(spark, sf_dir, "events"), "ts", "1 day", "event_type")


def stream_events_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from a stream over the table, run until it has read everything."""
    return intake.run_to_end(intake.per_window(intake.events(spark, sf_dir), "1 day", "event_type"), "complete")


def stream_distinct_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type within the watermark's delay."""
    return intake.run_to_end(intake.first_seen(intake.events(spark, sf_dir), "60 days", "user_id", "event_type").select("user_id", "event_type"), "append")


def stream_lockouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lockouts of users by a stateful operator: three errors within a day."""
    return intake.run_to_end(intake.lockouts(intake.events(spark, sf_dir), 24 * 60, 3), "append")


QUERIES = {f.__name__: f for f in (login_sliding_window, clock_rollbacks, events_per_day, stream_events_per_day, stream_distinct_events, stream_lockouts)}

_DAILY = "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"

SQL = {
    "login_sliding_window": "SELECT event_id, user_id, count(*) OVER w AS failures, count(*) OVER w >= 3 AS locked FROM events WHERE event_type = 'error' WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)",
    "clock_rollbacks": "WITH h AS (SELECT source, received_at, max(received_at) OVER (PARTITION BY source ORDER BY fact_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM facts) SELECT source, count(*) AS facts, count_if(coalesce(high - received_at > INTERVAL 5 MINUTE, false)) AS rollbacks FROM h GROUP BY 1",
    "events_per_day": _DAILY,
    "stream_events_per_day": _DAILY,
    "stream_distinct_events": "SELECT DISTINCT user_id, event_type FROM events",
}

"""Ordered operators over time: sliding failure windows with lockout, a clock that may not run back, buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators import ordered


def failures_in_window(events: DataFrame, key: str, at: str, failed: str, minutes: int = 15, most: int = 5) -> DataFrame:
    """Failures with how many their key had in the ``minutes`` up to them, and whether that locks the key out."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    width = minutes * 60_000_000
    # Time falls into spans of the window's width; a row stands in its own and, for those after it, in the next, so a hot key takes many tasks.
    rows = events.where(failed).withColumn("_us", micros).withColumn("_span", F.floor(F.col("_us") / width))
    both = rows.withColumn("_in", F.explode(F.array("_span", F.col("_span") + 1)))
    w = Window.partitionBy(key, "_in").orderBy("_us").rangeBetween(-width, 0)
    counted = both.withColumn("failures", F.count("*").over(w)).where(F.col("_in") == F.col("_span"))
    return counted.withColumn("locked", F.col("failures") >= most).drop("_us", "_span", "_in")


def clock_check(events: DataFrame, key: str, at: str, order: str, tolerance_minutes: int = 5) -> DataFrame:
    """Rows with the latest time seen before them, and whether their clock runs back further than tolerated."""
    seen = ordered.highest_before(events, key, [order], at)
    back = F.unix_micros(F.col("high").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    return seen.withColumn("rollback", F.coalesce(back > tolerance_minutes * 60_000_000, F.lit(False)))


def tumbling(events: DataFrame, at: str, width: str, *by: str) -> DataFrame:
    """(start, by..., n) for half-open windows [start, start + width)."""
    w = F.window(F.col(at).cast("timestamp"), width)
    return events.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *by, "n")


def runs(events: DataFrame, key: str, order: list[str], bad: str, least: int) -> DataFrame:
    """(key, runs, longest): how many times, and for how long at most, ``least`` bad events or more of a key followed each other."""
    placed = ordered.numbered(events.select(key, *order, bad), key, order, "_n").where(bad)
    again = ordered.numbered(placed, key, order, "_m")
    n = again.groupBy(key, (F.col("_n") - F.col("_m")).alias("_g")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return n.groupBy(key).agg(F.count("*").alias("runs"), F.max("n").alias("longest"))

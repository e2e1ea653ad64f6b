"""Text templates and baselines: consistency of repeated lines, drift against a baseline, nearest spans, page retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import text as T


def lines(documents: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, line): trimmed lines that hold something, numbered from 0 among all lines."""
    split = documents.where(F.col(text).isNotNull()).select(F.col(key), F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line_no", "line"))
    return split.select(key, "line_no", F.trim("line").alias("line")).where("line <> ''")


def consistency(spans: DataFrame, text: str, style: str, size: str, least: int = 2, spread: float = 0.30) -> DataFrame:
    """(text, n, styles, size_spread): texts that occur ``least`` times or more in several styles or in sizes that differ."""
    g = spans.groupBy(text).agg(F.count("*").alias("n"), F.count_distinct(style).alias("styles"), (F.max(size) - F.min(size)).alias("size_spread"))
    return g.where((F.col("n") >= least) & ((F.col("styles") > 1) | (F.col("size_spread") > spread)))


def baseline(samples: DataFrame, key: str, sample: str) -> DataFrame:
    """(key, samples): each key with the number of samples that have it."""
    return samples.groupBy(key).agg(F.count_distinct(sample).alias("samples"))


def drift(found: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """(key, state, severity): 'new' if only found, 'missing' if only in the baseline; low if missing where not all samples have it either."""
    new = found.select(key).distinct().join(base.select(key), key, "left_anti").select(key, F.lit("new").alias("state"), F.lit("medium").alias("severity"))
    most = base.agg(F.max("samples").alias("most"))  # one row
    seen = base.withColumn("one", F.lit(1)).join(most.withColumn("one", F.lit(1)), "one")
    gone = seen.join(found.select(key), key, "left_anti").select(key, F.lit("missing").alias("state"), F.when(F.col("samples") < F.col("most"), "low").otherwise("medium").alias("severity"))
    return new.unionByName(gone)


def span_distance(a: str, b: str) -> Column:
    """How far two boxes lie apart: the greatest distance of their four edges, in shares of their pages."""
    return F.greatest(*(F.abs(F.col(f"{a}_{e}") - F.col(f"{b}_{e}")) for e in ("x0", "y0", "x1", "y1")))


def nearest(found: DataFrame, base: DataFrame, on: list[str], distance: Column, order: str) -> DataFrame:
    """Each found span (columns a_*) with the baseline span (b_*) of the same ``on`` at the least distance; ties by the baseline's ``order``. A pair without a distance is none."""
    w = Window.partitionBy(f"a_{order}").orderBy("distance", f"b_{order}")
    return found.join(base, on).withColumn("distance", distance).where("distance is not null").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def rank_pages(pages: DataFrame, key: str, page: str, text: str, terms: list[str], preferred: list[int], current: int | None, limit: int) -> DataFrame:
    """(key, page, score, rank, position): the best pages by how often they hold the terms, 5 more for the current and 3 for preferred ones, ties by page; position is the order in which they are read, by page."""
    score = sum((T.occurrences(F.coalesce(text, F.lit("")), F.lit(t)) for t in terms), F.lit(0))
    if current is not None:
        score = score + F.when(F.col(page) == current, 5).otherwise(0)
    score = score + F.when(F.col(page).isin(preferred or [-1]), 3).otherwise(0)
    w = Window.partitionBy(key).orderBy(F.desc("score"), page)
    return pages.withColumn("score", score).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select(key, page, "score", "rank", F.row_number().over(Window.partitionBy(key).orderBy(page)).alias("position"))

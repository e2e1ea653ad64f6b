"""Numbering, neighbours and running maxima over any number of rows of one key.

Rows are range-partitioned by key and order, so a hot key covers many
partitions; each is worked on by itself, and a table with a row for each key
and partition carries what lies before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.session import written


def _ranged(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with their partition _p, written so that it stays."""
    return written(rows.repartitionByRange(key, *order).withColumn("_p", F.spark_partition_id()), "ranged")


def _before():
    return Window.partitionBy("_k").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)


def _carried(parts: DataFrame, key: str, rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``columns`` of ``parts`` (_k, _p, ...)."""
    p = parts.select(F.col("_k").alias("_ck"), F.col("_p").alias("_cp"), *columns)
    return rows.join(p, (F.col(key).eqNullSafe(F.col("_ck"))) & (F.col("_p") == F.col("_cp"))).drop("_ck", "_cp")


def numbered(rows: DataFrame, key: str, order: list[str], name: str = "n") -> DataFrame:
    """``rows`` with their number from 1 within ``key`` in ``order``, which must tell all rows of a key apart."""
    ranged = _ranged(rows, key, order)
    parts = ranged.groupBy(F.col(key).alias("_k"), "_p").agg(F.count("*").alias("c"))
    parts = parts.withColumn("_o", F.coalesce(F.sum("c").over(_before()), F.lit(0)))
    local = F.row_number().over(Window.partitionBy("_p", key).orderBy(*order))
    return _carried(parts, key, ranged.withColumn("_i", local), ["_o"]).withColumn(name, F.col("_i") + F.col("_o")).drop("_i", "_o", "_p")


def neighbours(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """``rows`` with previous_<value>, next_<value> within ``key`` in ``order`` and their position from 0."""
    ranged = _ranged(rows, key, order)
    at = F.struct(*order)
    parts = ranged.groupBy(F.col(key).alias("_k"), "_p").agg(F.count("*").alias("c"), F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))
    by = Window.partitionBy("_k").orderBy("_p")
    parts = parts.select("_k", "_p", F.coalesce(F.sum("c").over(_before()), F.lit(0)).alias("_o"), F.lag("last").over(by).alias("_l"), F.lead("first").over(by).alias("_f"))
    w = Window.partitionBy("_p", key).orderBy(*order)
    local = ranged.withColumn("_i", F.row_number().over(w)).withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w)).withColumn("_n", F.count("*").over(Window.partitionBy("_p", key)))
    out = _carried(parts, key, local, ["_o", "_l", "_f"])
    previous, following = F.when(F.col("_i") == 1, F.col("_l")).otherwise(F.col("_a")), F.when(F.col("_i") == F.col("_n"), F.col("_f")).otherwise(F.col("_b"))
    return out.withColumn(f"previous_{value}", previous).withColumn(f"next_{value}", following).withColumn("position", F.col("_i") + F.col("_o") - 1).drop("_i", "_o", "_a", "_b", "_l", "_f", "_n", "_p")


def highest_before(rows: DataFrame, key: str, order: list[str], value: str, name: str = "high") -> DataFrame:
    """``rows`` with the greatest ``value`` of their key strictly before them in ``order``."""
    ranged = _ranged(rows, key, order)
    parts = ranged.groupBy(F.col(key).alias("_k"), "_p").agg(F.max(value).alias("m"))
    parts = parts.withColumn("_c", F.max("m").over(_before()))
    local = F.max(value).over(Window.partitionBy("_p", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return _carried(parts, key, ranged.withColumn("_h", local), ["_c"]).withColumn(name, F.greatest("_h", "_c")).drop("_h", "_c", "_p")


def running_sum(rows: DataFrame, key: str, order: list[str], value: str, name: str = "total") -> DataFrame:
    """``rows`` with the sum of ``value`` of their key up to them in ``order``."""
    ranged = _ranged(rows, key, order)
    parts = ranged.groupBy(F.col(key).alias("_k"), "_p").agg(F.sum(value).alias("m"))
    parts = parts.withColumn("_c", F.coalesce(F.sum("m").over(_before()), F.lit(0)))
    local = F.sum(value).over(Window.partitionBy("_p", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return _carried(parts, key, ranged.withColumn("_s", local), ["_c"]).withColumn(name, F.col("_s") + F.col("_c")).drop("_s", "_c", "_p")

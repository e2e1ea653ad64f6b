"""All core queries by name, with their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from attestry.plans import casework, drift_nested, evidence, grades, listings, reporting, signals, texts, time

MODULES = [drift_nested, listings, reporting, evidence, texts, time, grades, signals, casework]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}

"""All reference queries and their oracle SQL, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellum.plans import browse, curation, desk, details, edition, functions_sql, harvests, ordered, rounds, scale, spend, stored, texts
from vellum.streaming import daily, frames, ledger

MODULES = (spend, browse, texts, ordered, curation, edition, details, desk, scale, harvests, rounds, stored, functions_sql, daily, frames, ledger)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}

"""All queries of the library, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.plans import details, geometry, laterals, linking, measures, phrasal, rules, shapes, stores, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for module in (texts, shapes, rules, measures, geometry, linking, stores, details, laterals, phrasal):
    for name, (query, sql) in module.ALL.items():
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql

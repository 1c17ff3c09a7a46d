"""The registered queries of the core, and the SQL that gives the same rows. Each query takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docsql.plans import analytics, assistant, loading, pipelines, records, stores, texts

Query = Callable[[SparkSession, str], DataFrame]
MODULES = [analytics, assistant, loading, pipelines, records, stores, texts]


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}

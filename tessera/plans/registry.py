"""Registered queries: a Spark builder and, where SQL can say it, a DuckDB twin.

A builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
supplied tables. The SQL twin runs on views named like the tables. Both must
produce the same column names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    ops: tuple[str, ...]  # survey ids covered

    @property
    def oracle(self) -> str | None:
        """The SQL twin with its columns cast to the Spark query's types
        where DuckDB's own result types differ (values are unchanged)."""
        if not self.sql:
            return None
        from tessera.plans.oracle_casts import ORACLE_CASTS
        casts = ORACLE_CASTS.get(self.name)
        if not casts:
            return self.sql
        rep = ", ".join(f'CAST("{c}" AS {t}) AS "{c}"' for c, t in casts.items())
        return f"SELECT * REPLACE ({rep}) FROM ({self.sql}) AS twin"


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None, ops: tuple[str, ...] = ()):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql, tuple(ops))
        return fn
    return deco


def load_all() -> dict[str, Query]:
    # importing the plan modules fills QUERIES
    from tessera.plans import (indicator, tasks, quality, ledger, kpi,  # noqa: F401
                               conversation, retrieval, links, posts, modeling, streams)
    return QUERIES

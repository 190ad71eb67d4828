"""Registry of named queries and their DuckDB oracle SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tailorspark.session import ensure_checkpoint_dir

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, Callable[[], str]] = {}


def register(name: str, sql: Callable[[], str] | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``.

    ``sql`` builds the equivalent DuckDB statement; omit it for model output
    and streaming results (rows-only check).
    """
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # any session (ours or the caller's) gets the shared folder and SQL rules
            ensure_checkpoint_dir(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # importing the modules fills the registry
    from tailorspark.plans import (  # noqa: F401
        q_bootstrap, q_catalog, q_clickstream, q_coldstart, q_models, q_pages, q_users)


def all_queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(QUERIES)


def all_oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v() for k, v in ORACLE.items()}

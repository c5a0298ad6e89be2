"""The registered queries: a Spark plan and, where SQL can say it, the same question as plain SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pigeonhole.plans.views import Inputs, with_views

Build = Callable[[Inputs], DataFrame]
PLANS: dict[str, Build] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        if name in PLANS:
            raise ValueError(f"query {name} is registered twice")
        PLANS[name] = build
        if sql is not None:
            SQL[name] = sql
        return build
    return register


def load() -> None:
    """Import the modules that register queries."""
    import importlib

    for module in MODULES:
        importlib.import_module(f"pigeonhole.plans.{module}")


MODULES = ["decision_queries", "ledger_queries", "response_queries", "correction_queries", "outline_queries", "request_queries", "source_queries", "streaming_queries"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    load()
    return {name: (lambda spark, sf_dir, b=build: b(Inputs(spark, sf_dir))) for name, build in PLANS.items()}


def oracle_sql() -> dict[str, str]:
    load()
    return {name: with_views(sql) for name, sql in SQL.items()}

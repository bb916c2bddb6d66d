"""Named queries of this package and, where SQL can express them, their DuckDB formulation."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
MODULES = (
    "near_copies", "packing", "line_runs", "toxicity", "chat", "licenses", "token_prefixes", "neighbours", "secrets", "contamination",
    "word_runs", "manifest", "fingerprints",
)


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"quire.llm.{module}")


def all_queries() -> dict[str, Query]:
    _load_all()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load_all()
    return dict(SQL)

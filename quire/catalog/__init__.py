"""Named queries over the driver tables, each with an independent SQL formulation."""

import importlib

from quire.catalog.base import QUERIES, SQL

MODULES = ("markup_queries", "link_queries", "region_queries", "collection_queries", "registry_queries", "sink_queries")


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"quire.catalog.{module}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)

"""Tests of a few keys against stored rows, where files and row groups that cannot hold them are skipped (M5, SRC5, N1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F

MOST_KEYS = 500  # keys that are looked up one by one; more of them are joined
PUSHED = 10  # values of a list that Spark hands to the Parquet reader as equalities; a longer one becomes a range only


def with_key_filter(writer: DataFrameWriter, key: str) -> DataFrameWriter:
    """Files get a Bloom filter of the key for each row group, sized by the keys the group has (1 MB at most)."""
    return writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")


def is_one_of(key: Column, keys: list) -> Column:
    """``key`` is one of ``keys``, in a form that reaches the statistics and Bloom filters of row groups."""
    known = sorted({k for k in keys if k is not None})
    lists = [key.isin(known[i : i + PUSHED]) for i in range(0, len(known), PUSHED)]
    return reduce(Column.__or__, lists, F.lit(False)) if lists else F.lit(False)


def few_keys(docs: DataFrame, key: str, most: int = MOST_KEYS) -> list | None:
    """The distinct keys of ``docs`` if there are ``most`` or fewer, else None; at most one key more reaches the driver."""
    found = docs.select(key).where(F.col(key).isNotNull()).distinct().limit(most + 1).collect()
    return None if len(found) > most else [r[0] for r in found]


def narrowed(stored: DataFrame, docs: DataFrame, key: str = "doc_id", most: int = MOST_KEYS) -> DataFrame:
    """``stored`` for a join with ``docs`` by the key: only the rows of their keys if those are few, else all of it.

    Joins give the same rows either way. ``docs`` is looked at in a job of its own, so it should be a stored table.
    """
    keys = few_keys(docs, key, most)
    return stored if keys is None else stored.where(is_one_of(F.col(key), keys))

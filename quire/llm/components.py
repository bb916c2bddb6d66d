"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.scratch import settle


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of a link; component is the smallest node reachable.

    Each round hangs a node's larger neighbours, then its smaller ones, on the smallest node next to it, until every
    component is a star. The minimum over a node's neighbours is an aggregate that combines before the shuffle, and a
    node with very many neighbours meets it in a join whose large side AQE may split; no neighbour list is gathered.
    Each round's links are a written table. Null nodes and links of a node to itself take no part; no links, no rows.
    """
    a, b = F.col(left), F.col(right)
    links = links.where(a.isNotNull() & b.isNotNull() & (a != b))
    links = links.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct()
    links = settle(links, "links")
    state = _state(links)
    while state[0]:
        both = links.select("high", "low").union(links.select("low", "high")).toDF("u", "v")
        nearest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(nearest, "u").select(F.col("v").alias("high"), F.col("m").alias("low"))
        large = large.where("high != low").distinct()
        lowest = large.groupBy("high").agg(F.min("low").alias("m"))
        both = F.array(*[F.struct(F.col(c).alias("high"), F.col("m").alias("low")) for c in ("high", "low")])
        small = large.join(lowest, "high").select(F.inline(both))
        links = settle(small.where("high != low").distinct(), "links")
        before, state = state, _state(links)
        if state == before:
            break
    return links.select(F.col("high").alias("node"), F.col("low").alias("component")).union(
        links.select(F.col("low"), F.col("low")).distinct()
    )

"""Helpers over array columns that keep per-document work inside the document's own row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Column expressions are inlined wherever they are used; inside a lambda that means once per element. Binding
    through a one-element array makes the value a lambda variable, computed once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strings(values) -> Column:
    """A literal array<string>, typed even when empty."""
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def contains_any(text: Column, words) -> Column:
    """True when ``text`` contains any of a short literal list of words."""
    out = F.lit(False)
    for word in words:
        out = out | F.contains(text, F.lit(word))
    return out


def count_contained(text: Column, words) -> Column:
    """How many of a short literal list of words ``text`` contains."""
    out = F.lit(0)
    for word in words:
        out = out + F.when(F.contains(text, F.lit(word)), 1).otherwise(0)
    return out


def appended(buffer: Column, items: Column) -> Column:
    """Append ``items`` to a two-level buffer (``tail`` of up to BLOCK items, ``full`` list of filled blocks).

    Arrays are immutable, so appending one by one copies the whole array each time. The two levels bound each copy by
    the block size plus the number of blocks.
    """
    is_full = F.size(buffer["tail"]) >= BLOCK
    return F.struct(
        F.when(is_full, items).otherwise(F.concat(buffer["tail"], items)).alias("tail"),
        F.when(is_full, F.concat(buffer["full"], F.array(buffer["tail"]))).otherwise(buffer["full"]).alias("full"),
    )


def empty_buffer(item_type: str) -> Column:
    return F.struct(
        F.array().cast(f"array<{item_type}>").alias("tail"),
        F.array().cast(f"array<array<{item_type}>>").alias("full"),
    )


def buffered(buffer: Column) -> Column:
    return F.concat(F.flatten(buffer["full"]), buffer["tail"])


def running(values: Column, zero: Column, zero_type: str, merge: Callable[[Column, Column], Column]) -> Column:
    """Exclusive running fold: element i is the fold of elements 0..i-1, with the total as one extra last element."""
    return F.aggregate(
        values,
        F.struct(zero.cast(zero_type).alias("acc"), empty_buffer(zero_type).alias("buf")),
        lambda s, x: F.struct(
            merge(s["acc"], x).cast(zero_type).alias("acc"),
            appended(s["buf"], F.array(s["acc"])).alias("buf"),
        ),
        lambda s: F.concat(buffered(s["buf"]), F.array(s["acc"])),
    )


def replace_ranges(pieces: Column, ranges: Column, glue: str) -> Column:
    """Join string ``pieces`` after replacing each half-open index range by ``glue``.

    ``ranges`` is a sorted, disjoint array<struct<from,to>>; an empty range is an insertion point. Linear in the number
    of pieces.
    """

    def join(all_pieces: Column, gaps: Column) -> Column:
        def part(k: Column) -> Column:
            start = F.coalesce(F.get(gaps, k - 1)["to"], F.lit(0))
            end = F.coalesce(F.get(gaps, k)["from"], F.size(all_pieces))
            return F.array_join(F.slice(all_pieces, start + 1, F.greatest(end - start, F.lit(0))), "")

        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(gaps)), part), glue)

    return let(pieces, lambda p: let(ranges, lambda r: join(p, r)))


def outermost(spans: Column) -> Column:
    """Keep the spans (sorted by ``open``) that no earlier kept span covers."""
    return let(
        spans,
        lambda all_spans: let(
            running(all_spans, F.lit(-1), "int", lambda far, x: F.greatest(far, x["close"])),
            lambda reach: F.filter(all_spans, lambda x, i: x["open"] > F.get(reach, i)),
        ),
    )

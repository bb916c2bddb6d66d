"""Nesting of marks and lone links: one pass with a stack over a page's marks, in Arrow batches.

A stack that grows and shrinks is the one thing column functions cannot keep without copying it at every step, which
makes a page of n marks cost n times n. These two kernels get narrow arrays (names and lengths, never the page) and touch
each mark once. They take the pages of a batch one by one and give rows back every ``CHUNK`` marks, so that a task holds
one page's lists and the elements of few pages, whatever number of pages Spark puts into a batch.
"""

from __future__ import annotations

from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quire.rules import SELF_CLOSING_SCOPES, VOID_TAGS

CHUNK = 1 << 16  # marks; elements take 40 bytes and a tag, so a chunk gives back about 2 MB
_FIELDS = ("id", "tag", "open", "close", "depth", "parent", "start", "len", "links", "hits")
_GONE = ("open", "close", "tag")


def _type_of(fields) -> ArrayType:
    return ArrayType(StructType([StructField(f, StringType() if f == "tag" else IntegerType()) for f in fields]))


def _columns(fields) -> dict[str, list | array]:
    return {f: [] if f == "tag" else array("i") for f in fields}


def _lists(columns: dict[str, list | array], ends: list[int | None]) -> pa.Array:
    """The columns as one struct array, cut into lists that end at ``ends``; None makes a null list."""
    values = [
        pa.array(c, pa.string()) if f == "tag" else pa.array(np.frombuffer(c, np.int32) if c else [], pa.int32())
        for f, c in columns.items()
    ]
    starts, at = [], 0
    for end in ends:
        starts.append(None if end is None else at)
        at = at if end is None else end
    lists = pa.array([*starts, at], pa.int32())
    return pa.ListArray.from_arrays(lists, pa.StructArray.from_arrays(values, list(columns)))


def _sizes(lists: pa.Array) -> list[int | None]:
    return lists.value_lengths().to_pylist()


def _numbers(values: pa.Array) -> np.ndarray:
    return values.cast(pa.int32()).fill_null(0).to_numpy(zero_copy_only=False)


def _words(values: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Codes of the values and the distinct values, so that equal names are one object."""
    coded = values.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()


def nested(
    names: list[str], lengths: list[int], links: str | None, hits: list[int] | None, into: dict[str, list | array] | None = None
) -> dict[str, list | array]:
    """Elements of one page in the order of their opening marks, appended to the columns ``into``.

    ``lengths[k]`` is the text length before mark k and has one more entry than ``names``. A closing mark ends the
    innermost open element of its name and all inside it, and is ignored without one; some elements end an earlier one of
    their name within their scope; the page's end closes all.
    """
    into = _columns(_FIELDS) if into is None else into
    base = len(into["id"])
    ids, tags, opens_at, closes_at, depths, parents, starts, sizes, inner_links, inner_hits = (into[f] for f in _FIELDS)
    stack: list[int] = []
    places: dict[str, list[int]] = defaultdict(list)  # stack indices of each name
    text = seen_links = seen_hits = 0

    def close(keep: int, pos: int, upto: int) -> None:
        while len(stack) > keep:
            k = base + stack.pop()
            places[tags[k]].pop()
            closes_at[k] = pos
            sizes[k] = upto - starts[k]
            inner_links[k] = seen_links - inner_links[k]
            inner_hits[k] = seen_hits - inner_hits[k]

    def innermost(tag: str) -> int:
        return places[tag][-1] if places.get(tag) else -1

    for pos, name in enumerate(names):
        upto = text + lengths[pos]
        closing = name.startswith("/")
        opens = not closing and name != "" and name not in VOID_TAGS
        if closing:
            at = innermost(name.lstrip("/"))
            if at >= 0:
                close(at, pos, upto)
        elif opens and name in SELF_CLOSING_SCOPES:
            at = innermost(name)
            if at > max((innermost(t) for t in SELF_CLOSING_SCOPES[name]), default=-1):
                close(at, pos, upto)
        if opens:
            own = len(ids) - base
            places[name].append(len(stack))
            ids.append(own)
            tags.append(name)
            opens_at.append(pos)
            closes_at.append(-1)
            depths.append(len(stack) + 1)
            parents.append(stack[-1] if stack else -1)
            starts.append(upto)
            sizes.append(0)
            inner_links.append(seen_links)
            inner_hits.append(seen_hits)
            stack.append(own)
        text = upto
        seen_links += links is not None and name == links
        seen_hits += hits[pos] if hits is not None else 0
    close(0, len(names), text + lengths[len(names)])
    return into


def spans_of(batches, links: str | None, chunk: int = CHUNK) -> Iterator[pa.Array]:
    """``nested`` for each page of batches (names, lengths and, if wanted, hits), a chunk of marks at a time."""
    for names, lengths, *counted in batches:
        codes, words = _words(names.flatten())
        length = _numbers(lengths.flatten())
        hits = _numbers(counted[0].flatten()) if counted else None
        columns, ends, marks = _columns(_FIELDS), [], 0
        at = at_length = at_hits = 0
        counts = _sizes(counted[0]) if counted else [0] * len(names)
        for n, n_lengths, n_hits in zip(_sizes(names), _sizes(lengths), counts):
            if n is None or n_lengths is None:
                ends.append(None)
            else:
                page = [words[c] for c in codes[at : at + n].tolist()]
                hit = hits[at_hits : at_hits + n_hits].tolist() if counted and n_hits is not None else None
                nested(page, length[at_length : at_length + n_lengths].tolist(), links, hit, columns)
                ends.append(len(columns["id"]))
                marks += n
            at, at_length, at_hits = at + (n or 0), at_length + (n_lengths or 0), at_hits + (n_hits or 0)
            if marks >= chunk:
                yield _lists(columns, ends)
                columns, ends, marks = _columns(_FIELDS), [], 0
        if ends:
            yield _lists(columns, ends)


def element_spans(names: Column, lengths: Column, links: str | None = None, hits: Column | None = None) -> Column:
    """array<struct> of ``nested``; null names give null."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        return spans_of(batches, links)

    return F.arrow_udf(run, _type_of(_FIELDS))(names, lengths, *([] if hits is None else [hits]))


def removals(batches, containers: frozenset[str], slack: int, chunk: int = CHUNK) -> Iterator[pa.Array]:
    """The links to take out of each page of batches of judged elements, a chunk of elements at a time."""
    for elements in batches:
        flat = elements.flatten()
        codes, words = _words(flat.field("tag"))
        held = [words.index(w) for w in containers if w in words]
        fields = [_numbers(flat.field(f)) for f in ("open", "close", "len", "short", "alone")]
        columns, ends, at, seen = _columns(_GONE), [], 0, 0
        for size in _sizes(elements):
            removed, stack = 0, []  # close, tag, len, removed when it opened
            part = slice(at, at + (size or 0))
            for tag, opened, closed, length, short, alone in zip(codes[part].tolist(), *(f[part].tolist() for f in fields)):
                while stack and stack[-1][0] <= opened:
                    stack.pop()
                gone = False
                if short:
                    gone = alone
                    if not gone and stack and stack[-1][1] in held:
                        gone = stack[-1][2] - (removed - stack[-1][3]) < length + slack
                stack.append((closed, tag, length, removed))
                if gone:
                    removed += length
                    for f, value in zip(_GONE, (opened, closed, words[tag])):
                        columns[f].append(value)
            at, seen = part.stop, seen + (size or 0)
            ends.append(None if size is None else len(columns["open"]))
            if seen >= chunk:
                yield _lists(columns, ends)
                columns, ends, seen = _columns(_GONE), [], 0
        if ends:
            yield _lists(columns, ends)


def lone_links(elements: Column, containers, slack: int) -> Column:
    """array<struct<open,close,tag>> of the links to take out, from elements with short and alone, in document order.

    A short link goes if it stands alone, or if its direct parent is one of ``containers`` and holds little text besides
    it, counting only what earlier removals have left there.
    """
    containers = frozenset(containers)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return removals(batches, containers, slack)

    return F.arrow_udf(run, _type_of(_GONE))(elements)

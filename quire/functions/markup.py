"""HTML without a tree: token arrays, tag skeletons and element spans, all inside the page's own row.

Three representations, each one native regular-expression pass over the page:

* ``tokens``    array of tags and texts, attributes included;
* ``skeleton``  the page as one string in which every tag is ``\\x01name\\x02`` and the text is decoded. Control
  characters cannot occur in the text, so later patterns need not care about quotes, attributes or ``<`` in prose;
* ``elements``  one struct per element with its interval over the tag sequence (``open``, ``close``), its parent and
  the amount of text inside. Containment is then interval comparison and never a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import let
from quire.functions.spans import element_spans
from quire.functions.text import BLANK, decode_entities, py_strip
from quire.operators.settle import settled
from quire.rules import VOID_TAGS

# Possessive quantifiers: the engine never recurses or backtracks, however long an attribute list is.
_TAG_REST = r"""[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+>"""
_DROPPED = r"!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>|[!?][^>]*+>"
TAG = rf"</?[A-Za-z]{_TAG_REST}"
TOKEN = rf"(?is)<(?:{_DROPPED}|/?[a-z]{_TAG_REST})|[^<]+|<"
# Control characters already in the page become nameless marks as well.
_SKELETON = rf"(?is)<(?:{_DROPPED}|(/?[a-z][a-z0-9:-]*+){_TAG_REST})|[\x01\x02]"
_TAG_NAME = r"^</?([A-Za-z][A-Za-z0-9:-]*)"
_ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""

MARK = r"\x01[^\x02]*+\x02"
BREAK = "\x01\x02"  # a nameless mark: separates two text nodes and nothing else


# --- tokens --------------------------------------------------------------------------------------------------


def tokens(html: Column) -> Column:
    """The tags and texts of a page in order, comments, scripts and styles included as tokens to skip."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, _TAG_NAME, 1))


def token_kind(token: Column, name: Column) -> Column:
    """'open', 'close', 'void', 'text' or 'skip'."""
    return (
        F.when(F.startswith(token, F.lit("</")) & (name != ""), "close")
        .when(token.rlike(r"(?is)^<(?:[!?].|script\b.*</script|style\b.*</style)"), "skip")
        .when(name.isin(*VOID_TAGS), "void")
        .when(name != "", "open")
        .otherwise("text")
    )


def _attribute_part(token: Column, group: int) -> Column:
    body = F.regexp_replace(token, F.lit(_TAG_NAME), F.lit(""))
    return F.regexp_extract_all(body, F.lit(_ATTRIBUTE), F.lit(group))


def _unquoted(value: Column) -> Column:
    return decode_entities(F.regexp_replace(value, F.lit("(?s)^([\"'])(.*)\\1$"), F.lit("$2")))


def attributes(token: Column) -> Column:
    """Attribute map of a tag token, names lower-cased, the first of equal names wins."""
    return let(
        F.transform(_attribute_part(token, 1), F.lower),
        lambda names: let(
            _attribute_part(token, 2),
            lambda values: F.map_from_entries(
                F.filter(
                    F.transform(
                        names,
                        lambda n, i: F.when(
                            F.array_position(names, n) == i + 1,
                            F.struct(n.alias("key"), _unquoted(F.get(values, i)).alias("value")),
                        ),
                    ),
                    lambda e: e.isNotNull(),
                )
            ),
        ),
    )


def attribute(token: Column, name: str) -> Column:
    """One attribute of a tag token; null when absent, '' when it has no value."""
    return let(
        F.array_position(F.transform(_attribute_part(token, 1), F.lower), F.lit(name)),
        lambda at: F.when(at > 0, _unquoted(F.get(_attribute_part(token, 2), (at - 1).cast("int")))),
    )


# --- skeletons -----------------------------------------------------------------------------------------------


def skeleton(html: Column) -> Column:
    """The page as decoded text with bare tag marks; dropped blocks leave a nameless mark."""
    return decode_entities(F.regexp_replace(html, F.lit(_SKELETON), F.lit("\x01$1\x02")))


def with_numbered_images(bare: Column) -> Column:
    """A skeleton whose k-th image mark (from 0) is named ``img=k``, a name no tag has."""
    parts = F.split(bare, r"(?i)\x01img\x02", -1)
    numbered = F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit("\x01img="), i - 1, F.lit("\x02"), p)))
    return F.array_join(numbered, "")


def image_numbers(bare: Column) -> Column:
    """Which images a skeleton still holds, in order."""
    return F.transform(F.regexp_extract_all(bare, F.lit(r"\x01img=([0-9]+)\x02"), F.lit(1)), lambda n: n.cast("int"))


def without_image_numbers(bare: Column) -> Column:
    return F.regexp_replace(bare, F.lit(r"\x01img=[0-9]+\x02"), F.lit("\x01img\x02"))


def mark_pattern(names) -> str:
    """Pattern for the opening and closing marks of the given tags (any case)."""
    return rf"(?i)\x01/?(?:{'|'.join(names)})\x02"


def mark_names(marks: Column) -> Column:
    """['\\x01TD\\x02', '\\x01/td\\x02'] -> ['td', '/td']"""
    return F.transform(marks, lambda m: F.lower(F.translate(m, "\x01\x02", "")))


def node_text(bare: Column) -> Column:
    """Every text node stripped, concatenated with nothing in between."""
    return F.array_join(F.transform(F.split(bare, MARK, -1), py_strip), "")


def joined_text(bare: Column) -> Column:
    """Text nodes joined by a newline."""
    trimmed = F.regexp_replace(bare, F.lit(rf"^(?:{MARK})+|(?:{MARK})++$"), F.lit(""))
    return F.regexp_replace(trimmed, F.lit(rf"(?:{MARK})+"), F.lit("\n"))


def raw_text(bare: Column) -> Column:
    """Text nodes concatenated as they are."""
    return F.regexp_replace(bare, F.lit(MARK), F.lit(""))


def block_text(bare: Column, block_tags) -> Column:
    """Text in which block-level marks become a blank line and inline marks vanish."""
    return raw_text(F.regexp_replace(bare, F.lit(mark_pattern(block_tags)), F.lit("\n\n")))


def br_to_breaks(html: Column) -> Column:
    """A run of two or more <br> becomes a blank line, a single one a newline."""
    out = F.regexp_replace(html, F.lit(r"(?i)(?:<br\s*/?>\s*+){2,}"), F.lit("\n\n"))
    return F.regexp_replace(out, F.lit(r"(?i)<br\s*/?>"), F.lit("\n"))


def bare_br_to_breaks(bare: Column) -> Column:
    """T8 on a skeleton."""
    out = F.regexp_replace(bare, F.lit(rf"(?i)(?:\x01br\x02{BLANK}*+){{2,}}"), F.lit("\n\n"))
    return F.regexp_replace(out, F.lit(r"(?i)\x01/?br\x02"), F.lit("\n"))


def strip_wrappers(html: Column) -> Column:
    """Drop document and table wrapper tags, and the head with all it holds; text without any is left at once."""
    out = html
    for pattern in (
        r"(?i)</?html[^>]*>",
        r"(?i)</?body[^>]*>",
        r"(?is)</?head[^>]*>.*?</head>",
        r"(?i)</?table[^>]*>",
        r"(?i)</?tr[^>]*>",
        r"(?i)</?td[^>]*>",
    ):
        out = F.regexp_replace(out, F.lit(pattern), F.lit(""))
    return F.when(html.rlike(r"(?i)</?(?:html|body|head|t[rd]|table)"), out).otherwise(html)


# --- element spans -------------------------------------------------------------------------------------------


def with_elements(
    df: DataFrame, names: Column, lengths: Column, links: str | None = None, hits: Column | None = None, into: str = "__spans"
) -> DataFrame:
    """Element spans of a mark sequence as an array in document order (see ``spans.nested``).

    ``open``/``close`` are mark indices, ``parent`` is the ``id`` of the enclosing element or -1; ``len``, ``links``
    and ``hits`` are sums over the span: of text, of marks named ``links``, of the numbers in ``hits``. The result is
    settled, as the optimizer would otherwise move the kernel into expressions that cannot hold it.
    """
    return settled(df.withColumn(into, element_spans(names, lengths, links, hits)))


def with_marks(df: DataFrame, pattern: str, bare: str = "bare") -> DataFrame:
    """Split a skeleton column at the marks ``pattern`` matches: adds ``__names`` and ``__texts`` (one more text than
    names). Kept as columns so that each step stays a small expression for the analyzer."""
    return df.withColumns(
        {
            "__texts": F.split(F.col(bare), pattern, -1),
            "__names": mark_names(F.regexp_extract_all(F.col(bare), F.lit(pattern), F.lit(0))),
        }
    )


def bound(columns, body) -> Column:
    """Bind several columns once and pass them to ``body`` (see ``arrays.let``)."""
    return let(
        F.struct(*[F.col(c).alias(c) for c in columns]), lambda row: body(*[row[c] for c in columns])
    )


def with_spans(df: DataFrame, pattern: str, bare: str = "bare", strip: bool = True) -> DataFrame:
    """``with_marks`` plus ``__spans``: the elements of the matched tags with the length of their stripped text (0
    without ``strip``)."""
    length = (lambda t: F.length(node_text(t))) if strip else (lambda t: F.lit(0))
    return with_marks(df, pattern, bare).transform(
        with_elements, F.col("__names"), F.transform("__texts", length)
    )


def without_temporaries(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def pieces_of(names: Column, texts: Column) -> Column:
    """Texts and marks interleaved: text k at index 2k, mark k at 2k+1."""
    return F.flatten(
        F.zip_with(
            texts,
            names,
            lambda t, n: F.array(t, F.coalesce(F.concat(F.lit("\x01"), n, F.lit("\x02")), F.lit(""))),
        )
    )


def span_nodes(texts: Column, span: Column) -> Column:
    """T2 of a span: its text nodes stripped one by one, however the page was split."""
    return F.array_join(F.transform(F.slice(texts, span["open"] + 2, span["close"] - span["open"]), node_text), "")


def span_text(texts: Column, span: Column) -> Column:
    """The segments inside a span, concatenated."""
    return F.array_join(F.slice(texts, span["open"] + 2, span["close"] - span["open"]), "")


"""Text functions with the whitespace and escaping rules the curation operators rely on."""

from __future__ import annotations

import html.entities

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.arrays import let

# The characters that count as whitespace. trim() knows only the space, Java's \s only the ASCII ones.
BLANK_CHARS = "".join(
    chr(c)
    for c in (*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
)
BLANK = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NON_BLANK = BLANK.replace("[", "[^", 1)
_ENTITY_HEAD = r"^(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);?"
_CONTROLS = (*range(1, 9), 11, *range(14, 32))  # no characters of a document; the first two are tag marks


def py_strip(text: Column) -> Column:
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(text, F.lit(BLANK_CHARS))


def clean_text(text: Column) -> Column:
    """Collapse every whitespace run to one space and strip."""
    # A single space is left alone instead of being replaced by itself.
    other = BLANK.replace(r"\x20", r"\x1f")
    return F.btrim(F.regexp_replace(text, F.lit(rf" {BLANK}+|{other}{BLANK}*"), F.lit(" ")))


def escape_html(text: Column) -> Column:
    """Escape the five markup characters; the ampersand goes first."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    out = F.replace(out, F.lit('"'), F.lit("&quot;"))
    return F.replace(out, F.lit("'"), F.lit("&#39;"))


def escape_body_text(text: Column) -> Column:
    """P10: escape for element content, where quotes stay as they are."""
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def _from_code_point(reference: Column) -> Column:
    digits = F.regexp_extract(reference, "^#[xX]?0*([0-9A-Fa-f]*)$", 1)
    in_range = (digits != "") & (F.length(digits) <= 7)
    is_hex = F.lower(F.substring(reference, 2, 1)) == "x"
    number = F.when(in_range & is_hex, F.conv(digits, 16, 10)).when(in_range, digits).cast("bigint")
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF) & ~number.isin(*_CONTROLS)
    as_utf32 = F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(F.lit(0xFFFD).cast("bigint"))), 8, "0"))
    return F.decode(as_utf32, "UTF-32")


def _named_entities() -> Column:
    pairs = dict(html.entities.name2codepoint, apos=39)
    listing = "\x03".join(f"{name}\x04{chr(cp)}" for name, cp in sorted(pairs.items()))
    return F.str_to_map(F.lit(listing), F.lit("\x03"), F.lit("\x04"))


def decode_entities(text: Column) -> Column:
    """T4: decode named and numeric character references in one pass, natively."""
    names = _named_entities()

    def piece(part: Column) -> Column:
        return let(
            F.regexp_extract(part, _ENTITY_HEAD, 1),
            lambda name: let(
                F.when(name == "", F.lit(None).cast("string"))
                .when(F.startswith(name, F.lit("#")), _from_code_point(name))
                .otherwise(F.try_element_at(names, name)),
                lambda char: F.when(char.isNull(), F.concat(F.lit("&"), part)).otherwise(
                    F.concat(char, F.regexp_replace(part, F.lit(_ENTITY_HEAD), F.lit("")))
                ),
            ),
        )

    return let(
        F.split(text, "&", -1),
        lambda parts: F.concat(
            F.get(parts, F.lit(0)),
            F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), piece), ""),
        ),
    )


def plain_base64(data: Column) -> Column:
    """base64 in one line; Spark's own breaks lines at 76 characters."""
    return F.translate(F.base64(data), "\r\n", "")
